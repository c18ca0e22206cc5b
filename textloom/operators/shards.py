"""Grouped codecs over columns: batches, shards, identities, history dictionaries, byte statistics."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import bytesview as B

from textloom.tables import dealt

from . import codecs, split


def batches(turns: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """turns with batch: its rows of one key, in order, by size."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return turns.withColumn("batch", F.floor(place / size).cast("int"))


def _grouped(turns: DataFrame, key: str, order: str, text_col: str, size: int, there_and_back, fact: tuple[str, str, pa.DataType], history: DataFrame | None = None) -> DataFrame:
    """Each batch of size rows there and back. there_and_back(messages, dictionary) gives the messages again and a fact of
    each one's code; history (key, dictionary) gives the dictionary, whose length is then a column too."""
    kinds = dict(turns.dtypes)
    name, sql, arrow = fact
    more = ["dictionary_bytes"] if history is not None else []

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        given = bytes(table.column("dictionary")[0].as_py() or b"") if more else b""
        back, facts = there_and_back([bytes(x or b"") for x in table.column("data").to_pylist()], given)
        hashes = [hashlib.sha256(x).hexdigest() for x in back]
        columns = {key: table.column(key), order: table.column(order), "restored_sha256": pa.array(hashes, pa.string()), "n_bytes": pa.array(map(len, back), pa.int64()), name: pa.array(facts, arrow)}
        return pa.table(columns | {c: pa.array([len(given)] * len(back), pa.int64()) for c in more})

    slim = batches(turns, key, order, size).select(key, "batch", order, F.encode(text_col, "UTF-8").alias("data"))
    slim = slim.join(history, key) if history is not None else slim
    return dealt(slim, key, "batch", like=turns).groupBy(key, "batch").applyInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, restored_sha256 string, n_bytes long, {name} {sql}" + "".join(f", {c} long" for c in more))


def batch_roundtrip(turns: DataFrame, key: str, order: str, text_col: str, size: int, majority: bool = False) -> DataFrame:
    """frame_ok: a frame of the batch's vocabulary no larger than the raw one, and with majority of the same mode as all."""

    def run(messages: list[bytes], _: bytes):
        frames = codecs.compress_batch(messages, majority)
        modes = {codecs.unframe(f)[0] for f in frames}
        ok = [len(modes) == 1 if majority else len(f) <= len(m) + 14 for f, m in zip(frames, messages)]
        return [codecs.decompress(f) for f in frames], ok

    return _grouped(turns, key, order, text_col, size, run, ("frame_ok", "boolean", pa.bool_()))


def split_batch_roundtrip(turns: DataFrame, key: str, order: str, text_col: str, size: int, patterns: list[bytes], history: DataFrame | None = None) -> DataFrame:
    def run(messages: list[bytes], dictionary: bytes):
        code = codecs.split_batch(messages, codecs.cached_matcher(tuple(patterns)), "v4", dictionary)
        return codecs.unsplit_batch(code, patterns, "v4", dictionary), codecs.batch_tokens(code)

    return _grouped(turns, key, order, text_col, size, run, ("n_tokens", "long", pa.int64()), history)


def shard_roundtrip(turns: DataFrame, upper: list[bytes], version: int = 7) -> DataFrame:
    """Each turn as a frame of its shard type, with its own tier above the given ones, and back; what the frame says of
    itself is read from its bytes."""
    slim = turns.withColumn("shard", B.shard_of(F.col("role")))
    slim = slim.select("conv_id", "turn", "shard", F.encode("text", "UTF-8").alias("data"))

    def run(rows):
        for batch in rows:
            out = []
            for s, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                code = codecs.shard_compress(bytes(d or b""), s, upper, version)
                back = codecs.shard_decompress(code, s, upper, version)
                out.append((hashlib.sha256(back).hexdigest(), len(back), *codecs.shard_facts(code)))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds))], ["conv_id", "turn", "restored_sha256", "n_bytes", "shard_code", "version", "own_entries"])

    return slim.mapInArrow(run, "conv_id long, turn long, restored_sha256 string, n_bytes long, shard_code long, version long, own_entries long")


def identities(docs: DataFrame, text_col: str, upper: list[bytes], shard: str = "generic", session: str = "") -> DataFrame:
    """docs with identity, a name for the content: equal for equal texts of a shard type and session, else different."""
    name = split.byte_udf(lambda d: codecs.identity(d, shard, session, upper), "string")
    return docs.withColumn("identity", name(F.encode(text_col, "UTF-8")))


def history_dictionary(turns: DataFrame, key: str, order: str, text_col: str, first: int = 400, size: int = 32_768) -> DataFrame:
    """key, literal_bytes, dictionary: the last size bytes (byte view) of the literals of each key's first turns."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    lits = split.streams(turns.withColumn("place", place).where(F.col("place") <= first), text_col)
    whole = lits.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "lits"))), lambda x: x["lits"]), "").alias("all"))
    return whole.select(key, F.length("all").alias("literal_bytes"), F.expr(f"right(all, {size})").alias("dictionary"))


def _tally(df: DataFrame, text_col: str, size: int, values, schema: str) -> DataFrame:
    """How often each of size numbers occurs among values(bytes, first position of each text and the end), by task."""

    def run(rows):
        total = np.zeros(size, np.int64)
        for batch in rows:
            data = batch.column(0).cast(pa.large_binary())
            if data.null_count:
                data = data.fill_null(b"")
            ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
            raw = np.frombuffer(data.buffers()[2], np.uint8) if ends[-1] else np.zeros(0, np.uint8)
            for at in range(0, len(data), 1024):
                cut = ends[at : at + 1025]
                total += np.bincount(values(raw[cut[0] : cut[-1]], cut - cut[0]), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["value", "n"])

    return df.select(F.encode(text_col, "UTF-8")).mapInArrow(run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).selectExpr(*schema)


def histogram(df: DataFrame, text_col: str) -> DataFrame:
    """byte, n over all texts; a task sends 256 numbers."""
    return _tally(df, text_col, 256, lambda data, ends: data, ["cast(value as int) as byte", "n"])


def bigrams(df: DataFrame, text_col: str) -> DataFrame:
    """previous, byte, n over neighbours within a text; a task sends 65,536 numbers at most."""

    def pairs(data, ends):
        both = data[:-1].astype(np.int64) << 8 | data[1:]
        within = np.ones(len(both), bool)
        last = ends[1:-1] - 1  # a text's last byte and the next text's first aren't neighbours
        within[last[(last >= 0) & (last < len(both))]] = False
        return both[within]

    return _tally(df, text_col, 1 << 16, pairs, ["cast(value div 256 as int) as previous", "cast(value % 256 as int) as byte", "n"])


def normalised(counts: DataFrame) -> DataFrame:
    """byte, freq: counts scaled to 2048 as the coder does it, over at most 256 rows."""
    every, ranked = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "byte")
    scaled = F.greatest(F.lit(1), F.floor(F.col("n") * float(codecs.PROB_SCALE) / F.sum("n").over(every) + 0.5)).cast("long")
    t = counts.withColumn("f", scaled).withColumns({"short": codecs.PROB_SCALE - F.sum("f").over(every), "r": F.row_number().over(ranked), "k": F.count("*").over(every)})
    t = t.withColumn("spare", F.coalesce(F.sum(F.col("f") - 1).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    more = F.expr("f + short div k + if(r <= short % k, 1, 0)")
    less = F.expr("f - least(f - 1, greatest(0, -short - spare))")
    return t.select("byte", F.when(F.col("short") >= 0, more).otherwise(less).cast("long").alias("freq"))


def trained_order1(df: DataFrame, text_col: str) -> dict[int, list[int]]:
    """Smoothed order-1 tables of the corpus; at most 65,536 counts come to the driver."""
    counts = [[1] * 256 for _ in range(256)]
    for r in bigrams(df, text_col).collect():
        counts[r["previous"]][r["byte"]] += 8 * r["n"]
    return {a: codecs.normalise(c) for a, c in enumerate(counts)}


def pretrained_roundtrip(turns: DataFrame, text_col: str) -> DataFrame:
    shared = turns.sparkSession.sparkContext.broadcast(trained_order1(turns, text_col))
    code = split.byte_udf(lambda d: codecs.order1_encode(d, shared.value), "binary")
    back = split.byte_udf(lambda c: codecs.order1_decode(c, shared.value), "binary")
    coded = turns.withColumn("code", code(F.encode(text_col, "UTF-8"))).withColumn("back", back("code"))
    return coded.select("conv_id", "turn", F.sha2("back", 256).alias("restored_sha256"), F.octet_length("back").cast("long").alias("n_bytes"), (F.octet_length("code") < F.octet_length("back")).alias("packed"))
