"""Corpora: loaders of the usual chat exports, binary files, and what prepares their turns."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import tables
from textloom.operators import codecs


def _between(turns: DataFrame, least: int, most: int) -> DataFrame:
    """Turns (text) of more than least and fewer than most characters; null ones go."""
    return turns.where((F.length("text") > least) & (F.length("text") < most))


def share_json(spark: SparkSession, path: str, least: int = 200, most: int = 3_000) -> DataFrame:
    """A JSON array of {conversations: [{value}]}."""
    raw = spark.read.schema("conversations array<struct<value:string>>").json(path, multiLine=True)
    return _between(raw.select(F.explode("conversations.value").alias("text")), least, most)


def chat_parquet(spark: SparkSession, path: str, least: int = 200, most: int = 3_000) -> DataFrame:
    """Parquet with conversation: a list of structs with content; rows or turns without any give nothing."""
    return _between(spark.read.parquet(path).select(F.explode("conversation.content").alias("text")), least, most)


def dialogue_csv(spark: SparkSession, path: str, least: int = 200, most: int = 3_000) -> DataFrame:
    """CSV with a header and a column text, trimmed."""
    return _between(spark.read.csv(path, header=True, multiLine=True, escape='"').select(F.trim("text").alias("text")), least, most)


def turn_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object with content, or a JSON string, a line."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return raw.select(F.coalesce(F.get_json_object("value", "$.content"), F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0]).alias("text"))


def export_json(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """(role, text) of chat exports: messages or chat_messages, text or content as string or parts, role or sender."""
    kind = "array<struct<text:string,content:string,role:string,sender:string>>"
    raw = spark.read.schema(f"messages {kind}, chat_messages {kind}").json(path, multiLine=True)
    m = raw.select(F.explode(F.coalesce("messages", "chat_messages")).alias("m"))
    parts = F.from_json("m.content", "array<struct<text:string>>")
    joined = F.array_join(F.filter(parts["text"], lambda x: x.isNotNull()), " ")
    text = F.coalesce(F.nullif("m.text", F.lit("")), F.when(F.col("m.content").startswith("["), joined).otherwise(F.col("m.content")))
    return m.select(F.coalesce("m.role", "m.sender").alias("role"), F.trim(text).alias("text")).where(F.length("text") > least)


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"


def validated(messages: DataFrame, request: str, text_col: str, most_bytes: int = 10 << 20, most_messages: int = 1_000) -> DataFrame:
    """messages with status: empty, too_large, too_many (of one request) or ok."""
    sizes = messages.groupBy(request).agg(F.count("*").alias("__n")).where(F.col("__n") > most_messages).withColumnRenamed(request, "__request")
    marked = messages.join(sizes, F.col(request).eqNullSafe(F.col("__request")), "left")
    status = F.when(F.coalesce(F.col(text_col), F.lit("")) == "", "empty").when(F.octet_length(text_col) > most_bytes, "too_large")
    return marked.select(*messages.columns, status.when(F.col("__n").isNotNull(), "too_many").otherwise("ok").alias("status"))


def chunks(df: DataFrame, keys: list[str], data: Column, size: int = 65_536) -> DataFrame:
    """keys, chunk, data: consecutive pieces of size bytes (or characters of a string); nothing for empty data."""
    n = F.ceil(F.length(data) / size).cast("int")
    pieces = df.select(*keys, data.alias("whole"), n.alias("n")).where("n > 0")
    pieces = pieces.select(*keys, "whole", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    return pieces.select(*keys, "chunk", F.substring("whole", F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def file_chunks(spark: SparkSession, path: str, size: int = 65_536) -> DataFrame:
    return chunks(spark.read.format("binaryFile").load(path), ["path"], F.col("content"), size)


def every(df: DataFrame, order: list[str], wanted: int) -> DataFrame:
    """Rows at even steps in the order, about wanted of them."""
    placed, n = tables.numbered(df, order, "__place")
    return placed.where(F.col("__place") % max(1, n // wanted) == 0).drop("__place")


def sample(df: DataFrame, id_cols: list[str], seed: int, n: int) -> DataFrame:
    """n rows in an order that depends on the seed and the ids alone, the same in any engine."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in id_cols)), 256)
    return df.orderBy(key, *id_cols).limit(n)


def fused(turns: DataFrame, key: str, order: str, text_col: str, size: int = 800) -> DataFrame:
    """(key, place, text): neighbouring turns of a key joined with " | " while text and next turn have under size characters."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, text_col))), lambda x: x[text_col])
    rows = turns.where(F.trim(text_col) != "").groupBy(key).agg(texts.alias("texts"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def more(s: Column, t: Column) -> Column:
        fits = F.length(s["open"]) + F.length(t) < size
        joined = F.when(s["open"] == "", t).otherwise(F.concat(s["open"], F.lit(" | "), t))
        flushed = F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.struct(F.when(fits, s["done"]).otherwise(flushed).alias("done"), F.when(fits, joined).otherwise(t).alias("open"))

    done = F.aggregate("texts", start, more, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return rows.select(key, F.posexplode(done).alias("place", "text"))


# binary files ---------------------------------------------------------------------------------------------------------

def batch_items(data: bytes) -> Iterator[bytes]:
    """The items of (u32 length, bytes)*; a cut one raises."""
    at = 0
    while at < len(data):
        if at + 4 > len(data) or at + 4 + (n := struct.unpack_from("<I", data, at)[0]) > len(data):
            raise codecs.CodecError("truncated")
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


def batch_file(items: list[bytes]) -> bytes:
    return b"".join(struct.pack("<I", len(x)) + x for x in items)


def vector_rows(data: bytes) -> Iterator[tuple[str, list[float]]]:
    """(word, vector) of a file of eight bytes, u32 words, u32 dimensions, then (u8 length, word, f32 x dimensions)*."""
    n, dim = struct.unpack_from("<II", data, 8)
    at = 16
    for _ in range(n):
        size = data[at]
        word = data[at + 1 : at + 1 + size].decode()
        yield word, list(struct.unpack_from(f"<{dim}f", data, at + 1 + size))
        at += 1 + size + 4 * dim


DICT_MAGIC = b"TLSD"


def dictionary_file(entries: list[codecs.Entry]) -> bytes:
    return DICT_MAGIC + codecs.dump_window(entries)


def dictionary_entries(data: bytes) -> list[codecs.Entry]:
    if data[:4] != DICT_MAGIC:
        raise codecs.CodecError("bad_magic")
    return codecs.load_window(data[4:])


def _plain(data: bytes) -> bytes:
    """data, decoded if it is a file of save_batches or save_vectors."""
    return base64.b64decode(data[7:]) if data.startswith(b"base64:") else data


def _binary(spark: SparkSession, path: str, rows, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """The rows of each file, which a task holds one of at a time, and of its rows so many as a batch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for some in batched(rows(_plain(data.as_py())), tables.BATCH_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    names = [x.split()[0] for x in schema.split(", ")]
    tables.bounded(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _save(rows: DataFrame, path: str, made: Callable[[pa.RecordBatch], bytes]) -> None:
    """A file of made(batch) for each Arrow batch that has rows, so that no task holds or reads more at once, under path in
    the session's file system."""
    tables.bounded(rows.sparkSession)
    files = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([made(b)], pa.binary())], ["data"]) for b in batches), "data binary").where("octet_length(data) > 0")
    files.select(F.concat(F.lit("base64:"), F.translate(F.base64("data"), "\r\n", "")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def save_batches(rows: DataFrame, col: str, path: str) -> None:
    """(u32 length, bytes)* of each batch of rows, as base64 text files: Spark has no writer of plain bytes."""
    _save(rows.select(F.encode(col, "UTF-8")), path, lambda b: batch_file([x.as_py() or b"" for x in b.column(0)]))


def vector_file(words: list[tuple[str, list[float]]]) -> bytes:
    """The file that vector_rows reads; a word may have 255 bytes."""
    if not words:
        return b""
    dim = len(words[0][1])
    parts = [bytes(8) + struct.pack("<II", len(words), dim)]
    for word, vec in words:
        w = word.encode()
        parts.append(bytes([len(w)]) + w + struct.pack(f"<{dim}f", *vec))
    return b"".join(parts)


def save_vectors(rows: DataFrame, path: str) -> None:
    """A vector file of each batch of rows (word, vec), as base64 text files."""
    _save(rows.select("word", "vec"), path, lambda b: vector_file(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, lambda d: ((x,) for x in batch_items(d)), "data binary", [pa.binary()])


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, vector_rows, "word string, vec array<float>", [pa.string(), pa.list_(pa.float32())])


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, dictionary_entries, "pattern binary, freq long, saving long", [pa.binary(), pa.int64(), pa.int64()])


def save_snapshot(entries: DataFrame, path: str, version: int) -> None:
    """One JSON object with version and entries as (b: bytes, f, s), for exchange; the native form is the table."""
    one = F.struct(F.transform(F.sequence(F.lit(0), F.octet_length("pattern") - 1), lambda i: F.conv(F.substring(F.hex("pattern"), i * 2 + 1, F.lit(2)), 16, 10).cast("int")).alias("b"), F.col("freq").alias("f"), F.col("saving").alias("s"))
    entries.agg(F.collect_list(one).alias("entries")).select(F.lit(version).alias("version"), "entries").coalesce(1).write.mode("error").json(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("version int, entries array<struct<b:array<int>,f:long,s:long>>").json(path)
    e = raw.select("version", F.explode("entries").alias("e"))
    return e.select("version", F.unhex(F.array_join(F.transform("e.b", lambda b: F.lpad(F.hex(b), 2, "0")), "")).alias("pattern"), F.col("e.f").alias("freq"), F.col("e.s").alias("saving"))


def save_tiers(tiers: DataFrame, path: str) -> None:
    """Tiers by tier, each row with a checksum of its content."""
    tiers.withColumn("crc", F.crc32(F.concat(F.col("pattern"), F.encode(F.concat_ws(":", "freq", "saving", "token_id"), "UTF-8")))).write.partitionBy("tier").mode("error").parquet(path)


def load_tiers(spark: SparkSession, path: str) -> DataFrame:
    """Raises when a row doesn't match its checksum."""
    now = F.crc32(F.concat(F.col("pattern"), F.encode(F.concat_ws(":", "freq", "saving", "token_id"), "UTF-8")))
    return spark.read.parquet(path).withColumn("crc", F.when(F.col("crc") == now, F.col("crc")).otherwise(F.raise_error(F.lit("crc_mismatch")).cast("long"))).where("crc is not null").drop("crc")
