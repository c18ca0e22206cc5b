"""Vocabularies of repeated byte patterns: mining, ranking, pruning, accumulation over batches, tiers and promotion.

Order is always: saving, longest, bytes. Patterns are binary columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.tables import bounded, dealt

from . import codecs

WINDOW_CAP, MIN_SAVING = 20_000, 3
L1_SLOTS, PROMOTE_TO_L2, PROMOTE_TO_L1 = 64, 2, 8


def ngram_counts(chunks: DataFrame, keys: list[str], text_col: str, length: int) -> DataFrame:
    """keys, pattern (byte view) and n: overlapping occurrences of runs of length bytes, those of 3 or more.

    The texts of a key come together and are counted where they are, so that no row is made for each byte."""
    bounded(chunks.sparkSession)
    texts = dealt(chunks, *keys).groupBy(*keys).agg(F.collect_list(F.encode(text_col, "UTF-8")).alias("__texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, patterns, counts = [], [], []
            for i, found in enumerate(batch.column(len(keys))):
                runs: Counter[bytes] = Counter()
                for data in found.as_py():
                    if len(data) >= 2 * length:
                        runs.update(data[j : j + length] for j in range(len(data) - length + 1) if (b := data[j]) >= 32 or b == 10 or b == 13 and j)
                for p, n in runs.items():
                    if n >= codecs.MIN_COUNT:
                        at.append(i)
                        patterns.append(p.decode("latin-1"))
                        counts.append(n)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(keys))), pa.array(patterns, pa.string()), pa.array(counts, pa.int64())], [*keys, "pattern", "n"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[: len(keys)])
    return texts.mapInArrow(run, f"{head}, pattern string, n long")


_CHUNKS = 128  # whose entries are made into rows at once


def _of_chunks(chunks: DataFrame, keys: list[str], text_col: str, entries: Callable[[bytes], Iterable[tuple[int, codecs.Entry]]]) -> DataFrame:
    """keys, rank, pattern, freq, saving: what entries finds in each chunk. Chunk by chunk in the mappers; nothing moves, and
    what a task holds are the entries of a few chunks."""
    slim = chunks.select(*keys, F.col(text_col).cast("binary").alias("__data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, _CHUNKS) for b in batches for i in range(0, b.num_rows, _CHUNKS)):
            at, rows = [], []
            for i, data in enumerate(batch.column(len(keys))):
                for rank, e in entries(data.as_py() or b""):
                    at.append(i)
                    rows.append((rank, e.pattern, e.freq, e.saving))
            columns = zip(*rows) if rows else ((), (), (), ())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(keys))), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64())))], [*keys, "rank", "pattern", "freq", "saving"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keys)])
    return slim.mapInArrow(run, f"{head}, rank long, pattern binary, freq long, saving long")


def mined(chunks: DataFrame, keys: list[str], text_col: str = "text", limit: int = codecs.MAX_ENTRIES) -> DataFrame:
    """keys, rank, pattern, freq, saving: each chunk's own vocabulary."""
    return _of_chunks(chunks, keys, text_col, lambda data: enumerate(codecs.mine(data, limit), 1))


def candidates(chunks: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, rank, pattern, freq, saving: each chunk's candidates of all lengths, before any is pruned."""

    def run(data: bytes) -> Iterable[tuple[int, codecs.Entry]]:
        return enumerate(sorted((codecs.Entry(p, n, (len(p) - 2) * n) for p, n in codecs.count_patterns(data).items()), key=codecs.order_of), 1)

    return _of_chunks(chunks, keys, text_col, run)


def fired(chunks: DataFrame, keys: list[str], text_col: str = "text", limit: int = codecs.MAX_ENTRIES) -> DataFrame:
    """keys, rank, pattern, freq, saving: of each chunk's own vocabulary the entries whose ids its encoding holds."""

    def run(data: bytes) -> Iterable[tuple[int, codecs.Entry]]:
        own = codecs.mine(data, limit)
        ids = set(codecs.Matcher([e.pattern for e in own]).pieces(data)[0])
        return [(i, e) for i, e in enumerate(own, 1) if i in ids]

    return _of_chunks(chunks, keys, text_col, run)


def ordered(saving: str = "saving", pattern: str = "pattern") -> list[Column]:
    return [F.col(saving).desc(), F.octet_length(pattern).desc(), F.col(pattern)]


def top(entries: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Each key's n first entries with their rank; without keys, of all."""
    if not keys:
        best = entries.orderBy(*ordered()).limit(n)
        return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*ordered())).cast("long"))
    return entries.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*ordered())).cast("long")).where(F.col("rank") <= n)


def dominated_pruned(candidates: DataFrame, keys: list[str], limit: int = codecs.MAX_ENTRIES) -> DataFrame:
    """Drops each candidate that lies inside a better one of its key: the greedy choice, as lying inside is transitive."""
    ranked = candidates.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*ordered())))
    better = ranked.select(*(F.col(k).alias(f"b_{k}") for k in keys), F.col("place").alias("b_place"), F.col("pattern").alias("b_pattern"))
    inside = F.col("b_place") < F.col("place")
    for k in keys:
        inside &= F.col(k) == F.col(f"b_{k}")
    inside &= F.expr("contains(b_pattern, pattern)")
    kept = ranked.join(better, inside, "left_anti").drop("place")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*ordered())).cast("long")).where(F.col("rank") <= limit)


def merged(first: DataFrame, second: DataFrame, limit: int = codecs.MAX_ENTRIES) -> DataFrame:
    """first, and of second what first lacks, the limit best."""
    return top(first.unionByName(second.join(first, "pattern", "left_anti")), [], limit)


def window(entries: DataFrame, keys: list[str], batch_col: str, cap: int = WINDOW_CAP) -> DataFrame:
    """keys, pattern, freq, saving, last_seen, rank: the vocabulary accumulated over all batches, the cap best.

    Below the cap this is what an ordered update in a stream gives, as sums don't depend on order; above it, the best by
    total saving stay, whatever the order.
    """
    total = entries.where(F.col("saving") >= MIN_SAVING).groupBy(*keys, "pattern").agg(F.sum("freq").alias("freq"), F.sum("saving").alias("saving"), F.max(batch_col).alias("last_seen"))
    return top(total, keys, cap)


def window_as_of(entries: DataFrame, keys: list[str], batch_col: str) -> DataFrame:
    """Each update of a pattern with its totals up to then, for a join by version."""
    upto = Window.partitionBy(*keys, "pattern").orderBy(batch_col).rowsBetween(Window.unboundedPreceding, 0)
    return entries.where(F.col("saving") >= MIN_SAVING).select(*keys, batch_col, "pattern", F.sum("freq").over(upto).alias("freq"), F.sum("saving").over(upto).alias("saving"))


def tier_three(entries: DataFrame, keys: list[str]) -> DataFrame:
    good = entries.where((F.col("saving") >= 2) & (F.octet_length("pattern") >= 4))
    return top(good, keys, codecs.TIER_SLOTS[3])


def promoted_to_two(tier3: DataFrame, session: str) -> DataFrame:
    return tier3.where(F.col("freq") >= PROMOTE_TO_L2).groupBy(session, "pattern").agg(F.sum("freq").alias("freq"), F.sum("saving").alias("saving"))


def promoted_to_one(tier2: DataFrame, tier1: DataFrame, shard: str) -> DataFrame:
    """tier1 with the frequent patterns of tier2 that it lacks, the 64 best of each shard type."""
    fresh = tier2.where(F.col("freq") >= PROMOTE_TO_L1).groupBy(shard, "pattern").agg(F.max("freq").alias("freq"), F.max("saving").alias("saving"))
    fresh = fresh.join(tier1, [shard, "pattern"], "left_anti")
    return top(tier1.select(shard, "pattern", "freq", "saving").unionByName(fresh), [shard], L1_SLOTS)


def tiers(levels: list[DataFrame], keys: list[str] | None = None, slots: tuple[int, ...] = codecs.TIER_SLOTS) -> DataFrame:
    """(keys, tier, pattern, freq, saving, token_id): each key's tiers one after the other, each with its slots, ids without
    gaps."""
    keys = keys or []
    parts = [top(df.select(*keys, "pattern", "freq", "saving"), keys, n).withColumn("tier", F.lit(t)) for t, (df, n) in enumerate(zip(levels, slots))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("tier", "rank")  # at most 254 entries a key
    return every.withColumn("token_id", F.row_number().over(order).cast("long")).select(*keys, "tier", "pattern", "freq", "saving", "token_id")


def static_dictionary(entries: DataFrame, n: int = 5_000) -> DataFrame:
    """The n best patterns over all batches, those of white space alone left out."""
    solid = F.trim(F.translate(F.decode("pattern", "ISO-8859-1"), "\t\r\n", "   ")) != ""
    total = entries.where(solid).groupBy("pattern").agg(F.sum("freq").alias("freq"), F.sum("saving").alias("saving"))
    return top(total, [], n)
