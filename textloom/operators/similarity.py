"""Mean word vectors and the most similar earlier texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.tables import bounded, numbered


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_pooled(tokens: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, vec): the normalised mean of the vectors (word, vec) of each key's words; keys without a known word are left out."""
    place = tokens.join(vectors, "word").select(key, F.posexplode("vec").alias("d", "x")).groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = place.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("all")).select(key, F.transform("all", lambda p: p["x"]).alias("v"))
    norm = F.sqrt(dot("v", "v"))
    return mean.select(key, F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v")).alias("vec"))


def earlier_top_k(rows: DataFrame, pos: str, vec: str, queries: Column, k: int, over: float, block: int = 4_096) -> DataFrame:
    """(query, neighbor, rank, score): of all rows before each query the k most similar above over, ties to the first.

    queries: which rows ask. Blocks of that many of them are broadcast one after another, and each is held against all
    rows where these lie, so a task sends k rows a query and nothing else moves.
    """
    bounded(rows.sparkSession)
    asked, n = numbered(rows.where(queries & F.col(vec).isNotNull()).select(F.col(pos).cast("long").alias("query"), F.col(vec).cast("array<double>").alias("q")), ["query"], "place")
    every = rows.select(F.col(pos).cast("long"), F.col(vec).cast("array<double>"))
    found = None
    for first in range(0, n, block):
        own = asked.where((F.col("place") >= first) & (F.col("place") < first + block)).select("query", "q").toArrow()
        near = every.mapInArrow(_nearest(rows.sparkSession.sparkContext.broadcast(own), k, over), "query long, neighbor long, score double")
        found = near if found is None else found.unionAll(near)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query long, neighbor long, rank long, score double")
    scored = found.withColumn("score", F.round("score", 4)).where(F.col("score") > over)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "neighbor")).cast("long")).where(F.col("rank") <= k).select("query", "neighbor", "rank", "score")


#: Pairs of a query and a row that are scored at once, 8 MB of numbers.
PAIRS = 1 << 20


def _nearest(shared, k: int, over: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value.column("query").to_numpy(), np.stack(shared.value.column("q").to_numpy(zero_copy_only=False))
        # Of each query the best so far, and what a score must exceed to count.
        row, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(len(own), over - 1e-3)
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            step = max(1, PAIRS // len(ids))
            for a in range(0, len(own), step):
                fresh = q[a : a + step] @ x.T
                r, c = np.nonzero((fresh > floor[a : a + step, None]) & (ids[None, :] < own[a : a + step, None]))
                if len(r):
                    row, at, score = np.r_[row, r + a], np.r_[at, ids[c]], np.r_[score, fresh[r, c]]
                    row, at, score = _best(row, at, score, 2 * k, floor)
        yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(at), pa.array(score)], ["query", "neighbor", "score"])

    return run


def _best(row: np.ndarray, at: np.ndarray, score: np.ndarray, n: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's n best, by the rounded score, as ties are: what is equal to four places goes to the first id. floor rises to
    what can't enter any more."""
    near = np.round(score, 4)
    order = np.lexsort((at, -near, row))
    row, at, score, near = row[order], at[order], score[order], near[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    last = place == n - 1
    floor[row[last]] = np.maximum(floor[row[last]], near[last] - 1e-4)
    keep = place < n
    return row[keep], at[keep], score[keep]
