"""Quality selection by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Both models are bags of hashed unigrams and bigrams of tokens (runs of letters and digits, runs of other signs; a token
equal to the one before the last sign or right before it becomes a repeat mark). A document's log weight is the sum over
its n-grams of log p_target - log p_raw. Gumbel noise is added and the k largest sums are sampled without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, U64, bounded, mix, runs, text_slices, written

#: Log ratios are integers of this many units, so that a document's sum doesn't depend on its neighbours.
UNITS = 1 << 16
_CLASS = np.full(256, 2, np.uint8)
_CLASS[:33] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_a:_b] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of letters and digits or of other signs; case counts, repeats are marked."""
    h, first = runs(data, offsets, _CLASS, False)
    row = np.searchsorted(offsets, first, "right") - 1
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    again[2:] |= (h[2:] == h[:-2]) & (row[2:] == row[:-2]) & (_CLASS[data[first[2:]]] == 1)
    h[again] = U64(1)
    return h, row


def feature_blocks(data: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bin, row) of each token and each pair of neighbouring tokens, of BLOCK tokens at once."""
    h, row = tokens(data, offsets)
    shift = U64(64 - bits)
    for a in range(0, len(h), BLOCK):
        own, at = h[a : a + BLOCK], row[a : a + BLOCK]
        before = max(a - 1, 0)
        near, to = h[before : a + BLOCK], row[before : a + BLOCK]
        same = to[1:] == to[:-1]
        pair = mix(near[:-1] * U64(3) + near[1:])[same]
        yield np.r_[mix(own) >> shift, pair >> shift].astype(np.int64), np.r_[at, to[1:][same]]


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """feature_blocks in one."""
    parts = [*feature_blocks(data, offsets, bits), (np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return np.concatenate([b for b, _ in parts]), np.concatenate([r for _, r in parts])


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                for at, _ in feature_blocks(data, offsets, bits):
                    total += np.bincount(at, minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bin", "n"])

    return run


def bin_counts(texts: DataFrame, bits: int) -> np.ndarray:
    """Counts of all n-gram bins; 2**bits numbers come to the driver, whatever the size of texts."""
    rows = texts.mapInArrow(_count(bits), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(1 << bits, np.int64)
    total[rows["bin"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return total


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float) -> np.ndarray:
    p, q = target + smoothing, raw + smoothing
    return np.rint((np.log(p / p.sum()) - np.log(q / q.sum())) * UNITS).astype(np.int64)


def log_weight(ratios, bits: int):
    """The log weight, in units, of each text of a column; ratios: the shared log ratios of all bins."""

    def units(column: pa.Array) -> pa.Array:
        table = np.frombuffer(ratios.value, np.int64)
        sums = [np.zeros(0, np.int64)]
        for a, b, data, offsets in text_slices(column):
            sums.append(np.zeros(b - a, np.int64))
            for at, row in feature_blocks(data, offsets, bits):
                np.add.at(sums[-1], row, table[at])
        return pa.array(np.concatenate(sums))

    units.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(units, "long")


def weighed(df: DataFrame, ratios: np.ndarray, text_col: str) -> Column:
    """The log weight of text_col: texts go to Python, and a number each comes back."""
    shared = df.sparkSession.sparkContext.broadcast(ratios.tobytes())
    return log_weight(shared, len(ratios).bit_length() - 1)(F.coalesce(df[text_col].cast("string"), F.lit("")))


def gumbel(id_col: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the id and the seed alone, in units."""
    u = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.rint(-F.log(-F.log(u)) * UNITS).cast("long")


def kth_largest(scores: DataFrame, column: str, k: int, fan: int = 4096) -> tuple[int, int]:
    """(value of the k-th largest of a column of longs, how many are larger), by narrowing histograms of fan bins."""
    low, high = scores.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        width = (high - low) // fan + 1
        rows = scores.where(F.col(column).between(low, high)).groupBy(F.expr(f"({column} - ({low})) div {width}").alias("b")).count().collect()
        for b, n in sorted(rows, reverse=True):
            if above + n >= k:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            above += n
    return low, above


class Selection:
    """What one fit over a table decides: the log ratios, and the smallest (noisy weight, id) that is kept."""

    def __init__(self, ratios: np.ndarray, cut: int | None, last_id: int | None, seed: int):
        self.ratios, self.cut, self.last_id, self.seed = ratios, cut, last_id, seed

    def keeps(self, noisy: Column, id_col: Column) -> Column:
        if self.cut is None:
            return F.lit(True)
        last = F.lit(self.last_id if self.last_id is not None else -(1 << 63)).cast("long")
        # One comparison, so that the weight, which Python computes, is in it once.
        return F.struct(noisy.alias("a"), (-1 - id_col).alias("b")) >= F.struct(F.lit(self.cut).cast("long").alias("a"), (-1 - last).alias("b"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int = 16, smoothing: float = 1.0, target_rows: int = 20_000, recall: float = 0.998, seed: int = 11) -> tuple[Selection, DataFrame | None]:
    """Fits both models and draws the sample; also gives all documents' (id, noisy, units).

    target: the documents labelled quality = 1, a hash sample of at most target_rows of them (the documented bound of the
    fit); raw: all documents. k is the number of documents whose weight reaches the (1 - recall) quantile of the target
    documents' weights, so it follows the share of target-like text in the input.
    """
    bounded(docs.sparkSession)
    # The bound: a uniform sample by hash of the id, the same whatever the partitioning.
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good")).distinct()
    good = written(good.join(docs.select(F.col(id_col).cast("long").alias("there")).distinct(), F.col("good") == F.col("there"), "left_semi").orderBy(F.xxhash64("good", F.lit(seed)), "good").limit(target_rows), "target")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    target_docs = texts.join(F.broadcast(good), F.col("id") == F.col("good"), "left_semi")
    target = bin_counts(target_docs.select("text"), bits)
    if not target.any():
        return Selection(np.zeros(1 << bits, np.int64), None, None, seed), None
    raw = bin_counts(texts.select("text"), bits)
    ratios = log_ratios(target, raw, smoothing)
    scores = texts.select("id", weighed(texts, ratios, "text").alias("units"))
    scores = written(scores.withColumn("noisy", F.col("units") + gumbel(F.coalesce("id", F.lit(-1)), seed)), "weights")
    floor = scores.join(F.broadcast(good), F.col("id") == F.col("good"), "left_semi").agg(F.percentile("units", F.lit(1 - recall))).first()[0]
    k = scores.where(F.col("units") >= floor).count()
    cut, above = kth_largest(scores, "noisy", k)
    ties = scores.where(F.col("noisy") == cut).orderBy(F.col("id").asc_nulls_first()).limit(k - above).agg(F.max("id")).first()[0]
    return Selection(ratios, cut, ties, seed), scores


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """docs' sampled rows with all their columns.

    Rows with a null id share one noise value; rows that repeat an id share theirs. Null and empty texts have weight 0.
    Labels may be null, repeat or name unknown documents; a document is a target if any of its labels has quality 1.
    A very long text is hashed in pieces and weighed as a whole. Ids are whole numbers.
    Without a labelled target text nothing can be judged and every row stays. Ties at the cut go to the smallest id; rows
    that repeat the id at the cut all stay. The table may be empty and have any further columns.
    """
    chosen, scores = fit(docs, labels, id_col, text_col, **fit_options)
    if scores is None:
        return docs
    key = docs[id_col].cast("long")
    noisy = weighed(docs, chosen.ratios, text_col) + gumbel(F.coalesce(key, F.lit(-1)), chosen.seed)
    return docs.where(chosen.keeps(noisy, F.coalesce(key, F.lit(-(1 << 63)))))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """(doc_id, log_weight) of the sampled documents; see resample."""
    chosen, scores = fit(docs, labels, id_col, text_col, **fit_options)
    if scores is None:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0.0).alias("log_weight"))
    kept = scores.where(chosen.keeps(F.col("noisy"), F.coalesce("id", F.lit(-(1 << 63)))))
    return kept.select(F.col("id").alias("doc_id"), (F.col("units") / UNITS).alias("log_weight"))
