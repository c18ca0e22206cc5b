"""Multilingual language identification: each document as a mixture of languages.

A language is a smoothed multinomial over hashed byte trigrams, fitted on a bounded sample of labelled documents. For a
document, expectation-maximisation finds the mixture proportions of greatest likelihood; of the nested sets of its
strongest languages the one with the greatest penalised likelihood is selected. A uniform background stands for text of
no known language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _LOWER, bounded, text_slices, written

BITS = 16
UNKNOWN = "und"
RESULT = T.StructType([T.StructField("language", T.StringType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("proportions", T.ArrayType(T.DoubleType())), T.StructField("accepted", T.BooleanType())])


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each byte trigram, first position of each row and the end): ASCII letters lowered, rows not crossed."""
    if len(data) < 3:
        return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
    x = _LOWER[data].astype(np.uint32)
    code = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    bins = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint16)
    size = np.maximum(np.diff(offsets) - 2, 0)
    whole = np.ones(len(bins), bool)
    for back in (1, 2):  # trigrams that begin in the last two bytes of a row
        at = offsets[1:-1] - back
        at = at[(at >= 0) & (at < len(bins)) & (at >= offsets[:-2])]
        whole[at] = False
    return bins[whole], np.r_[0, np.cumsum(size)]


#: A text of more bytes than this is counted in pieces and judged by its counts, of at most 65,536 bins.
LONG = 1 << 20


def long_counts(data: np.ndarray) -> np.ndarray:
    """How often each bin occurs in one text, in pieces that overlap by two bytes."""
    total = np.zeros(1 << BITS, np.int64)
    for a in range(0, len(data), LONG):
        part = data[a : a + LONG + 2]
        total += np.bincount(trigrams(part, np.array([0, len(part)]))[0], minlength=1 << BITS)
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang in batch.column(1).unique().to_pylist():
            texts = batch.column(0).filter(pa.compute.equal(batch.column(1), lang))
            for _, _, data, offsets in text_slices(texts):
                counts = long_counts(data) if len(data) > LONG else np.bincount(trigrams(data, offsets)[0], minlength=1 << BITS)
                total[lang] = total.get(lang, 0) + counts
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bin", "n"])


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_language: int, least_share: float, smoothing: float, seed: int) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities by language and bin); the background is the last row."""
    named = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null")
    sizes = named.groupBy("lang").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    common = [r["lang"] for r in sizes.where(F.col("n") >= least_share * total).select("lang").collect()]  # at most 1 / least_share
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    chosen = named.where(F.col("lang").isin(common)).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_per_language).select(F.col("id").alias("chosen"), F.col("lang").alias("chosen_lang"))
    chosen = written(chosen, "chosen")
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = texts.join(F.broadcast(chosen), (F.col("id") == F.col("chosen")) & (F.col("lang") == F.col("chosen_lang"))).select("text", "lang")

    def packed(table: pa.Table) -> pa.Table:
        whole = np.zeros(1 << BITS, np.int64)
        whole[table.column("bin").to_numpy()] = table.column("n").to_numpy()
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([whole.tobytes()], pa.binary())})

    counts = texts.mapInArrow(_count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    rows = sorted(counts.groupBy("lang").applyInArrow(packed, "lang string, counts binary").collect())
    languages = [r["lang"] for r in rows]
    p = np.ones((len(languages) + 1, 1 << BITS))
    for i, r in enumerate(rows):
        p[i] = np.frombuffer(r["counts"], np.int64) + smoothing
    return languages, (p / p.sum(axis=1, keepdims=True)).astype(np.float32)


def _weighed(x: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    return x if weight is None else x * weight


def _em(like: np.ndarray, weight: np.ndarray | None, start: np.ndarray, ends: np.ndarray, pi: np.ndarray, rounds: int, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Proportions pi (rows x languages) after expectation-maximisation, and each row's log likelihood under them.

    like: languages x positions; weight: how often each position counts, once if None. Rows are dropped from further rounds once they
    change by less than tolerance.
    """
    pi = pi.copy()
    active = np.arange(len(start))
    at, size = np.arange(like.shape[1]), ends - start
    mass = size if weight is None else np.add.reduceat(weight, start)
    sub, first, heavy = like, start, weight
    for _ in range(rounds):
        n = size[active]
        share = np.repeat(pi[active].T.astype(np.float32), n, axis=1)
        share *= sub
        share /= share.sum(axis=0)
        if heavy is not None:
            share = share * heavy
        new = (np.add.reduceat(share, first, axis=1) / mass[active]).T
        moved = np.abs(new - pi[active]).max(axis=1) > tolerance
        pi[active] = new
        if not moved.any():
            break
        if not moved.all():
            keep = np.repeat(moved, n)
            at, active = at[keep], active[moved]
            sub, first, heavy = like[:, at], np.r_[0, np.cumsum(size[active])[:-1]], None if weight is None else weight[at]
    total = np.einsum("ln,ln->n", np.repeat(pi.T.astype(np.float32), size, axis=1), like)
    return pi, np.add.reduceat(_weighed(np.log(np.maximum(total, 1e-30)).astype(np.float64), weight), start)


def mixtures(p: np.ndarray, bins: np.ndarray, first: np.ndarray, penalty: float, rounds: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Proportions (rows x languages) of the set selected for each row; a row without trigrams has all zero.

    Each language beyond the first must raise the log likelihood by penalty x log(trigrams). The likelihood is concave in
    the proportions, so a row whose gradient at its best single language promises less than that needs no
    expectation-maximisation. weight: how often each of bins counts, once by default.
    """
    weight = None if weight is None else weight.astype(np.float64)
    rows, languages = len(first) - 1, len(p)
    out = np.zeros((rows, languages))
    n = np.diff(first)
    filled = np.flatnonzero(n)
    if not len(filled):
        return out
    start = first[:-1][filled]
    size = n[filled]
    like = p[:, bins]
    mass = size if weight is None else np.add.reduceat(weight, start)
    single = np.add.reduceat(_weighed(np.log(like).astype(np.float64), weight), start, axis=1).T
    best = single.argmax(axis=1)
    out[filled, best] = 1
    base = np.take_along_axis(like, np.repeat(best, size)[None, :], axis=0)
    gain = np.add.reduceat(_weighed((like / base).astype(np.float64), weight), start, axis=1).max(axis=0) - mass
    cost = penalty * np.log(mass + 1.0)
    hard = np.flatnonzero(gain > cost)
    if not len(hard):
        return out
    keep = np.zeros(rows, bool)
    keep[filled[hard]] = True
    inside = np.repeat(keep, n)
    like, weight = like[:, inside], None if weight is None else weight[inside]
    size, cost = size[hard], cost[hard]
    ends = np.cumsum(size)
    start = ends - size
    pi, _ = _em(like, weight, start, ends, np.full((len(hard), languages), 1 / languages), rounds)
    order = np.argsort(-pi, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    chosen = np.zeros_like(pi)
    np.put_along_axis(chosen, best[hard][:, None], 1.0, axis=1)
    top = single[hard, best[hard]]
    for m in range(2, languages + 1):
        # the m strongest languages, for the rows in which the m-th has any share
        some = np.flatnonzero(np.take_along_axis(pi, order[:, m - 1 : m], axis=1)[:, 0] > 0.002)
        if not len(some):
            break
        allowed = np.where(rank[some] < m, np.maximum(pi[some], 1e-3), 0)
        allowed /= allowed.sum(axis=1, keepdims=True)
        mine = np.zeros(len(hard), bool)
        mine[some] = True
        e = np.cumsum(size[some])
        inside = np.repeat(mine, size)
        fitted, ll = _em(like[:, inside], None if weight is None else weight[inside], e - size[some], e, allowed, rounds)
        ll -= cost[some] * (m - 1)
        better = ll > top[some]
        chosen[some[better]] = fitted[better]
        top[some[better]] = ll[better]
    out[filled[hard]] = chosen
    return out


def _identified(model, languages: list[str], allowed: list[str] | None, penalty: float, rounds: int, least: float):
    """The RESULT of each text of a column."""
    names = [*languages, UNKNOWN]

    def judge(column: pa.Array) -> pa.Array:
        p = np.frombuffer(model.value, np.float32).reshape(len(names), 1 << BITS)
        results = []
        for _, _, data, offsets in text_slices(column, 1 << 18):
            if len(data) > LONG:  # one long text: its bins, weighed
                counts = long_counts(data)
                bins = np.flatnonzero(counts)
                pi = mixtures(p, bins, np.array([0, len(bins)]), penalty, rounds, counts[bins])
            else:
                pi = mixtures(p, *trigrams(data, offsets), penalty, rounds)
            for x in pi:
                found = [int(i) for i in np.argsort(-x, kind="stable") if x[i] > 0]
                known = [i for i in found if i < len(languages)]
                top = known[0] if known and (not languages or x[known[0]] >= least) else len(languages)
                results.append((names[top], [names[i] for i in found], [round(float(x[i]), 6) for i in found], not languages or top < len(languages) and (allowed is None or names[top] in allowed)))
        columns = list(zip(*results)) or [()] * 4
        kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], RESULT.names)

    judge.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return judge


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, allowed: list[str] | None = None, rows_per_language: int = 2_000, least_share: float = 0.005, smoothing: float = 0.5, penalty: float = 6.0, rounds: int = 30, least: float = 0.25, seed: int = 5) -> Column:
    """language, languages, proportions (strongest first) and accepted of each row of docs, as one column of RESULT.

    The models are fitted on at most rows_per_language documents of each value of lang_col that at least least_share of the
    labelled documents have, so of 200 languages at most, a hash sample by id: the documented bound of the fit. A document
    is accepted if its strongest language has a share of at least least, and is one of allowed, by default any.
    Expectation-maximisation ends after rounds rounds, or when no proportion changes by 0.001. A very long text is judged
    as a whole, by how often each bin occurs.
    A null or empty text, or one of under three bytes, has no languages, is "und" and isn't accepted. If no row has both
    a text and a language, all are "und" and accepted, as nothing speaks against them. Ties between languages go to the
    first in alphabetical order. Rows that repeat are judged alike; null ids are judged but not fitted on. The table may
    be empty and have any further columns.
    """
    bounded(docs.sparkSession)
    languages, p = fit(docs, id_col, text_col, lang_col, rows_per_language, least_share, smoothing, seed)
    model = docs.sparkSession.sparkContext.broadcast(p.tobytes())
    judge = F.arrow_udf(_identified(model, languages, allowed, penalty, rounds, least), RESULT)
    return judge(F.coalesce(docs[text_col].cast("string"), F.lit("")))


def language_mixtures(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, language, languages, proportions, accepted) for every row; see identified."""
    found = docs.select(F.col(id_col).alias("doc_id"), identified(docs, id_col, **options).alias("found"))
    return found.select("doc_id", "found.*")


def accepted(docs: DataFrame, **options) -> DataFrame:
    """docs' accepted rows with all their columns; see identified. Texts go to Python, and a verdict each comes back."""
    return docs.where(identified(docs, **options)["accepted"])
