"""Approximate nearest neighbours with balanced posting lists.

A bounded sample of the vectors is clustered, and clusters split until none holds more than twice the intended list; their
centroids are held in memory with a graph of near centroids. A search of that graph gives each vector the centroids within
a ratio of the nearest one's distance: the nearest few within one ratio hold the vector (boundary vectors are in several
lists), all within the other are read when the vector is a query. That one is learned from the vectors: a sample's true
neighbours are found by a scan, and the ratio is raised until the wanted share of them lies in the lists that the sample
reads. Every vector is indexed; cosine similarity ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Sampled vectors that one task splits into lists.
GROUP = 16_384
#: Similarities are compared in these units, so that block shapes can't change an order.
UNITS = 1_000_000
DEGREE = 24
#: So many centroids at most are all compared, which is quicker than to search the graph.
COMPARED = 2_048
#: Vectors whose true neighbours are found by a scan of all, to learn how far queries must read.
SAMPLE = 256
#: Vectors of the sample to a list at least, when the table is so large that the sample bounds the number of lists.
LEAST_LIST = 8
#: Centroids that are looked at for each vector when it is put into lists.
HOLD = 8


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1)


def lists_of(x: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(np.ascontiguousarray(x).ravel(), kind))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centroids**2).sum(1) / 2
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (x[a : a + 4096] @ centroids.T - half).argmax(1)
    return out


def _means(x: np.ndarray, centroids: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    for _ in range(rounds):
        at = nearest(x, centroids)
        n = np.bincount(at, minlength=len(centroids))
        sums = np.zeros(centroids.shape)
        np.add.at(sums, at, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids).astype(np.float32)
    return centroids, nearest(x, centroids)


def split(x: np.ndarray, size: int) -> np.ndarray:
    """Centroids of lists of about size vectors: k-means, then lists of over twice the size are split again. The last
    number of each row is how many vectors it stands for."""
    if len(x) <= size or (x == x[0]).all():
        return np.c_[x.mean(0, keepdims=True), len(x)].astype(np.float32)
    k = max(2, ceil(len(x) / size))
    centroids, at = _means(x, x[np.linspace(0, len(x) - 1, k).astype(int)].copy(), 6)
    out = []
    for c in range(k):
        own = x[at == c]
        if len(own) > 2 * size and len(own) < len(x):
            out.append(split(own, size))
        elif len(own):
            out.append(np.c_[centroids[c : c + 1], len(own)].astype(np.float32))
    return np.concatenate(out)


class Graph:
    """Centroids, and for each the numbers of its nearest others and of a few far ones."""

    def __init__(self, centroids: np.ndarray, links: np.ndarray, sizes: np.ndarray):
        self.centroids, self.links, self.sizes = centroids, links, sizes
        self.norms = (centroids**2).sum(1)
        self.entries = np.unique(np.linspace(0, len(centroids) - 1, min(len(centroids), 32)).astype(int))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, nearest first; their distances) of each row of q: about the width nearest, by a beam search of the
        graph for all rows at once. Few centroids, or a wide beam, are compared one by one."""
        width = min(width, len(self.centroids))
        if len(self.centroids) <= COMPARED or width * DEGREE >= len(self.centroids):
            far = self.norms - 2 * (q @ self.centroids.T)
            at = np.argpartition(far, width - 1, axis=1)[:, :width] if width < far.shape[1] else np.broadcast_to(np.arange(width), (len(q), width))
            far = np.take_along_axis(far, at, 1)
        else:
            at, far = self._beam(q, 2 * width)  # a beam twice as wide as what is wanted loses little
            best = np.argpartition(far, width - 1, axis=1)[:, :width]
            at, far = np.take_along_axis(at, best, 1), np.take_along_axis(far, best, 1)
        order = np.lexsort((at, far))
        return np.take_along_axis(at, order, 1), np.sqrt(np.maximum(np.take_along_axis(far, order, 1) + (q**2).sum(1)[:, None], 0))

    def _far(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.norms[at] - 2 * np.einsum("qcd,qd->qc", self.centroids[at], q)

    def _beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.broadcast_to(self.entries, (len(q), len(self.entries)))
        far, shut = self._far(q, at), np.ones(at.shape, bool)
        while True:
            if at.shape[1] > width:
                best = np.argpartition(far, width - 1, axis=1)[:, :width]
                at, far, shut = (np.take_along_axis(x, best, 1) for x in (at, far, shut))
            going = np.flatnonzero((shut & np.isfinite(far)).any(1))
            if not len(going):
                return at, far
            own = np.where(shut[going], far[going], np.inf)
            next_ = np.argpartition(own, min(4, width) - 1, axis=1)[:, :4]
            mark = shut[going]
            np.put_along_axis(mark, next_, False, 1)
            shut[going] = mark
            fresh = self.links[np.take_along_axis(at[going], next_, 1)].reshape(len(going), -1)
            both = np.c_[at[going], fresh]
            open_ = np.c_[mark, np.ones(fresh.shape, bool)]
            order = np.lexsort((open_, both))  # of equal ones the one that was expanded comes first and stays
            both, open_ = (np.take_along_axis(x, order, 1) for x in (both, open_))
            known = np.c_[far[going], self._far(q[going], fresh)]
            known = np.take_along_axis(known, order, 1)
            known[:, 1:][both[:, 1:] == both[:, :-1]] = np.inf
            best = np.argpartition(known, width - 1, axis=1)[:, :width]
            grown = np.full((len(q), width), 0), np.full((len(q), width), np.inf, known.dtype), np.zeros((len(q), width), bool)
            for old, x in zip((at, far, shut), grown):
                x[:, : old.shape[1]] = old
            at, far, shut = grown
            at[going], far[going], shut[going] = (np.take_along_axis(x, best, 1) for x in (both, known, open_))


def link(centroids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each of rows the DEGREE nearest other centroids and four spread over all; fewer centroids repeat."""
    n = len(centroids)
    out = np.empty((len(rows), DEGREE + 4), np.int64)
    half = (centroids**2).sum(1) / 2
    for a in range(0, len(rows), 1024):
        part = rows[a : a + 1024]
        d = half - centroids[part] @ centroids.T
        d[np.arange(len(part)), part] = np.inf
        k = min(DEGREE, n)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[a : a + 1024, :DEGREE] = np.resize(near.T, (DEGREE, len(part))).T
        out[a : a + 1024, DEGREE:] = (part[:, None] + (np.arange(1, 5) * n) // 5) % n
    return out


def build(vectors: DataFrame, n: int, dim: int, size: int, stands_for: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, links, sizes) of lists of about size of the n vectors (id, v), each of which stands for so many."""
    spark = vectors.sparkSession
    tops = ceil(n / GROUP)
    centroids = np.zeros((1, dim), np.float32)
    if tops > 1:
        seeds = vectors.orderBy(F.xxhash64("id"), "id").limit(tops).select("v").toArrow()
        centroids = matrix(seeds.column("v")).copy()
        for _ in range(4):
            shared = spark.sparkContext.broadcast(centroids)

            def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                total = np.zeros((len(shared.value), dim + 1))
                for batch in batches:
                    x = matrix(batch.column(0))
                    np.add.at(total, nearest(x, shared.value), np.c_[x, np.ones(len(x))])
                c, d = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(total[c, d])], ["c", "d", "x"])

            rows = vectors.select("v").mapInArrow(sums, "c long, d long, x double").groupBy("c", "d").agg(F.sum("x").alias("x")).toPandas()
            total = np.zeros((tops, dim + 1))
            total[rows["c"].to_numpy(), rows["d"].to_numpy()] = rows["x"]
            used = total[:, dim] > 0
            centroids[used] = total[used, :dim] / total[used, dim:]
    shared = spark.sparkContext.broadcast(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(matrix(batch.column(1)), shared.value))], ["id", "v", "top"])

    def divide(table: pa.Table) -> pa.Table:
        found = split(matrix(table.sort_by("id").column("v")), size)
        return pa.table({"c": lists_of(found, pa.float32())})

    tops_placed = vectors.mapInArrow(place, "id long, v array<float>, top long")
    lists = written(tops_placed.groupBy("top").applyInArrow(divide, "c array<float>"), "centroids")
    found = matrix(lists.toArrow().column("c"))
    found = found[np.lexsort(found.T)]
    found, sizes = np.ascontiguousarray(found[:, :dim]), found[:, dim] * stands_for
    everything = spark.sparkContext.broadcast(found)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), lists_of(link(everything.value, rows))], ["id", "links"])

    linked = spark.range(len(found)).mapInArrow(links, "id long, links array<long>").toArrow().sort_by("id")
    return found, linked.column("links").combine_chunks().flatten().to_numpy().reshape(len(found), -1), sizes


def _top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, number) of each row's k largest, ties to the first columns."""
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    low = np.take_along_axis(sims, part, 1).min(1)
    for i in np.flatnonzero((sims >= low[:, None]).sum(1) > k):
        part[i] = np.argsort(-sims[i], kind="stable")[:k]
    part.sort(axis=1)
    order = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1), np.take_along_axis(np.take_along_axis(sims, part, 1), order, 1)


def _scan(k: int):
    """The k nearest entries of a list to each query that reads it: (id, near, far)."""

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not entries.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("id", "near", "far")})
        entries = entries.sort_by("entry")
        ids, x = entries.column("entry").to_numpy(), matrix(entries.column("vector"))
        out = []
        for a in range(0, queries.num_rows, 2048):
            part = queries.slice(a, 2048)
            own = part.column("id").to_numpy()
            sims = np.rint(matrix(part.column("v")) @ x.T * UNITS).astype(np.int32)
            at = np.searchsorted(ids, own)
            self_ = np.flatnonzero((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == own))
            sims[self_, at[self_]] = np.iinfo(np.int32).min + 1
            top, best = _top(sims, k)
            near, own = ids[top], np.repeat(own, top.shape[1]).reshape(top.shape)
            real = near != own
            out.append(pa.table({"id": own[real], "near": near[real], "far": -best[real].astype(np.int64)}))
        return pa.concat_tables(out)

    return run


def reads(d: np.ndarray, sizes: np.ndarray, step: int, ratio: float, least: int) -> np.ndarray:
    """How many lists each query reads at a step of effort, d being the lists' distances, nearest first: a higher ratio,
    and lists that hold more than least vectors."""
    enough = (np.cumsum(sizes, axis=1) < least * 1.5**step).sum(1) + 1
    return np.minimum(np.maximum(enough, (d <= ratio * 1.03**step * d[:, :1] + 1e-6).sum(1)), d.shape[1])


def holds(graph: Graph, x: np.ndarray, replicas: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(lists, whether they hold the vector): the nearest list, and up to replicas of those within the ratio."""
    at, d = graph.search(x, max(HOLD, replicas))
    return at[:, :replicas], d[:, :replicas] <= ratio * d[:, :1] + 1e-6


def true_neighbours(vectors: DataFrame, sample: pa.Table, k: int) -> DataFrame:
    """(q, near): by a scan of all vectors (id, v), the ids of the k nearest to each vector of the sample."""
    shared = vectors.sparkSession.sparkContext.broadcast((sample.column("id").to_numpy(), matrix(sample.column("v"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        ids, best = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0), np.float32)
        for batch in batches:
            fresh = batch.column(0).to_numpy()
            sims = q @ matrix(batch.column(1)).T
            sims[own[:, None] == fresh] = -np.inf
            ids, best = np.c_[ids, np.broadcast_to(fresh, sims.shape)], np.c_[best, sims]
            if best.shape[1] > k:
                top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                ids, best = np.take_along_axis(ids, top, 1), np.take_along_axis(best, top, 1)
        row, at = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids[row, at]), pa.array(best[row, at])], ["q", "near", "sim"])

    found = vectors.mapInArrow(scan, "q long, near long, sim float")
    best = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "near")), asc=False), 1, k).alias("top"))
    return best.select("q", F.explode("top.near").alias("near"))


def calibrated(vectors: DataFrame, built: tuple, k: int, recall: float, replicas: int, replica_ratio: float, query_ratio: float, least: int) -> tuple[int, int]:
    """(step, width): the least step at which a sample's queries read lists that hold the share recall of their true
    neighbours, and how many lists the widest of them reads then."""
    sample = vectors.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE).toArrow()
    pairs = written(true_neighbours(vectors, sample, k), "true")
    near = vectors.join(F.broadcast(pairs), F.col("id") == F.col("near")).select("q", "v").toArrow()  # SAMPLE x k vectors
    graph, q = Graph(*built), matrix(sample.column("v"))
    at, d = graph.search(q, len(graph.centroids))
    place = np.empty_like(at)
    np.put_along_axis(place, at, np.broadcast_to(np.arange(at.shape[1]), at.shape), 1)
    order = np.argsort(sample.column("id").to_numpy())
    of = order[np.searchsorted(sample.column("id").to_numpy()[order], near.column("q").to_numpy())]
    lists, held = holds(graph, matrix(near.column("v")), replicas, replica_ratio)
    need = np.where(held, place[of[:, None], lists], at.shape[1]).min(1)
    sizes, step = graph.sizes[at], 0
    while True:
        n = reads(d, sizes, step, query_ratio, least)
        if (need < n[of]).mean() >= recall or (n == at.shape[1]).all():
            return step, int(n.max())
        step += 1


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, queries: Callable[[Column], Column] | None = None, k: int = 10, list_size: int = 256, replicas: int = 2, replica_ratio: float = 1.1, query_ratio: float = 1.1, recall: float = 0.95, fit_rows: int = 200_000) -> DataFrame:
    """(vec_id, rank, neighbor_id, similarity): the k nearest of all others by cosine to each query, ranks from 1.

    queries: a condition on the id, by default true of every vector. The lists are fitted on a hash sample of about
    fit_rows vectors, the documented bound of the fit (fewer if these exceed 128 MB); so there are at most fit_rows / 8
    of them, and in a larger table they get longer. query_ratio is where reading starts; it is raised until a sample's
    queries find the share recall of their neighbours. Every vector is in its nearest list, and in up to replicas lists.

    A null id, a null or empty vector, one with a null or a number that isn't finite, or one whose length isn't the
    commonest (of two equally common the shorter) is left out. A zero vector has similarity 0 to all. Of rows that repeat
    an id the greatest vector counts. Ties in similarity, compared to six decimals, go to the smallest id. Fewer than
    k + 1 vectors give fewer neighbours, one vector or none gives no rows. Ids are whole numbers. Extra columns are ignored.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    raw = raw.where("id is not null and v is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    dims = raw.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = raw.sparkSession.createDataFrame([], "vec_id long, rank int, neighbor_id long, similarity double")
    if dims is None:
        return empty
    dim = dims[0]
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = raw.where(F.size("v") == dim).groupBy("id").agg(F.max("v").alias("v")).withColumn("norm", norm)
    unit = unit.select("id", F.when(F.col("norm") > 0, F.transform("v", lambda x: (x / F.col("norm")).cast("float"))).otherwise(F.col("v")).alias("v"))
    unit = written(unit, "unit")
    n = unit.count()
    if n < 2:
        return empty
    most = min(fit_rows, (128 << 20) // (4 * dim))
    sample, rows = unit, n
    if n > most:
        sample = written(unit.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 40)) < int((1 << 40) * most / n)), "fit")
        rows = sample.count()
    size = max(LEAST_LIST if rows < n else 1, round(list_size * rows / n))
    built, least = build(sample, rows, dim, size, n / rows), 4 * (k + 1)
    step, width = calibrated(unit, built, k, recall, replicas, replica_ratio, query_ratio, least)
    shared = unit.sparkSession.sparkContext.broadcast(built)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                lists, held = holds(graph, matrix(part.column(1)), replicas, replica_ratio)
                row, at = np.nonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array(lists[row, at]), *(c.take(pa.array(row)) for c in part.columns)], ["of_list", "entry", "vector"])

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value[0]), np.int64)
        for batch in placed(batches):
            total += np.bincount(batch.column(0).to_numpy(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["of_list", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                at, d = graph.search(matrix(part.column(1)), width + width // 4)
                which = np.arange(at.shape[1]) < reads(d, graph.sizes[at], step, query_ratio, least)[:, None]
                row, col = np.nonzero(which)
                yield pa.RecordBatch.from_arrays([pa.array(at[row, col]), *(c.take(pa.array(row)) for c in part.columns)], ["list", "id", "v"])

    # A list that stays long, as of vectors that are all alike, is read in pieces by several tasks.
    pieces = unit.mapInArrow(sized, "of_list long, n long").groupBy("of_list").agg(F.ceil(F.sum("n") / (16 * list_size)).cast("long").alias("pieces")).where("pieces > 1")
    pieces = F.broadcast(written(pieces.withColumnRenamed("of_list", "list"), "pieces"))  # at most one row a list
    entries = unit.mapInArrow(placed, "of_list long, entry long, vector array<float>").join(pieces, F.col("of_list") == F.col("list"), "left")
    entries = entries.select("of_list", F.pmod(F.xxhash64("entry"), F.coalesce("pieces", F.lit(1))).alias("of_piece"), "entry", "vector")
    asked = (unit.where(queries(F.col("id"))) if queries else unit).mapInArrow(read, "list long, id long, v array<float>").join(pieces, "list", "left")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"), "id", "v")
    found = entries.groupBy("of_list", "of_piece").cogroup(asked.groupBy("list", "piece")).applyInArrow(_scan(k), "id long, near long, far long")
    # A vector that several lists hold counts once, with its greatest similarity: products differ with the block's shape.
    best = found.groupBy("id", "near").agg(F.min("far").alias("far"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("far", "near"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("vec_id"), "rank", F.col("near").alias("neighbor_id"), (-F.col("far") / UNITS).alias("similarity"))
