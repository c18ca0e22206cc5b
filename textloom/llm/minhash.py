"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Signature: a first permutation sigma scatters the hashed shingle universe; coordinate k of the signature is the minimum
of a second permutation pi, circularly shifted by k, over the scattered shingles. Two permutations serve all coordinates.

A node is a text: the first row that has its words. Classes are the connected components of "Jaccard of the two shingle
sets >= threshold" over all pairs of nodes that share a band:
 1. rows with the same words collapse to one node;
 2. each node is verified against the first node of the bands it shares, the one it shares most bands with first;
 3. in bands that still hold several classes all pairs across classes are verified, by blocks of at most 2 x 256 nodes.
So a band of thousands of copies costs a pair a member, yet no candidate is dropped: a pair is skipped only when both
ends are already known to be in one class.
 4. within a class every pair of nodes is compared, by blocks of about 512, and its links are counted, not written out.
Every link of two different texts lies within a class, so none is lost, those of pairs that share no band included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, U64, bounded, if_small, mix, shingles, text_slices, written

#: log2 of the hashed shingle universe that sigma and pi permute.
UNIVERSE_BITS = 22
#: Nodes that one task compares with each other, and members of a band that one row pairs.
BLOCK_NODES, BAND_NODES = 512, 256
#: Up to so many edges components are found in the driver, in some 50 MB; beyond that by joins, with the same result.
LOCAL_EDGES = 500_000
_tables: dict[tuple[int, int], np.ndarray] = {}


def _scattered(h: np.ndarray) -> np.ndarray:
    """sigma: a permutation of the universe's numbers, by steps that each have an inverse; no table is kept."""
    mask, half = np.uint32((1 << UNIVERSE_BITS) - 1), np.uint32(UNIVERSE_BITS // 2)
    x = (h & U64(mask)).astype(np.uint32)
    for odd in (0x2C1B3C6D, 0x297A2D39):
        x = (x * np.uint32(odd)) & mask
        x ^= x >> half
    return x


def _shifts(coordinates: int, seed: int) -> np.ndarray:
    """A view of pi by its circular shifts: row x holds pi at x, x + 1, ... for all coordinates."""
    if (coordinates, seed) not in _tables:
        pi = np.random.default_rng(seed).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        _tables[coordinates, seed] = np.lib.stride_tricks.sliding_window_view(np.r_[pi, pi[:coordinates]], coordinates)
    return _tables[coordinates, seed]


def signatures(data: np.ndarray, offsets: np.ndarray, k: int, coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers that have shingles, their signatures, all rows' keys)."""
    shifted = _shifts(coordinates, seed)
    h, row, key = shingles(data, offsets, k)
    at = _scattered(h)
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    end = np.r_[start[1:], len(row)]
    found = np.empty((len(start), coordinates), np.uint32)
    for i, (a, b) in enumerate(zip(start, end)):
        low = shifted[at[a : a + 4096]].min(axis=0) if b - a > 4096 else shifted[at[a:b]].min(axis=0)
        for c in range(a + 4096, b, 4096):  # long texts in pieces: memory stays bounded, the minimum is over all
            np.minimum(low, shifted[at[c : min(b, c + 4096)]].min(axis=0), out=low)
        found[i] = low
    return row[start], found, key


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    n, coordinates = signature.shape
    rows = coordinates // bands
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    cut = signature[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    for r in range(rows):
        out = mix(out * U64(3) + cut[:, :, r])
    return out.view(np.int64)


def _sign(k: int, coordinates: int, bands: int, seed: int):
    """(row, id, hash, text) -> (row, id, hash, key, bins) of the rows that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(3)):
                rows, found, key = signatures(data, offsets, k, coordinates, seed)
                if len(rows):
                    keys = pa.array([x.tobytes() for x in key[rows]], pa.binary())
                    lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * bands, pa.array(band_hashes(found, bands).ravel()))
                    own = [batch.column(i).slice(a, b - a).take(pa.array(rows)) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([*own, keys, lists], ["row", "id", "hash", "key", "bins"])

    return run


def _sets(k: int):
    """(key, node, mates, leads, text) -> (node, mates, leads, shingles) of the rows whose text has the words of key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(4)):
                h, row, key = shingles(data, offsets, k)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                keep = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
                h, row = h[keep], row[keep]
                ends = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))
                same = pa.array([x.tobytes() == y for x, y in zip(key, batch.column(0).slice(a, b - a).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (1, 2, 3)), lists], ["node", "mates", "leads", "shingles"]).filter(same)

    return run


class Verifier:
    """Exact Jaccard of pairs of nodes; keeps the shingle sets that it has made for the count of links."""

    def __init__(self, docs: DataFrame, signed: DataFrame, repeated: DataFrame | None, k: int, threshold: float):
        self.docs, self.signed, self.repeated, self.k, self.threshold, self.sets = docs, signed, repeated, k, threshold, []

    def links(self, pairs: DataFrame, n_pairs: int) -> DataFrame:
        """The pairs (a, b) of nodes that reach the threshold. Only texts in a pair are read again; each one's shingle
        set moves once a pair, to the pair's a."""
        need = (
            pairs.select(F.col("b").alias("node"), F.col("a").alias("mate"), F.lit(False).alias("lead"))
            .unionAll(pairs.select(F.col("a"), F.lit(None).cast("long"), F.lit(True)))
            .groupBy("node")
            .agg(F.collect_set("mate").alias("mates"), F.max("lead").alias("leads"))
        )
        of = self.signed.select(F.col("row").alias("node"), F.col("id").alias("own_id"), F.col("hash").alias("own_hash"), "key")
        need = written(of.join(if_small(need, 2 * n_pairs), "node"), "need")
        n, docs = need.count(), self.docs
        if 100_000 < n <= BROADCAST_ROWS:  # too much to broadcast whole: only texts whose hash is wanted move to the join
            docs = docs.join(F.broadcast(need.select(F.col("own_hash").alias("hash")).distinct()), "hash", "left_semi")
        found = docs.join(if_small(need, n, 100_000), F.col("hash").eqNullSafe(F.col("own_hash")) & F.col("id").eqNullSafe(F.col("own_id")))
        columns = ["key", "node", "mates", "leads", "text"]
        if self.repeated is None:
            found = found.select(*columns)
        else:  # of rows that repeat id and text one is enough
            again = found.join(self.repeated.select(F.col("hash").alias("r_hash"), F.col("id").alias("r_id")), F.col("hash").eqNullSafe(F.col("r_hash")) & F.col("id").eqNullSafe(F.col("r_id")), "left")
            once = again.where("r_hash is not null").groupBy("node").agg(*(F.min(c).alias(c) for c in columns if c != "node")).select(*columns)
            found = again.where("r_hash is null").select(*columns).unionAll(once)
        sets = written(found.mapInArrow(_sets(self.k), "node long, mates array<long>, leads boolean, shingles array<long>"), "sets")
        self.sets.append(sets.select("node", "shingles"))
        left = sets.select(F.explode("mates").alias("a"), F.col("node").alias("b"), F.col("shingles").alias("right"))
        right = sets.where("leads").select(F.col("node").alias("lead"), F.col("shingles").alias("left"))
        shared = F.size(F.array_intersect("left", "right"))
        scored = left.join(right, F.col("a") == F.col("lead")).withColumn("shared", shared)
        jaccard = F.col("shared") / (F.size("left") + F.size("right") - F.col("shared"))
        return written(scored.where(jaccard >= self.threshold).select("a", "b").distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): each id of edges (a, b) with the smallest id of its component, by alternating large and small stars."""
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if (n := now.count()) <= LOCAL_EDGES:
        return _components(now, n)
    state = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.select(F.col("m").alias("a"), "b").unionAll(joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        now = written(small, "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state or not seen[0]:
            return now.select(F.col("b").alias("id"), F.col("a").alias("root")).unionAll(now.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
        state = seen


def _components(edges: DataFrame, n: int) -> DataFrame:
    """components of n edges in the driver: smallest labels along the edges, then along the labels, until none changes."""
    spark = edges.sparkSession
    if not n:
        return spark.createDataFrame([], "id long, root long")
    table = edges.toArrow()
    ids, at = np.unique(np.r_[table.column("a").to_numpy(), table.column("b").to_numpy()], return_inverse=True)
    a, b = at[:n], at[n:]
    label = np.arange(len(ids))
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != (up := label[label])).any():
            label = up
    return spark.createDataFrame(pa.table({"id": ids, "root": ids[label]}))


def _counted(threshold: float):
    """Links of each node of a block, or of a pair of a class' blocks, to the others: (node, links), copies counted."""

    def tally(nodes: np.ndarray, part: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], across: bool) -> np.ndarray:
        n, size = len(nodes), np.array([len(s) for s in sets])
        at = np.repeat(np.arange(n), size)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(column)
        order = np.argsort(column, kind="stable")
        column, at = column[order], at[order]
        keep = often[column] > 1
        column, at = column[keep], at[keep]
        column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
        shared = np.zeros((n, n), np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, [first, first + 4096])
            x = np.zeros((n, 4096), np.float32)
            x[at[a:b], column[a:b] - first] = 1
            shared += x @ x.T
        shared = shared.astype(np.float64)
        near = shared / (size[:, None] + size[None, :] - shared) >= threshold
        near[np.arange(n), np.arange(n)] = False
        if across:
            near &= part[:, None] != part[None, :]
        return near @ copies

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        _, first = np.unique(node, return_index=True)
        table = table.take(pa.array(first)).sort_by("root")
        node, root, part, copies = (table.column(c).to_numpy() for c in ("node", "root", "part", "copies"))
        across = bool(table.num_rows) and table.column("i")[0].as_py() != table.column("j")[0].as_py()
        sets = [x.values.to_numpy() for x in table.column("shingles")]
        links = np.zeros(len(node), np.int64)
        cuts = np.flatnonzero(np.r_[True, root[1:] != root[:-1], True]) if len(node) else []
        for a, b in zip(cuts, cuts[1:]):
            links[a:b] = tally(node[a:b], part[a:b], copies[a:b], sets[a:b], across)
        return pa.table({"node": node, "links": links})

    return run


def _links(sets: list[DataFrame], members: DataFrame, threshold: float) -> DataFrame:
    """(node, links) of the nodes of members (node, root, copies), each root's compared with each other. Classes of up to
    BLOCK_NODES nodes are bundled; larger ones are cut into parts, and each pair of parts is a task's group."""
    sizes = members.groupBy("root").agg(F.count("*").alias("m")).withColumn("parts", F.ceil(F.col("m") / BLOCK_NODES).cast("int"))
    bundles = max(1, members.count() // BLOCK_NODES)
    placed = members.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = placed.withColumn("other", other).select(
        "node", "root", "copies", "part", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.col("root")).alias("bundle"),
        F.when(F.col("parts") == 1, -1).otherwise(F.least("part", "other")).alias("i"), F.when(F.col("parts") == 1, -1).otherwise(F.greatest("part", "other")).alias("j"),
    )
    every = sets[0]
    for more in sets[1:]:
        every = every.unionAll(more)
    grouped = every.join(placed, "node").groupBy("bundle", "i", "j").applyInArrow(_counted(threshold), "node long, links long")
    return grouped.groupBy("node").agg(F.sum("links").alias("links"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends aren't yet in one class."""
    of = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _across(members: DataFrame, roots: DataFrame) -> DataFrame:
    """All pairs of a band's members (bin, row) that aren't yet in one class, formed by pairs of parts of the band."""
    of = roots.select(F.col("id").alias("row"), "root")
    member = members.select("bin", "row").join(of, "row", "left").select("bin", "row", F.coalesce("root", "row").alias("root"))
    mixed = member.groupBy("bin").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high")
    member = written(member.join(mixed.select("bin", F.ceil(F.col("n") / BAND_NODES).cast("int").alias("parts")), "bin"), "mixed")
    member = member.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    it = F.struct(F.col("row").alias("m"), F.col("root").alias("r"), F.col("part").alias("p"))
    rows = member.groupBy("bin", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list(it).alias("its"))
    pair = rows.select("i", "j", "its", F.explode("its").alias("x")).select("i", "j", "x", F.explode("its").alias("y"))
    pair = pair.where("x.m < y.m and x.r <> y.r and (i = j or x.p <> y.p)")
    return pair.select(F.col("x.m").alias("a"), F.col("y.m").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str, text_col: str, merge_ids: bool, count_links: bool, *, k: int = 2, threshold: float = 0.5, bands: int = 75, rows: int = 5, seed: int = 7) -> tuple[DataFrame, DataFrame | None]:
    """(classes, repeated): (row, id, hash, root[, links]) of each row in a class of two texts or rows and more, hash being
    xxhash64 of the text; and (id, hash, row) of rows that repeat an id and text, if there are any, row the first of them.
    """
    bounded(docs.sparkSession)
    text = F.col(text_col).cast("string")
    data = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")).where("text is not null")
    numbered = data.select(F.monotonically_increasing_id().alias("row"), "id", "hash", "text")
    kind = dict(numbered.dtypes)["id"]
    signed = written(numbered.mapInArrow(_sign(k, bands * rows, bands, seed), f"row long, id {kind}, hash long, key binary, bins array<long>"), "signatures")

    again = written(signed.groupBy("id", "hash", "key").agg(F.min("row").alias("row"), F.count("*").alias("n")).where("n > 1").select("id", "hash", "key", "row"), "repeated")
    repeats = again.count()
    if repeats:  # each id and text once
        first = again.select(F.col("id").alias("r_id"), F.col("hash").alias("r_hash"), F.col("key").alias("r_key"), F.col("row").alias("first"))
        of = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("hash") == F.col("r_hash")) & (F.col("key") == F.col("r_key"))
        signed = written(signed.join(if_small(first, repeats), of, "left").where("first is null or first = row").select(*signed.columns), "signatures")
    repeated = again.select("id", "hash", "row") if repeats else None

    copies = written(signed.groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    n_copied = copies.count()
    same = written(signed.select("row", "key").join(if_small(copies, n_copied, 100_000), "key").where("row <> node").select("row", "node"), "same")
    n_same = same.count()
    nodes = signed.join(if_small(same.select("row"), n_same), "row", "left_anti")

    each = nodes.select("row", F.explode("bins").alias("bin"))
    leads = each.groupBy("bin").agg(F.min("row").alias("lead"), F.count("*").alias("n")).where("n > 1").select("bin", "lead")
    members = written(each.join(leads.hint("shuffle_hash"), "bin"), "members")
    stars = members.where("row <> lead").groupBy(F.col("lead").alias("a"), F.col("row").alias("b")).agg(F.count("*").alias("shared"))
    stars = written(stars, "stars")
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    tried = written(best.select("a", "b"), "pairs")
    verifier = Verifier(data, signed, repeated, k, threshold)
    edges = verifier.links(tried, tried.count())
    roots = written(components(edges), "roots")

    left = stars.select("a", "b").join(tried, ["a", "b"], "left_anti")
    for candidates in (lambda: _apart(left, roots), lambda: _across(members, roots)):
        more = written(candidates().join(tried, ["a", "b"], "left_anti"), "pairs")
        if n := more.count():
            found = verifier.links(more, n)
            tried = tried.unionAll(more)
            edges = edges.unionAll(found)
            roots = written(components(edges), "roots")

    within = roots.select(F.col("id").alias("node"), "root").join(copies.select("node", "copies"), "node", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    within = written(within, "within")
    own = copies.select("node", "copies").join(within.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), "copies")
    every = within.select("node", "root", "copies").unionAll(own)
    if count_links:
        every = every.join(_links(verifier.sets, within, threshold), "node", "left")
        every = every.select("node", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    every = written(every, "nodes")
    tail = ["links"] if count_links else []
    placed = every.select(F.col("node").alias("row"), "root", *tail).unionAll(same.join(every, "node").select("row", "root", *tail))
    if merge_ids:
        twice = signed.where("id is not null").groupBy("id").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low <> high")
        twice = written(signed.select("id", "row").join(twice.select("id", "low"), "id").where("row <> low").select("low", "row"), "ids")
        if twice.count():  # texts of one id are in one class: join the classes that hold them
            root_of = placed.select(F.col("row").alias("r"), "root")
            ends = twice.join(root_of.toDF("low", "root_a"), "low", "left").join(root_of.toDF("row", "root_b"), "row", "left")
            joined = written(ends.select(F.coalesce("root_a", "low").alias("a"), F.coalesce("root_b", "row").alias("b")), "ends")
            merged = written(components(joined), "merged")
            alone = joined.select(F.explode(F.array("a", "b")).alias("row")).distinct().join(placed.select("row"), "row", "left_anti")
            placed = placed.unionAll(alone.select("row", F.col("row").alias("root"), *(F.lit(0).cast("long").alias(c) for c in tail)))
            placed = placed.join(merged.toDF("old", "new"), F.col("root") == F.col("old"), "left").select("row", F.coalesce("new", "root").alias("root"), *tail)
    return written(signed.select("row", "id", "hash").join(placed, "row"), "classes"), repeated


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, class_id, links): each document that near-duplicates another, the smallest id of its class, and how many
    other documents it near-duplicates itself, copies included. A document in no row is a class of its own, without links.

    k: words in a shingle (2); threshold: of Jaccard (0.5); bands x rows (75 x 5): signature coordinates. At the defaults a
    pair of Jaccard 0.5 shares a band with probability 0.908, and one of 0.6 with 0.998.
    Words are runs of bytes above 0x20, ASCII letters lowered. A null, empty or blank text is nobody's duplicate. A null
    id is left out. Each text of an id that repeats is compared for itself, its classes are one and its links are summed;
    rows that repeat id and text count once. Texts of fewer than k words count as one shingle. A very long text is hashed
    in pieces and compared as a whole. Ties go to the smallest id; the table may be empty and have any further columns.
    """
    found, _ = classes(docs.where(F.col(id_col).isNotNull()), id_col, text_col, True, True, **options)
    least = found.groupBy("root").agg(F.min("id").alias("class_id"), F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    return found.join(least, "root").groupBy(F.col("id").alias("doc_id"), "class_id").agg(F.sum("links").alias("links"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without all rows of each class of near-duplicate texts but the one of the smallest id; see near_duplicates.

    Here rows are told apart, not ids: of rows that repeat an id with texts that differ each stays unless its text goes, of
    those that repeat id and text one stays, and rows with a null id take part, but stay only where no other can.
    """
    found, repeated = classes(docs, id_col, text_col, False, False, **options)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")).select("root", F.col("best.row").alias("best"))
    gone = written(found.join(best, "root").where("row <> best").select(F.col("id").alias("__id"), F.col("hash").alias("__hash")), "gone")
    same = (F.xxhash64(docs[text_col].cast("string")) == F.col("__hash")) & docs[id_col].eqNullSafe(F.col("__id"))
    kept = docs.join(if_small(gone, gone.count()), same, "left_anti")
    if repeated is None:
        return kept
    twice = repeated.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"))
    once = kept.join(twice, same, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(twice, same, "left_anti").unionAll(once)
