"""Packing documents into bins of fixed length: best fit, then swap-based local search.

The search takes the emptiest bin and pushes its content into the other bins with room by moving a piece, or by
exchanging one for one or two for one, always so that the fuller bin gains and the sum of squared fills grows, until the
bin is empty or no exchange is left. Every bin with room is
tried in turn; the search ends at the lower bound of bins, or when a pass over all bins has emptied none. Groups of about group_items pieces are packed apart, so the work grows in
proportion; what their last, underfull bins hold is pooled over 64 groups and packed again, level by level.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LEVEL = 64
MOST_PARTITIONS = 2_000


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the bin with the least room that holds it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([i])
            free, b = capacity - size, len(bins) - 1
        else:
            free, b = room.pop(at)
            bins[b].append(i)
            free -= size
        if free:
            insort(room, (free, b))
    return bins


class Search:
    """Bins as flat arrays: each item's bin, and of each bin its fill and the sums of two of its lengths.

    Items of a bin that are equally long stand for each other in these sums, so a bin of capacity c has c sums at most."""

    def __init__(self, bins: list[list[int]], size: np.ndarray, capacity: int):
        self.size, self.capacity = size, capacity
        self.items = [list(b) for b in bins]
        self.bin_of = np.empty(len(size), np.int64)
        for n, b in enumerate(self.items):
            self.bin_of[b] = n
        self.fill = np.bincount(self.bin_of, size, len(bins)).astype(np.int64)
        self.version = np.zeros(len(bins), np.int64)
        self.pairs = np.zeros((5, 0), np.int64)  # sum, item, item, bin, version
        self._enter(range(len(bins)))

    def _enter(self, bins) -> None:
        fresh = []
        for n in bins:
            own = np.array(self.items[n], np.int64)
            one, first, times = np.unique(self.size[own], return_index=True, return_counts=True)
            a, b = np.triu_indices(len(one), 1)
            x, y = own[first[a]], own[first[b]]
            for i in np.flatnonzero(times > 1).tolist():  # two of one length
                twice = own[self.size[own] == one[i]][:2]
                x, y = np.r_[x, twice[0]], np.r_[y, twice[1]]
            fresh.append(np.stack([self.size[x] + self.size[y], x, y, np.full(len(x), n), np.full(len(x), self.version[n])]))
        kept = self.pairs
        if kept.shape[1] > 2 * len(self.size) + 1000 and (stale := kept[4] != self.version[kept[3]]).mean() > 0.5:
            kept = kept[:, ~stale]
        self.pairs = np.concatenate([kept, *fresh], axis=1)

    def best(self, source: int) -> tuple[int, int, list[int], list[int]]:
        """(gain, target, given, returned) of the exchange that adds most to a bin as full as source or fuller: a move, one
        for one, two for one or one for two, the first of these among equals; gain 0 if there is none."""
        size, free = self.size, self.capacity - self.fill
        fits = (self.fill >= self.fill[source]) & (free > 0)
        fits[source] = False
        best: tuple[int, int, list[int], list[int]] = (0, -1, [], [])
        own = np.array(self.items[source])
        own = own[np.argsort(size[own], kind="stable")]
        pairs = self.pairs[:, self.pairs[4] == self.version[self.pairs[3]]]
        two = pairs[:, pairs[3] == source]
        two = two[:, np.argsort(two[0], kind="stable")]
        bins = np.flatnonzero(fits)
        singles = np.flatnonzero(fits[self.bin_of])
        pairs = pairs[:, fits[pairs[3]]]
        for give, loss, of, kind in ((size[own], np.zeros(len(bins), np.int64), bins, "10"), (size[own], size[singles], self.bin_of[singles], "11"), (two[0], size[singles], self.bin_of[singles], "21"), (size[own], pairs[0], pairs[3], "12")):
            if not len(give) or not len(loss):
                continue
            at = np.searchsorted(give, loss + free[of], "right") - 1
            gain = np.where(at >= 0, give[at] - loss, 0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                given = [int(own[at[i]])] if kind[0] == "1" else two[1:3, at[i]].tolist()
                returned = {"0": [], "1": [int(singles[i])] if kind[1] == "1" else [], "2": pairs[1:3, i].tolist() if kind[1] == "2" else []}[kind[1]]
                best = int(gain[i]), int(of[i]), given, returned
        return best

    def apply(self, source: int, gain: int, target: int, given: list[int], returned: list[int]) -> None:
        for n, out, into in ((source, given, returned), (target, returned, given)):
            self.items[n] = [x for x in self.items[n] if x not in out] + into
            self.bin_of[into] = n
            self.version[n] += 1
        self.fill[source] -= gain
        self.fill[target] += gain
        self._enter((source, target))


def local_search(bins: list[list[int]], size: np.ndarray, capacity: int) -> list[list[int]]:
    """Empties as many bins as it can. In a pass every bin with room, from the emptiest, pushes its content into the others
    until it is empty or no exchange is left; passes end at the lower bound, or after one that emptied no bin."""
    bins = [b for b in bins if b]
    least = ceil(int(size[[i for b in bins for i in b]].sum()) / capacity) if bins else 0
    left = len(bins)
    if left <= least:
        return bins
    search = Search(bins, size, capacity)
    before = left + 1
    while least < left < before:
        before = left
        for source in np.argsort(search.fill, kind="stable").tolist():
            while search.items[source] and search.fill[source] < capacity and (found := search.best(source))[0]:
                search.apply(source, *found)
            left = sum(1 for b in search.items if b)
            if left <= least:
                break
    return [b for b in search.items if b]


def _pack(capacity: int, level: int, last: bool, full: float):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py() if table.num_rows else 0
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        size = table.column("length").to_numpy()
        bins = local_search(best_fit(size, capacity), size, capacity)
        name = np.empty(len(size), object)
        open_ = np.zeros(len(size), bool)
        for n, b in enumerate(bins):
            name[b] = f"{level}-{group}-{n}"
            open_[b] = not last and size[b].sum() < full * capacity
        return pa.table({"group": table.column("group"), "id": table.column("id"), "piece": table.column("piece"), "length": table.column("length"), "bin": pa.array(name, pa.string()), "open": pa.array(open_)})

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 16_384, length: Column | None = None, group_items: int = 4_096, full: float = 0.98) -> DataFrame:
    """(bin_id, doc_id, piece, start, length): every document's pieces and their bins.

    length: of a document in tokens, by default the UTF-8 bytes of its text, the tokens of a byte-level model; one more
    is taken for the separator. A document longer than capacity is cut into pieces of that length and a rest.
    A null or empty text takes the separator alone, so every row is in some bin, rows with a null id or that repeat one
    included; such pieces of equal length stand for each other in the search. Ties in length go by id. An empty table gives
    no bins. Ids keep their type. Extra columns are ignored.

    Groups of about group_items pieces are packed by one task each, and bins filled to the share full of capacity or more
    are done then; what the others hold is packed again over LEVEL groups at once, until one group is left.
    """
    size = F.coalesce(length if length is not None else F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + 1
    items = docs.select(F.col(id_col).alias("id"), size.alias("size"))
    items = items.select("id", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {capacity}"))).alias("piece", "k"))
    items = items.select("id", "piece", F.least(F.lit(capacity), F.col("size") - F.col("k") * capacity).cast("long").alias("length"))
    items = written(items, "pieces")
    groups = max(1, ceil(items.count() / group_items))
    schema = f"group long, id {dict(items.dtypes)['id']}, piece int, length long, bin string, open boolean"
    pool = items.select(F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("length")), "piece"), F.lit(groups)).alias("group"), "id", "piece", "length")
    level, done = 0, []
    while True:
        # As many partitions as groups, within reason: by bytes, which are few, all groups would end up in a task or two.
        pool = pool.repartition(min(groups, MOST_PARTITIONS), "group")
        packed = written(pool.groupBy("group").applyInArrow(_pack(capacity, level, groups == 1, full), schema), "packed")
        done.append(packed.where("not open"))
        if groups == 1:
            break
        pool = packed.where("open").select(F.expr(f"group div {LEVEL}").alias("group"), "id", "piece", "length")
        groups, level = ceil(groups / LEVEL), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.select(F.col("bin").alias("bin_id"), F.col("id").alias("doc_id"), "piece", (F.col("piece").cast("long") * capacity).alias("start"), "length")
