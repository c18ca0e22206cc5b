"""Encoding against a vocabulary that is learned meanwhile, and against pinned versions of one.

A session's rows are sorted within their partition and go through one task in order, batch by batch, so no session is ever
held as a whole; what is kept of it is its window, of at most the window's cap of entries.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.tables import dealt

from . import codecs
from .vocab import WINDOW_CAP
from .windows import SessionWindow

#: Entries of a pinned version, and those of a learned window that encode: its most saving ones.
PINNED = 200
V1_CAP = 200


def _in_order(df: DataFrame, key: str, order: str, columns: list[str], schema: str, step: Callable) -> DataFrame:
    """For each row step(state of its key, (columns' values)) -> (state, row of schema), rows of a key in order, state None
    at first."""
    kinds = dict(df.dtypes)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for own, *values in zip(*(batch.column(i).to_pylist() for i in (0, *range(2, batch.num_columns)))):
                if (own,) != now:
                    now, state = (own,), None
                state, row = step(state, values)
                out.append(row)
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(columns, arrow))], [key, order, *names])

    arrow = [{"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[x.strip().split(" ")[1]] for x in schema.split(",")]
    sorted_ = dealt(df.select(key, order, *columns), key).sortWithinPartitions(key, order)
    return sorted_.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {schema}")


def _matcher(window: SessionWindow) -> codecs.Matcher:
    best = heapq.nsmallest(PINNED, [(-v[1], -len(p), p) for p, v in window.entries.items()])  # in the order of codecs.order_of
    return codecs.Matcher([p for _, _, p in best])


def learn_encode(turns: DataFrame, key: str, order: str, text_col: str, cap: int = WINDOW_CAP) -> DataFrame:
    """(key, order, code): each row encoded with the most saving entries that its key's window has before the row, which the
    window learns then. The code begins with the version, how many rows were learned; a null text is encoded as empty."""

    def step(window: SessionWindow | None, values: list) -> tuple[SessionWindow, tuple]:
        window = window or SessionWindow(cap=cap)
        data = bytes(values[0] or b"")
        code = codecs.varint(window.batches) + codecs.codon_encode(data, _matcher(window))
        window.update(codecs.mine(data))
        return window, (code,)

    slim = turns.select(key, order, F.encode(text_col, "UTF-8").alias("data"))
    return _in_order(slim, key, order, ["data"], "code binary", step)


def learn_decode(coded: DataFrame, key: str, order: str, cap: int = WINDOW_CAP) -> DataFrame:
    """(key, order, version, entries, covered, data) of (key, order, code): the window is learned anew from what is decoded,
    so all codes of a key are needed from its first on; a version that isn't the next one raises. covered: how many bytes
    the code's tokens and literals stand for."""

    def step(window: SessionWindow | None, values: list) -> tuple[SessionWindow, tuple]:
        window = window or SessionWindow(cap=cap)
        version, at = codecs.read_varint(bytes(values[0]), 0)
        if version != window.batches:
            raise codecs.CodecError("bad_version")
        entries, coded = len(window.entries), bytes(values[0])[at:]
        patterns = _matcher(window).patterns
        data = codecs.codon_decode(coded, patterns)
        covered = codecs.covered(coded, patterns)
        window.update(codecs.mine(data))
        return window, (version, entries, covered, data)

    return _in_order(coded, key, order, ["code"], "version long, entries long, covered long, data binary", step)


def window_encode(turns: DataFrame, key: str, order: str, text_col: str) -> DataFrame:
    """(key, order, code): the small window learns each row, forgets what is old and rare, and encodes the row in two passes
    with its entries first; those that fire are in the code's header, so that codecs.detokenize needs no window."""

    def step(window: SessionWindow | None, values: list) -> tuple[SessionWindow, tuple]:
        window = window or SessionWindow(cap=V1_CAP)
        data = bytes(values[0] or b"")
        window.update(codecs.mine(data))
        window.evict()
        own = sorted((codecs.Entry(p, f, s) for p, f, s, _ in window.rows()), key=codecs.order_of)
        return window, (codecs.tokenize(data, own),)

    slim = turns.select(key, order, F.encode(text_col, "UTF-8").alias("data"))
    return _in_order(slim, key, order, ["data"], "code binary", step)


def _versions(pinned: DataFrame) -> dict[int, list[bytes]]:
    """The patterns of each version, at most PINNED each, best first: few enough for the driver by their bound."""
    out: dict[int, list[bytes]] = {}
    for r in pinned.where(F.col("rank") <= PINNED).orderBy("version", "rank").select("version", "pattern").collect():
        out.setdefault(r["version"], []).append(bytes(r["pattern"]))
    return out


def _frozen(data: bytes, matcher: codecs.Matcher, form: str) -> bytes:
    return codecs.codon_encode(data, matcher) if form == "codon" else codecs.pack_plain(codecs.split_encode(data, matcher, form))


def _thawed(code: bytes, patterns: list[bytes], form: str) -> tuple[int, bytes]:
    """(bytes that the tokens and literals stand for, the data)."""
    if form == "codon":
        return codecs.covered(code, patterns), codecs.codon_decode(code, patterns)
    streams = codecs.unpack_plain(code)
    covered = len(codecs.split_literals(streams, form)) + sum(len(patterns[i - 1]) for i in codecs.split_ids(streams, form))
    return covered, codecs.split_decode(streams, patterns, form)


def frozen_encode(rows: DataFrame, pinned: DataFrame, text_col: str, form: str = "codon") -> DataFrame:
    """rows with code: text_col encoded with the entries pinned (version, rank, pattern) of the row's version, which begins
    the code, as codons or in a split form. Nothing is learned. A version without entries leaves the text as literals."""
    shared = rows.sparkSession.sparkContext.broadcast(_versions(pinned))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {v: codecs.Matcher(p, kept=True) for v, p in shared.value.items()}
        none = codecs.Matcher([])
        for batch in batches:
            codes = [codecs.varint(v) + _frozen(bytes(d or b""), matchers.get(v, none), form) for v, d in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(codes, pa.binary())], [*batch.schema.names[:-2], "code"])

    slim = rows.select(*rows.columns, F.col("version").cast("long").alias("__version"), F.encode(text_col, "UTF-8").alias("__data"))
    return slim.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, ("code", "binary")]))


def decode_by_version(coded: DataFrame, pinned: DataFrame, form: str = "codon") -> DataFrame:
    """coded with version, covered and data: each code decoded with the entries of the version that it begins with; one of
    which there are no entries may only hold literals."""
    shared = coded.sparkSession.sparkContext.broadcast(_versions(pinned))
    at = coded.columns.index("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for code in batch.column(at).to_pylist():
                version, start = codecs.read_varint(bytes(code), 0)
                patterns = shared.value.get(version, [])
                out.append((version, *_thawed(bytes(code)[start:], patterns, form)))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary())))], [*batch.schema.names, "version", "covered", "data"])

    return coded.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*coded.dtypes, ("version", "long"), ("covered", "long"), ("data", "binary")]))
