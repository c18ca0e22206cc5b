"""Split streams as columns: matches, literals and run lengths of a fixed vocabulary, and back again.

In Arrow batches: one regular expression with a group parts a text into literals and matches in one pass; in Catalyst the
same takes an extraction, a split and a look-up a match (README has the times)."""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf  # noqa: F401
from pyspark.sql.types import DataType

from . import codecs

#: The patterns of running text that are long enough to match.
TEXT_PATTERNS = [p.decode() for p in codecs.PRESEED["text"] if len(p) >= codecs.MIN_PATTERN]
_STREAMS = "struct<toks:array<int>,lits:string,runs:array<int>>"


def _lists(values: list[int], sizes: list[int], present: list[bool]) -> pa.Array:
    offsets = pa.array(np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype(np.int32), mask=np.array([*(not p for p in present), False]))
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))


def _parter(patterns: list[str]):
    """A function of a column of bytes: each text's token ids, literals as a byte view, and the literals' lengths."""
    usable = sorted({p.encode() for p in patterns}, key=lambda p: (-len(p), p))
    part = re.compile(b"(" + b"|".join(map(re.escape, usable)) + b")", re.DOTALL).split if usable else lambda x: [x]
    id_of = {p.encode(): i for i, p in reversed(list(enumerate(patterns, 1)))}.__getitem__

    def apply(column: pa.Array) -> pa.Array:
        present, toks, n_toks, lits, runs, n_runs = [], [], [], [], [], []
        for x in column.to_pylist():
            pieces = part(x) if x is not None else []
            texts = pieces[0::2]
            toks += map(id_of, pieces[1::2])
            runs += map(len, texts)
            n_toks.append(len(pieces) // 2)
            n_runs.append(len(texts))
            lits.append(b"".join(texts).decode("latin-1") if x is not None else None)
            present.append(x is not None)
        return pa.StructArray.from_arrays([_lists(toks, n_toks, present), pa.array(lits, pa.string()), _lists(runs, n_runs, present)], ["toks", "lits", "runs"])

    apply.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return apply


def streams(df: DataFrame, text_col: str, patterns: list[str] = TEXT_PATTERNS) -> DataFrame:
    """df with toks (ids from 1), lits (byte view) and runs (the literals' lengths, the last one's too); null for null."""
    parted = df.withColumn("__streams", arrow_udf(_parter(patterns), _STREAMS)(F.encode(text_col, "UTF-8")))
    return parted.select("*", "__streams.toks", "__streams.lits", "__streams.runs").drop("__streams")


def rebuilt(toks: Column, lits: Column, runs: Column, patterns: list[str] = TEXT_PATTERNS) -> Column:
    """The byte view that the streams came from."""

    def apply(toks: pa.Array, lits: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for ids, text, sizes in zip(toks.to_pylist(), lits.to_pylist(), runs.to_pylist()):
            if text is None:
                out.append(None)
                continue
            ends = list(accumulate(sizes))
            pieces = [""] * (len(sizes) + len(ids))
            pieces[0::2] = [text[b - n : b] for b, n in zip(ends, sizes)]
            pieces[1::2] = [patterns[i - 1] for i in ids]
            out.append("".join(pieces))
        return pa.array(out, pa.string())

    apply.__annotations__ = {"toks": pa.Array, "lits": pa.Array, "runs": pa.Array, "return": pa.Array}
    return arrow_udf(apply, "string")(toks, lits, runs)


def byte_udf(f, kind: DataType | str):
    """A function of bytes applied to a binary column an Arrow batch at a time; null stays null."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(kind) if isinstance(kind, str) else kind)

    def apply(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(bytes(x)) for x in column.to_pylist()], arrow)

    apply.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return arrow_udf(apply, kind)
