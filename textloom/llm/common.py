"""What the training-data operators share: tables, the shared folder, numpy kernels over Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.tables import scratch, shared_dir, spread, written

__all__ = ["scratch", "shared_dir", "spread", "written"]

#: A table of one or two numbers a row is broadcast only while it has at most this many rows, some 32 MB of numbers.
BROADCAST_ROWS = 2_000_000
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


#: Rows of an Arrow batch; texts may be long, and every task holds a batch on either side.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bounded(spark: SparkSession) -> None:
    """Keeps the Arrow batches of the session's Python stages small, unless they are smaller already. It stays so for the
    session, as the setting is read when a result is computed, which is after the operator has returned."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is not None and not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint while its counted rows are at most limit; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def text_slices(column: pa.Array, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about max_bytes; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every bit of x."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes hashed at once: text_slices' own size, so that only texts longer than that are hashed in pieces.
PIECE = 1 << 19
#: Shingles of a long text that are made at once.
BLOCK = 1 << 20
_powers: list[np.ndarray] = []
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = (np.arange(256) > 32).astype(np.uint8)


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(PIECE + 1, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first position) of each longest run, within a row, of bytes of one kind other than 0.

    kind: of each of the 256 bytes. A text longer than PIECE is hashed in pieces; what a piece breaks off is carried on,
    so memory beyond the text itself is that of the hashes, and no word is cut.
    """
    up, down = _power_tables()
    hashes, firsts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    edges, carry = offsets[1:-1], None  # carry: (kind, first position, sum so far, length) of the run that the piece before broke off
    for a in range(0, len(data), PIECE):
        part = data[a : a + PIECE]
        k, m = kind[part], len(part)
        first = np.empty(m, bool)
        first[0] = True
        np.not_equal(k[1:], k[:-1], out=first[1:])
        own = edges[(edges >= a) & (edges < a + m)] - a
        first[own] = True
        start = np.flatnonzero(first)
        end = np.r_[start[1:], m]
        total = np.zeros(m + 1, np.uint64)
        np.cumsum(((_LOWER[part] if lower else part).astype(np.uint64) + U64(1)) * up[:m], out=total[1:])
        value = (total[end] - total[start]) * down[start]
        at, of = start + a, k[start]
        if carry:
            if carry[0] == of[0] and not (len(own) and own[0] == 0):
                value[0] = U64((carry[2] + int(value[0]) * pow(_BASE, carry[3], 1 << 64)) & _MASK)
                at[0], begun = carry[1], carry[3]
            else:
                value, at, of = np.r_[np.array([carry[2]], np.uint64), value], np.r_[carry[1], at], np.r_[np.array([carry[0]], np.uint8), of]
                begun = 0
        else:
            begun = 0
        carry = None
        if a + m < len(data):
            length = m - int(start[-1]) + (begun if len(start) == 1 else 0)
            carry = (int(of[-1]), int(at[-1]), int(value[-1]), length)
            value, at, of = value[:-1], at[:-1], of[:-1]
        hashes.append(mix(value[of > 0]))
        firsts.append(at[of > 0])
    return (hashes[1], firsts[1]) if len(hashes) == 2 else (np.concatenate(hashes), np.concatenate(firsts))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of each word, words being runs of bytes above 0x20; ASCII letters are lowered."""
    h, first = runs(data, offsets, _SOLID, lower)
    return h, np.searchsorted(offsets, first, "right") - 1


def _chained(w: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k neighbours of w, at the first of them; the last k - 1 are of no use."""
    h = mix(w + U64(k))
    for j in range(1, k):
        h[: len(w) - j] = mix(h[: len(w) - j] * U64(3) + w[j:])
    return h


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of each k-word shingle in row order, and the 128-bit key of each row's whole word sequence.

    A text of 1 to k-1 words is one shingle; a text without words has none and key 0.
    """
    w, row = words(data, offsets)
    rows = len(offsets) - 1
    key = np.zeros((rows, 2), np.uint64)
    if not len(w):
        return w, row, key
    salts = (U64(0x1234567), U64(0x89ABCDEF01))
    if rows == 1 and len(w) > BLOCK:  # one long text: in blocks that overlap by k - 1 words
        parts = []
        for a in range(0, len(w), BLOCK):
            place = np.arange(a, min(a + BLOCK, len(w)), dtype=np.uint64)
            for half, salt in enumerate(salts):
                key[:, half] += mix(w[a : a + BLOCK] ^ mix(place + salt)).sum(dtype=np.uint64)
            parts.append(_chained(w[a : a + BLOCK + k - 1], k)[: max(0, min(BLOCK, len(w) - a - k + 1))])
        h = np.concatenate(parts)
        return h, row[: len(h)], key
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[start, len(w)])
    place = (np.arange(len(w)) - np.repeat(start, count)).astype(np.uint64)
    for half, salt in enumerate(salts):
        key[row[start], half] = np.add.reduceat(mix(w ^ mix(place + salt)), start)
    h = _chained(w, k)
    whole = place + U64(k) <= np.repeat(count, count).astype(np.uint64)
    short = start[count < k]
    whole[short] = True
    h[short] = key[row[short], 0]
    return h[whole], row[whole], key
