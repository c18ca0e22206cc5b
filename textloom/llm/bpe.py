"""Byte-level BPE by merge replay over a corpus of words.

Texts are cut into words by the vocabulary's pattern, and every distinct word of a block of texts is laid out once as a
chain of byte tokens. An inverted index from token pair to the positions that hold it is then replayed: the pair of the
lowest rank is taken from the index, merged at all its positions in all words at once, and only the pairs with the touched
neighbours are entered anew. A text's tokens are its words' tokens in order. A word's tokens don't depend on other words,
so blocks are replayed apart, without a shuffle, and a worker keeps the words that it has met.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Texts of about this many characters are replayed together.
BLOCK_CHARS = 8_000_000
#: A worker forgets its words when it holds more than this many.
KEPT_WORDS = 300_000
NONE = np.iinfo(np.int32).max


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the JSON vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _parts(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], NONE))
        if ranks.get(parts[best] + parts[best + 1], NONE) >= below:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Vocabulary:
    """tokens: each id's bytes; merges (left id, right id, merged id) in rank order."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.size = max(tokens) + 1
        self.bytes = [tokens.get(i, b"") for i in range(self.size)]
        of_byte = {t: i for i, t in tokens.items() if len(t) == 1}
        self.of_byte = np.array([of_byte[bytes([b])] for b in range(256)], np.int64)
        self.left, self.right, self.merged = (np.array(x, np.int64) for x in zip(*merges))
        code = self.left * self.size + self.right
        self.rank_of = np.argsort(code, kind="stable").astype(np.int32)
        self.codes = code[self.rank_of]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a tokenizers JSON file, or a file of base64 tokens and ranks, whose merges are recovered."""
        with open(path, "rb") as f:
            data = f.read()
        if data.lstrip()[:1] == b"{":
            model, sign = json.loads(data)["model"], _byte_signs()
            special = lambda t: any(c not in sign for c in t)
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            made = {a + b for a, b in merges}
            tokens = {i: bytes(sign[c] for c in t) for t, i in model["vocab"].items() if not special(t) and (len(t) == 1 or t in made)}
            vocab = model["vocab"]
            return cls(tokens, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        pairs = ((_parts(t, ranks, r), r) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1)
        return cls({r: t for t, r in ranks.items()}, [(ranks[p[0]], ranks[p[1]], r) for p, r in pairs if len(p) == 2])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.rank_of[at], NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


def _grouped(rank: np.ndarray, at: np.ndarray, index: dict[int, list[np.ndarray]], heap: list[int]) -> None:
    """Enters the positions into the index under their ranks."""
    if not len(rank):
        return
    order = np.argsort(rank, kind="stable")
    rank, at = rank[order], at[order]
    cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
    starts = [0, *cuts.tolist()]
    for r, a, b in zip(rank[starts].tolist(), starts, [*starts[1:], len(at)]):
        if r in index:
            index[r].append(at[a:b])
        else:
            index[r] = [at[a:b]]
            heapq.heappush(heap, r)


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all words, their number by word)."""
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int32), sizes
    sym = vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    ends = np.cumsum(sizes)
    after = np.arange(1, total + 1)
    after[ends[sizes > 0] - 1] = -1
    before = np.arange(-1, total - 1)
    before[(ends - sizes)[sizes > 0]] = -1
    alive = np.ones(total, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []
    at = np.flatnonzero(after >= 0)
    rank = vocabulary.ranks(sym[at], sym[at + 1])
    _grouped(rank[rank < NONE], at[rank < NONE], index, heap)
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        a, b, new = int(vocabulary.left[r]), int(vocabulary.right[r]), int(vocabulary.merged[r])
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        follow = after[at]
        fits = (sym[at] == a) & (follow >= 0) & alive[at]
        fits &= sym[follow] == b
        at, follow = at[fits], follow[fits]
        if not len(at):
            continue
        if a == b and len(at) > 1:  # of a run of overlapping pairs every other one merges, from the left
            fresh = np.r_[True, at[1:] != follow[:-1]]
            start = np.flatnonzero(fresh)
            place = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
            at, follow = at[place % 2 == 0], follow[place % 2 == 0]
        sym[at] = new
        alive[follow] = False
        next_ = after[follow]
        after[at] = next_
        has = next_ >= 0
        before[next_[has]] = at[has]
        prior = before[at]
        touched = np.concatenate([prior[prior >= 0], at[has]])
        if len(touched):
            rank = vocabulary.ranks(sym[touched], sym[after[touched]])
            known = rank < NONE
            _grouped(rank[known], touched[known], index, heap)
    kept = np.flatnonzero(alive)
    return sym[kept].astype(np.int32), np.bincount(np.searchsorted(ends, kept, "right"), minlength=len(words)).astype(np.int64)


class Encoder:
    """Encodes blocks of texts, keeping the words that it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, end text, token ids of these texts, their number by text), texts of about a million words at once."""
        if len(self.number) > KEPT_WORDS:
            self.forget()
        known = len(self.number)
        number, find = self.number.__getitem__, self.find
        coded = [np.fromiter(map(number, find(t)), np.int32) for t in texts]
        if len(self.number) > known:
            fresh = list(islice(self.number, known, None))
            flat, sizes = replay([w.encode() for w in fresh], self.vocabulary)
            self.flat, self.sizes = np.r_[self.flat, flat], np.r_[self.sizes, sizes]
        start = np.cumsum(self.sizes) - self.sizes
        upto = np.r_[0, np.cumsum([len(c) for c in coded], dtype=np.int64)]
        row = 0
        while row < len(texts):
            end = min(len(texts), max(row + 1, int(np.searchsorted(upto, upto[row] + (1 << 20), "right")) - 1))
            words = np.concatenate(coded[row:end])
            n = self.sizes[words]
            ends = np.r_[0, np.cumsum(n)]
            ids = self.flat[np.arange(ends[-1]) + np.repeat(start[words] - ends[:-1], n)]
            yield row, end, ids, np.diff(ends[upto[row : end + 1] - upto[row]])
            row = end


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(shared, pattern: str) -> Encoder:
    key = shared.value.size, pattern
    if key not in _encoders or _encoders[key].vocabulary.merged.tobytes() != shared.value.merged.tobytes():
        _encoders.clear()
        _encoders[key] = Encoder(shared.value, pattern)
    return _encoders[key]


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of whole batches of about BLOCK_CHARS characters, each with its texts; null counts as empty."""
    held, texts, chars = [], [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        fresh = [t or "" for t in batch.column(at).to_pylist()]
        texts += fresh
        chars += sum(map(len, fresh))
        if chars >= BLOCK_CHARS:
            yield joined(), texts
            held, texts, chars = [], [], 0
    if held:
        yield joined(), texts


def decoded(v: Vocabulary, lists: pa.Array) -> pa.Array:
    """The texts of lists of ids; an id that the vocabulary doesn't have raises."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
    ids = lists.flatten().to_numpy()
    n = v.lengths[ids]
    if len(n) and not n.all():
        raise ValueError("a token id isn't in the vocabulary")
    ends = np.r_[0, np.cumsum(n)]
    data = v.flat[np.arange(ends[-1]) + np.repeat(v.starts[ids] - ends[:-1], n)].tobytes()
    cuts = ends[np.r_[0, np.cumsum(sizes)]].tolist()
    return pa.array([data[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(cuts, cuts[1:], lists.is_valid().to_pylist())], pa.string())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN, back: bool = False) -> DataFrame:
    """(doc_id, n_tokens, token_ids) for every row, the ids as the vocabulary's own tokenizer gives them.

    With back there is text as well, what the ids decode to: one Python stage where decode would take a second.
    A null text has null ids and 0 tokens, an empty one no ids; rows that repeat are encoded alike, null ids are kept. The
    strings of special tokens are ordinary text. Words of equal bytes have equal tokens, so there are no ties. A very long
    text is a block of its own and is encoded whole. Ids keep their type. The table may be empty and have any further
    columns. What is broadcast is the vocabulary.
    """
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, pattern)
        for part, texts in _blocks(batches, 1):
            null = part.column(1).is_null().to_numpy(zero_copy_only=False)
            for a, b, ids, sizes in encoder.encode(texts):
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.r_[null[a:b], False])
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                for row in range(0, b - a, 512):
                    own = lists.slice(row, 512)
                    columns = [part.column(0).slice(a + row, len(own)), pa.array(sizes[row : row + 512].astype(np.int32)), own, *([decoded(encoder.vocabulary, own)] if back else [])]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "token_ids", "text"][: len(columns)])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n_tokens int, token_ids array<int>" + ", text string" * back)


def decode(encoded: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """encoded's columns and text: the bytes of token_ids in order, as UTF-8 with U+FFFD for what isn't.

    Null ids give a null text, no ids an empty one; an id that is null or that the vocabulary doesn't have raises.
    """
    bounded(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    at = encoded.columns.index("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                part = batch.slice(row, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded(shared.value, part.column(at))], [*part.schema.names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))
