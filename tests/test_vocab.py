"""The vocabulary queries over all lengths and turns against brute force on a fixture."""

from collections import Counter

import pytest

from textloom.plans import mining

TEXTS = [(1, 0, "abcabcabcabc the cat and the cat and the cat"), (1, 1, "no run here"), (1, 2, "0123456789012345678901234567890123456789" * 4), (2, 0, "\r\n\r\n\r\n\r\n x\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9"), (2, 1, None), (2, 2, "")]


def candidates(text):
    data = (text or "").encode()
    found = Counter()
    for n in range(4, min(32, len(data) // 2) + 1):
        found.update(data[i : i + n] for i in range(len(data) - n + 1) if data[i] >= 32 or data[i] == 10 or data[i] == 13 and i)
    return {p: c for p, c in found.items() if c >= 3}


def pruned(found):
    kept = []
    for p in sorted(found, key=lambda p: (-(len(p) - 2) * found[p], -len(p), p)):
        if not any(p in k for k in kept):
            kept.append(p)
    return kept


def used(patterns, data):
    out, at = set(), 0
    while at < len(data):
        p = max((p for p in patterns if data.startswith(p, at)), key=len, default=None)
        out |= {p} if p else set()
        at += len(p) if p else 1
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("turns"))
    spark.createDataFrame([(c, t, "user", x) for c, t, x in TEXTS], "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def test_all_lengths_and_turns(spark, folder):
    every = {(c, t): candidates(x) for c, t, x in TEXTS}
    lengths, hits = Counter(), Counter()
    for found in every.values():
        for p, n in found.items():
            lengths[len(p)] += 1
            hits[len(p)] += n
    assert set(lengths) == set(range(4, 33))
    assert {(r.len, r.patterns, r.occurrences) for r in mining.frequency_map(spark, folder).collect()} == {(n, lengths[n], hits[n]) for n in lengths}
    rows = lambda df: sorted((r.conv_id, r.turn, bytes.fromhex(r.pattern), r.freq, r.saving) for r in df.collect())
    full = lambda pick: sorted((*k, p, f[p], (len(p) - 2) * f[p]) for k, f in every.items() for p in pick(k, f))
    assert rows(mining.vocab_candidates(spark, folder)) == full(lambda k, f: f)
    assert rows(mining.vocab_dominated(spark, folder)) == full(lambda k, f: pruned(f))
    data = {(c, t): (x or "").encode() for c, t, x in TEXTS}
    fires = full(lambda k, f: used(pruned(f)[:200], data[k]))
    assert rows(mining.prune_to_fired(spark, folder)) == fires
    assert len(fires) < len(full(lambda k, f: pruned(f)[:200]))


def test_general_dictionary(spark, tmp_path):
    texts = [x for _, _, x in TEXTS] + ["wide " * 20_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    total = Counter()
    for x in texts[:-1]:
        found = candidates(x)
        for p in pruned(found)[:200]:
            total[p] += found[p]
    got = {bytes.fromhex(r.pattern): r.freq for r in mining.general_dictionary(spark, str(tmp_path)).collect()}
    short = {p: n for p, n in total.items() if p.strip(b" \t\r\n") and b"wide" not in p}
    assert {p: got.get(p) for p in short} == short and any(b"wide " in p for p in got) and len(got) <= 5000
