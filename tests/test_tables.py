"""The shared folder, global places, split streams as columns, learned encoding and real codec sizes."""

import re
import zlib
from collections import defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom import tables
from textloom.functions import bytesview as B
from textloom.operators import codecs, learning, ranks, similarity, split, vocab
from textloom.plans import analytics, catalogue  # noqa: F401
from textloom.plans.registry import QUERIES


def session(master, setting=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=SimpleNamespace(master=master, applicationId=f"of {master}"))


def test_shared_folder_is_the_sessions_own():
    assert tables.shared_dir(session("yarn", "hdfs://there/x/")) == "hdfs://there/x"
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://h:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            tables.shared_dir(session(master))
    own = tables.shared_dir(session("local[4]"))
    assert own.startswith("file:///") and own == tables.shared_dir(session("local[4]"))


def test_written_tables_can_be_deleted(spark):
    df = tables.written(spark.range(3), "t")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    tables.forget(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_places(spark):
    values = [(i * 7919) % 500 for i in range(500)]
    df, n = tables.numbered(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), ["v"], "place")
    assert n == 500 and all(r.v == r.place for r in df.collect())
    df, n = tables.numbered(spark.createDataFrame([], "v long"), ["v"], "place")
    assert n == 0 and df.count() == 0


def test_percentiles_of_large_groups(spark):
    rows = [(k, float((i * 37) % m), 1 + i % 3) for k, m in (("a", 90), ("b", 1)) for i in range(m)]
    got = {r.k: (r.p0, r.p50, r.p95) for r in ranks.percentiles_at(spark.createDataFrame(rows, "k string, v double, n long"), "k", "v", "n", {"p0": 0.0, "p50": 0.5, "p95": 0.95}).collect()}
    for k in ("a", "b"):
        values = sorted(v for key, v, n in rows if key == k for _ in range(n))
        assert got[k] == tuple(values[min(len(values) - 1, int(p * len(values)))] for p in (0, 0.5, 0.95))


def test_split_streams_take_null_and_odd_texts(spark):
    texts = [None, "", " the ", "a the \n\n é the  the x", "    " * 5, "中 and 文"]
    df = split.streams(spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(2), "text")
    rows = {r.i: r for r in df.withColumn("back", F.decode(F.encode(split.rebuilt(F.col("toks"), F.col("lits"), F.col("runs")), "ISO-8859-1"), "UTF-8")).collect()}
    assert rows[0].toks is None and rows[0].lits is None and rows[0].back is None
    matcher = codecs.Matcher([p.encode() for p in split.TEXT_PATTERNS])
    for i, text in enumerate(texts[1:], 1):
        ids, literals = matcher.pieces(text.encode())
        assert rows[i].back == text and rows[i].toks == ids and rows[i].runs == [len(x) for x in literals] and rows[i].lits.encode("latin-1") == b"".join(literals)


def test_similar_earlier_rows_of_all_history(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(300, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(3)
    got = {(r.query, r.rank): r.neighbor for r in similarity.earlier_top_k(df, "i", "v", F.col("i") % 10 == 9, 3, 0.3, block=7).collect()}
    want = {}
    for q in range(9, 300, 10):
        near = sorted((-round(float(x[q] @ x[j]), 4), j) for j in range(q) if round(float(x[q] @ x[j]), 4) > 0.3)[:3]
        want |= {(q, n): j for n, (_, j) in enumerate(near, 1)}
    assert got == want
    assert similarity.earlier_top_k(df, "i", "v", F.lit(False), 3, 0.3).count() == 0


def test_learned_codes(spark):
    texts = [(1, t, "the cat and the hat and the cat and the hat " * (t + 1)) for t in range(6)] + [(2, 0, None), (2, 1, "")]
    df = spark.createDataFrame(texts, "s long, t long, text string")
    coded = learning.learn_encode(df, "s", "t", "text")
    sizes = {(r.s, r.t): len(r.code) for r in coded.collect()}
    plain = {(s, t): len(codecs.codon_encode((x or "").encode(), codecs.Matcher([]))) for s, t, x in texts}
    assert sizes[1, 0] == plain[1, 0] + 1 and all(sizes[1, t] < plain[1, t] for t in range(1, 6))  # shorter from the second on
    back = {(r.s, r.t): (bytes(r.data).decode(), r.version) for r in learning.learn_decode(coded, "s", "t").collect()}
    assert back == {(s, t): (x or "", t) for s, t, x in texts}
    with pytest.raises(Exception, match="bad_version"):
        learning.learn_decode(coded.where("t <> 0"), "s", "t").collect()


def test_pinned_versions(spark):
    rows = spark.createDataFrame([(1, 1, "the quick fox the quick fox"), (2, 2, "the quick fox"), (3, 9, "no version has this")], "i long, version long, text string")
    pinned = spark.createDataFrame([(1, 1, bytearray(b"quick fox")), (2, 1, bytearray(b"the quick"))], "version long, rank long, pattern binary")
    coded = learning.frozen_encode(rows, pinned, "text").drop("version")
    back = {r.i: (r.version, bytes(r.data).decode(), r.covered) for r in learning.decode_by_version(coded.select("i", "code"), pinned).collect()}
    assert back == {r.i: (r.version, r.text, len(r.text)) for r in rows.collect()}
    assert {r.i: len(r.code) for r in coded.collect()}[1] == 1 + 27 - 2 * 9 + 2 * 2


def test_codec_ratios_in_plain_python(spark, sf):
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("octet_length(text) > 0").collect():
        data = r.text.encode()
        for name, size in (("gzip", len(zlib.compress(data, 6, 31))), ("ans", len(codecs.ans_encode(data))), ("split", len(codecs.split_size(data)))):
            want[r.source, name][0] += len(data)
            want[r.source, name][1] += size
    got = {(r.source, r.codec): [r.bytes_in, r.bytes_out] for r in analytics.codec_ratios(spark, sf).where("codec in ('gzip', 'ans', 'split')").collect()}
    assert got == dict(want)


def test_fnv_and_tiers(spark):
    lists = [[], [1], list(range(700)), [255, 256, 2**40 + 3]]
    got = [r.h for r in spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i long, ids array<long>").orderBy("i").select(B.fnv1a(F.col("ids")).alias("h")).collect()]
    assert got == [str(codecs.fnv1a(x)) for x in lists]
    ids = [1, 63, 64, 127, 128, 191, 192, 254, 9999]
    assert [r.t for r in spark.createDataFrame([(i,) for i in ids], "i long").orderBy("i").select(B.tier_of_id(F.col("i")).alias("t")).collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 3]


def test_tiers_by_key(spark):
    entries = spark.createDataFrame([("a", bytearray(b"long one"), 3, 30), ("a", bytearray(b"short"), 3, 9), ("b", bytearray(b"other"), 3, 9)], "role string, pattern binary, freq long, saving long")
    rows = vocab.tiers([entries, entries.where("role = 'a'")], ["role"]).collect()
    assert {(r.role, r.tier, bytes(r.pattern), r.token_id) for r in rows} == {("a", 0, b"long one", 1), ("a", 0, b"short", 2), ("a", 1, b"long one", 3), ("a", 1, b"short", 4), ("b", 0, b"other", 1)}


def test_costly_work_is_dealt_to_all_cores(spark, tmp_path):
    """One row group is one task's, into however many parts Spark splits its file."""
    spark.range(20_000).selectExpr("id", "sha2(cast(id as string), 256) as text").coalesce(1).write.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = spark.read.parquet(f"{tmp_path}/t")
        sizes = lambda d: [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
        assert df.rdd.getNumPartitions() > 4 and len(sizes(tables.spread(df))) == 1
        dealt = sizes(tables.dealt(df))
        assert len(dealt) == tables.tasks(df) >= 4 and max(dealt) < 1.2 * min(dealt) and sum(dealt) == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("name", "codec_ratios content_identity_dups general_dictionary pipeline_order1_roundtrip ans_o1_roundtrip window_snapshot_roundtrip batch_roundtrip learn_encode_roundtrip tier_stats".split())
def test_costly_queries_keep_their_tasks(spark, sf, name):
    """A fixed number of them, which isn't lowered when their bytes are few."""
    assert "REPARTITION_BY_NUM" in QUERIES[name](spark, sf)._jdf.queryExecution().toString()


def test_similar_rows_in_bounded_memory():
    """4,000 queries against batches of 10,000 rows: their scores alone would be 320 MB at once."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(20_000, 8)), rng.normal(size=(4_000, 8))
    own = pa.table({"query": np.arange(4_000) * 7, "q": q.tolist()})
    batches = [pa.record_batch({"i": np.arange(a, a + 10_000), "v": [None if i % 5_000 == 3 else v for i, v in enumerate(x[a : a + 10_000].tolist())]}) for a in (0, 10_000)]
    tracemalloc.start()
    got = next(similarity._nearest(SimpleNamespace(value=own), 3, 0.3)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    found = defaultdict(list)
    for i, j, s in zip(*(c.to_pylist() for c in got.columns)):
        found[i].append((-round(s, 4), j))
    scores = np.round(q[::97] @ x.T, 4)
    for n, i in enumerate(range(0, 4_000, 97)):
        best = sorted((-float(s), j) for j, s in enumerate(scores[n]) if j < 7 * i and j % 5_000 != 3 and s > 0.3)[:3]
        assert [j for _, j in sorted(found[7 * i])[:3]] == [j for _, j in best]


def test_runs_are_counted_where_the_texts_are(spark):
    rows = [(1, 0, "the cat and the cat and the cat"), (1, 1, None), (2, 0, "\r\naaaaaaaaa\r\naaaaaaaaa\r\naaaaaaaaa"), (2, 0, "aaaaaaaaaaaaaaaaa"), (None, 3, "é" * 30), (3, 3, "short")]
    df = vocab.ngram_counts(spark.createDataFrame(rows, "c long, t long, text string"), ["c", "t"], "text", 8)
    want = defaultdict(int)
    for c, t, x in rows:
        data = (x or "").encode()
        for i in range(len(data) - 7 if len(data) >= 16 else 0):
            if data[i] >= 32 or data[i] == 10 or data[i] == 13 and i:
                want[c, t, data[i : i + 8].decode("latin-1")] += 1
    assert {(r.c, r.t, r.pattern): r.n for r in df.collect()} == {k: n for k, n in want.items() if n >= 3}
    assert "Generate" not in df._jdf.queryExecution().toString()  # a row for each byte


def test_batches_are_small(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    for key in (rows, size):
        spark.conf.unset(key)
    tables.bounded(spark)
    seen = spark.range(2_500).coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert max(r.n for r in seen) <= 1_000 and spark.conf.get(size) == str(8 << 20)
    spark.conf.set(rows, "10")
    tables.bounded(spark)
    assert spark.conf.get(rows) == "10"
    spark.conf.unset(rows)
    tables.bounded(spark)


@pytest.mark.parametrize("name", "batch_roundtrip majority_batch_roundtrip learn_encode_roundtrip".split())
def test_grouped_queries_keep_their_tasks(spark, sf, name):
    """The exchange that brings a group together has a fixed number of partitions, too."""
    assert re.search(r"hashpartitioning\(conv_id[^)]*\), REPARTITION_BY_NUM", QUERIES[name](spark, sf)._jdf.queryExecution().toString())
