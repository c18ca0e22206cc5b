"""The pipeline's stages against brute force and on hostile tables."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from textloom.llm import queries
from textloom.llm.common import written

from .test_operators import DOCS, ODD, groups_by_force


def test_run_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        kept = written(stage(spark, kept, sf), "t")
        assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    gone = {i for i, kept, _ in groups_by_force(rows) if i != kept}
    want = Counter({i: len((t or "").encode()) + 1 for i, t in rows if i not in gone})
    got, bins = Counter(), Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] += r.length
        bins[r.bin_id] += r.length
    assert got == want and max(bins.values()) <= 16_384
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert not any(labels.get(i) == 0 and len(t) > 200 for i, t in rows)


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_tables(spark, sf, tmp_path, rows):
    spark.createDataFrame([(6, 1, 0), (None, 1, 1), (5, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("x")).withColumn("key", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "best-fit packing" or out.columns == docs.columns
        out.collect()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, str(tmp_path)), "t")
    left = [r.doc_id for r in docs.collect()]
    assert 7 not in left if rows else not left


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    result = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted([str(r[columns.index(c)]) for c in sorted(columns)] for r in result.fetchall())
    assert sorted([str(r[c]) for c in sorted(columns)] for r in df.collect()) == want


def test_eleven_queries():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
