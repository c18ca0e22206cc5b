import duckdb
import pytest

import __spark_entry__ as entry
from textloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return f"{float(v):.6g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLES:
        return
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted([plain(r[columns.index(c)]) for c in sorted(columns)] for r in result.fetchall())
    assert sorted([plain(r[c]) for c in sorted(columns)] for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_short_repeats_alone(spark, tmp_path):
    """A text of some length in which four bytes repeat, but no six: references back shorten it nevertheless."""
    texts = ["".join(f"ouau{chr(0x4E00 + 65 * k)}" for k in range(30)), "short", "", "the text and the text that is " * 9]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    for name, column, value in (("layered_backref_roundtrip", "packed", 1), ("backref_roundtrip", "refers", 0)):
        df = QUERIES[name](spark, str(tmp_path))
        rows, result = df.collect(), con.execute(ORACLES[name])
        columns = [d[0] for d in result.description]
        assert sorted([plain(r[c]) for c in columns] for r in rows) == sorted([plain(v) for v in r] for r in result.fetchall())
        assert next(r[column] for r in rows if r["turn"] == 0) == value


def against_sql(spark, folder, name, texts):
    """The query's rows over turns of these texts, which must be those of its SQL."""
    path = f"{folder}/conversations.parquet"
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    df = QUERIES[name](spark, str(folder))
    rows, result = df.collect(), con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted([plain(r[c]) for c in columns] for r in rows) == sorted([plain(v) for v in r] for r in result.fetchall())
    return rows


def test_deflate_of_short_texts_of_many_accents(spark, tmp_path):
    against_sql(spark, tmp_path, "deflate_roundtrip", ["Óóèíúüéà", "Ó que.le é àí ßà.ê en ö.ó.è çäde.è.úö ez.", "", "plain", "the text and the text that is " * 9])


def test_full_layers_of_tight_texts(spark, tmp_path):
    from tests.test_codecs import TIGHT

    against_sql(spark, tmp_path, "layered_full_roundtrip", [TIGHT, "", "short", "the text and the text that is " * 9])
