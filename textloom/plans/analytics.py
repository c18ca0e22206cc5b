"""Queries of similarity and of benchmark reports: ratios, milestones, percentiles, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import tables
from textloom.functions import bytesview as B
from textloom.operators import codecs, similarity, split
from textloom.operators.ranks import percentiles_at

from .coding import ALT, turns
from .corpora import docs
from .registry import query

#: Stand-ins for a codec's output sizes that SQL can state: the literals that the fixed vocabulary leaves, and the tokens.
_SIZES = f"""s AS (SELECT doc_id, source, octet_length(encode(text)) AS n_in, octet_length(encode(regexp_replace(text, '{ALT}', '', 'g'))) + len(regexp_extract_all(text, '{ALT}', 0)) AS n_out FROM documents)"""


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split.streams(docs(spark, sf_dir), "text")
    return s.select("doc_id", "source", F.octet_length("text").cast("long").alias("n_in"), (F.length("lits") + F.size("toks")).cast("long").alias("n_out"))


_NEAR = """s AS (SELECT a.vec_id AS query, b.vec_id AS neighbor, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) DESC, b.vec_id) AS rank,
  round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id WHERE a.vec_id % 100 = 0 AND round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) > 0.3 QUALIFY rank <= 3)"""


@query(f"WITH {_NEAR} SELECT query, neighbor, rank, score FROM s")
def cosine_topk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all earlier vectors the three most similar to each whose id is divisible by 100."""
    return similarity.earlier_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 3, 0.3)


_WORDS = f"w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9'']{{2,}}')) AS word FROM conversations), k AS (SELECT conv_id, word FROM w WHERE word NOT IN ({', '.join(repr(x) for x in B.STOP_WORDS)}))"


@query(f"""WITH {_WORDS}, v AS (SELECT conv_id, avg(CAST(length(word) AS DOUBLE)) AS x, avg(CASE WHEN contains(word, 'th') THEN 1.0::DOUBLE ELSE 0 END) AS y FROM k GROUP BY conv_id)
SELECT conv_id, round(x / sqrt(x * x + y * y), 6) AS x, round(y / sqrt(x * x + y * y), 6) AS y FROM v""")
def mean_word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pooling with a two-dimensional vector for every word: its length, and whether it has a th."""
    tokens = turns(spark, sf_dir).select("conv_id", F.explode(B.words(F.col("text"))).alias("word"))
    vectors = tokens.select("word").distinct().withColumn("vec", F.array(F.length("word").cast("double"), F.when(F.col("word").contains("th"), 1.0).otherwise(0.0)))
    return similarity.mean_pooled(tokens, vectors, "conv_id").select("conv_id", F.round(F.col("vec")[0], 6).alias("x"), F.round(F.col("vec")[1], 6).alias("y"))


@query(f"""WITH {_NEAR}, p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings)
SELECT x.vec_id AS query, CAST(least(3, any_value(x.place)) AS BIGINT) AS sequential, count(s.neighbor) AS semantic, count(s.neighbor) FILTER (y.place >= x.place - 3) AS shared
FROM p x LEFT JOIN s ON s.query = x.vec_id LEFT JOIN p y ON y.vec_id = s.neighbor WHERE x.vec_id % 100 = 0 GROUP BY x.vec_id""")
def warm_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to warm a window: the last three items, or the three most similar of all earlier ones."""
    e, _ = tables.numbered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ["vec_id"], "place")
    near = similarity.earlier_top_k(e, "vec_id", "embedding", F.col("vec_id") % 100 == 0, 3, 0.3)
    at = e.select("vec_id", "place")
    pair = near.join(at.toDF("query", "q_place"), "query").join(at.toDF("neighbor", "n_place"), "neighbor")
    counts = pair.groupBy("query").agg(F.count("*").alias("n"), F.count_if(F.col("n_place") >= F.col("q_place") - 3).alias("both"))
    every = at.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.least(F.lit(3), F.col("place")).cast("long").alias("sequential"))
    return every.join(counts, "query", "left").select("query", "sequential", F.coalesce("n", F.lit(0)).alias("semantic"), F.coalesce("both", F.lit(0)).alias("shared"))


@query(f"WITH {_SIZES} SELECT source, CAST(sum(n_in) AS BIGINT) AS bytes_in, CAST(sum(n_out) AS BIGINT) AS bytes_out, round(CASE WHEN sum(n_out) = 0 THEN 1.0 ELSE sum(n_in)::DOUBLE / sum(n_out) END, 6) AS ratio FROM s GROUP BY source")
def ratio_by_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sizes(spark, sf_dir).groupBy("source").agg(F.sum("n_in").alias("bytes_in"), F.sum("n_out").alias("bytes_out"))
    return t.withColumn("ratio", F.round(B.ratio(F.col("bytes_in"), F.col("bytes_out")), 6))


@query(f"""WITH {_SIZES}, c AS (SELECT source, row_number() OVER w AS n, sum(n_in) OVER w AS a, sum(n_out) OVER w AS b FROM s WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, n, CAST(a AS BIGINT) AS bytes_in, round(a::DOUBLE / greatest(b, 1), 6) AS ratio FROM c WHERE n IN (10, 50, 100, 500, 1000, 2000)""")
def ratio_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("source").orderBy("doc_id")
    first = docs(spark, sf_dir).select("doc_id", "source").withColumn("n", F.row_number().over(order).cast("long")).where("n <= 2000")  # ids alone, cut off before the shuffle
    upto = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    few = sizes(spark, sf_dir).join(F.broadcast(first.select("doc_id", "n")) if first.limit(200_001).count() <= 200_000 else first.select("doc_id", "n"), "doc_id")
    c = few.select("source", "n", F.sum("n_in").over(upto).alias("bytes_in"), F.sum("n_out").over(upto).alias("b"))
    return c.where(F.col("n").isin(10, 50, 100, 500, 1000, 2000)).select("source", "n", "bytes_in", F.round(F.col("bytes_in") / F.greatest("b", F.lit(1)), 6).alias("ratio"))


@query(f"""WITH {_SIZES}, r AS (SELECT source, seed, sum(n_in)::DOUBLE / sum(n_out) AS ratio FROM s, (VALUES (1337), (2718), (31415)) x(seed) WHERE (doc_id * 31 + seed) % 3 <> 0 GROUP BY source, seed)
SELECT source, round(avg(ratio), 6) AS mean_ratio, CASE WHEN avg(ratio) > 1.02 THEN 'beats' ELSE 'gap' END AS label FROM r GROUP BY source""")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean ratio over three seeded selections, against a bar."""
    seeds = F.explode(F.array(F.lit(1337), F.lit(2718), F.lit(31415)))
    s = sizes(spark, sf_dir).withColumn("seed", seeds).where("(doc_id * 31 + seed) % 3 <> 0").groupBy("source", "seed").agg((F.sum("n_in") / F.sum("n_out")).alias("r"))
    return s.groupBy("source").agg(F.avg("r").alias("m")).select("source", F.round("m", 6).alias("mean_ratio"), F.when(F.col("m") > 1.02, "beats").otherwise("gap").alias("label"))


@query("SELECT event_type, list_sort(list(value))[CAST(least(count(value) - 1, floor(0.5 * count(value))) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(least(count(value) - 1, floor(0.95 * count(value))) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type")
def percentile_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles at floor(p n), by places in the whole order, so that no group has to fit into one task."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    n = e.groupBy("event_type", "value").agg(F.count("*").alias("n"))  # equal values count before they move
    return percentiles_at(n, "event_type", "value", "n", {"p50": 0.5, "p95": 0.95})


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def percentile_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by value)")
    return e.groupBy("event_type").agg(disc(0.5).alias("p50"), disc(0.99).alias("p99"))


@query("SELECT role, count(*) AS turns, round(avg(length(text)), 6) AS mean_chars FROM conversations GROUP BY role")
def role_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy("role").agg(F.count("*").alias("turns"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@query("SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN length(text) END) AS BIGINT) AS user_chars, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) END) AS BIGINT) AS assistant_chars FROM conversations GROUP BY conv_id")
def role_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = turns(spark, sf_dir).groupBy("conv_id").pivot("role", ["user", "assistant"]).agg(F.sum(F.length("text")).cast("long"))
    return p.select("conv_id", F.col("user").alias("user_chars"), F.col("assistant").alias("assistant_chars"))


@query("SELECT user_id, round(sum(value) / 1048576, 9) AS mb, round(sum(value) / 1048576 / (count(*) * 0.001::DOUBLE), 6) AS mb_s, 1000::DOUBLE AS us_per_chunk FROM events GROUP BY user_id")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MB/s and microseconds a chunk, with value as bytes and a millisecond for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    mb = F.col("v") / 1048576
    return e.select("user_id", F.round(mb, 9).alias("mb"), F.round(mb / (F.col("n") * 0.001), 6).alias("mb_s"), F.lit(1000.0).alias("us_per_chunk"))


@query()
def codec_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in and out of every codec by corpus, frames, positions and vocabularies counted: an output that can be decoded.
    Without SQL, which has no codec; tests/test_codecs.py does the same in plain Python."""
    names = list(codecs.SIZED)

    def sizes_of(data: bytes) -> dict:
        return {n: len(f(data)) for n, f in codecs.SIZED.items()}

    kind = "struct<" + ",".join(f"{n}:bigint" for n in names) + ">"
    tables.bounded(spark)
    texts = tables.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "text"))
    s = texts.where("octet_length(text) > 0").select("source", F.octet_length("text").cast("long").alias("n_in"), split.byte_udf(sizes_of, kind)(F.encode("text", "UTF-8")).alias("s"))
    t = s.groupBy("source").agg(F.sum("n_in").alias("bytes_in"), *(F.sum(f"s.{n}").alias(n) for n in names))
    long = t.select("source", "bytes_in", F.explode(F.array(*(F.struct(F.lit(n).alias("codec"), F.col(n).alias("bytes_out")) for n in names))).alias("c"))
    return long.select("source", "c.codec", "bytes_in", "c.bytes_out", F.round(B.ratio(F.col("bytes_in"), F.col("c.bytes_out")), 6).alias("ratio"))
