"""Queries of corpus preparation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import tables
from textloom.functions import bytesview as B
from textloom.operators import shards
from textloom.sources import corpus

from .coding import turns
from .registry import query

_STOPS = ", ".join(f"'{w}'" for w in B.STOP_WORDS)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations WHERE trim(text) <> ''),
 s AS (SELECT conv_id, r, k, text AS open, CAST(NULL AS VARCHAR) AS flushed FROM t WHERE r = 1
  UNION ALL SELECT t.conv_id, t.r, t.k, CASE WHEN length(s.open) + length(t.text) < 800 THEN s.open || ' | ' || t.text ELSE t.text END,
   CASE WHEN length(s.open) + length(t.text) < 800 THEN NULL ELSE s.open END FROM s JOIN t ON t.conv_id = s.conv_id AND t.r = s.r + 1),
 f AS (SELECT conv_id, r AS spot, flushed AS text FROM s WHERE flushed IS NOT NULL UNION ALL SELECT conv_id, r + 1, open FROM s WHERE r = k)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY spot) - 1 AS INT) AS place, text FROM f""")
def chunk_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.fused(turns(spark, sf_dir), "conv_id", "turn", "text")


@query("""WITH d AS (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(length(text) / 1024.0) AS BIGINT) - 1)) AS chunk FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(chunk AS INT) AS chunk, length(substr(text, chunk * 1024 + 1, 1024)) AS n_chars, sha256(substr(text, chunk * 1024 + 1, 1024)) AS chunk_sha256 FROM d""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.chunks(docs(spark, sf_dir), ["doc_id"], F.col("text"), 1024)
    return c.select("doc_id", "chunk", F.length("data").cast("long").alias("n_chars"), F.sha2(F.encode("data", "UTF-8"), 256).alias("chunk_sha256"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) WHERE p % greatest(1, n // 200) = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.every(docs(spark, sf_dir).select("doc_id"), ["doc_id"], 200)


@query("SELECT conv_id, turn FROM conversations ORDER BY sha256('42:' || conv_id || ':' || turn), conv_id, turn LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 100 turns."""
    return corpus.sample(turns(spark, sf_dir), ["conv_id", "turn"], 42, 100).select("conv_id", "turn")


@query("SELECT role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations WHERE length(text) > 200 AND length(text) < 3000 GROUP BY role")
def length_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).where((F.length("text") > 200) & (F.length("text") < 3000))
    return t.groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("WITH b AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch, text FROM conversations) SELECT conv_id, CAST(batch AS INT) AS batch, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM b GROUP BY ALL HAVING count(*) = 3")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full batches of three turns."""
    b = shards.batches(turns(spark, sf_dir), "conv_id", "turn", 3).groupBy("conv_id", "batch").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"))
    return b.where("n = 3").drop("n")


@query("SELECT part, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT CASE WHEN row_number() OVER (ORDER BY conv_id, turn) <= 400 THEN 'train' ELSE 'test' END AS part, text, row_number() OVER (ORDER BY conv_id, turn) AS r FROM conversations) WHERE r <= 700 GROUP BY part")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 400 turns train, the next 300 test: the split is by position."""
    placed, _ = tables.numbered(turns(spark, sf_dir), ["conv_id", "turn"], "r")
    t = placed.where("r < 700").withColumn("part", F.when(F.col("r") < 400, "train").otherwise("test"))
    return t.groupBy("part").agg(F.count("*").alias("turns"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9'']{{2,}}')) AS word FROM documents) WHERE word NOT IN ({_STOPS}) GROUP BY word")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.explode(B.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN octet_length(encode(text)) > 10485760 THEN 'too_large' WHEN count(*) OVER (PARTITION BY conv_id) > 1000 THEN 'too_many' ELSE 'ok' END AS status FROM conversations""")
def input_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request is a conversation: empty messages, those over 10 MiB, and requests of more than 1,000 messages are marked."""
    return corpus.validated(turns(spark, sf_dir), "conv_id", "text").select("conv_id", "turn", "status")


@query("""SELECT doc_id, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}') AS address, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}') AS valid FROM documents""")
def email_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first address in each document, if it has one."""
    address = F.regexp_extract("text", corpus.EMAIL, 0)
    return docs(spark, sf_dir).select("doc_id", address.alias("address"), (address != "").alias("valid"))


@query("SELECT conv_id, turn, sha256(text) AS restored_sha256, length(to_base64(encode(text))) AS coded_chars FROM conversations")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service's payload form."""
    c = turns(spark, sf_dir).withColumn("code", F.base64(F.encode("text", "UTF-8")))
    return c.select("conv_id", "turn", F.sha2(F.unbase64("code"), 256).alias("restored_sha256"), F.length(F.regexp_replace("code", "[\r\n]", "")).cast("long").alias("coded_chars"))


@query("SELECT c_custkey, sha256(c_name) AS restored_sha256, true AS hidden FROM customer")
def field_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AES-256-CBC with a fresh IV a value, and back."""
    key = F.lit("0123456789abcdef0123456789abcdef")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("coded", F.aes_encrypt("c_name", key, F.lit("CBC"), F.lit("PKCS")))
    back = F.aes_decrypt("coded", key, F.lit("CBC"), F.lit("PKCS"))
    return c.select("c_custkey", F.sha2(back, 256).alias("restored_sha256"), (F.octet_length("coded") > F.octet_length("c_name")).alias("hidden"))


# Every loader reads what is first written in its format, so that its rows can be held against the table they came from.

_LONG = "length(text) > 200 AND length(text) < 3000"


def _turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation a row, with its turns in order."""
    tables.bounded(spark)
    t = turns(spark, sf_dir)
    rows = tables.dealt(t, "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")).agg(F.count("*").alias("n"))


def _array_file(rows: DataFrame, path: str) -> str:
    """rows as files of one JSON array each, the form of chat exports. A file is read by one task, so there is one of some
    megabytes for each task that writes, instead of one of all rows."""
    rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(_as_array, "value string").write.text(path)
    return path


def _as_array(batches):
    first = True
    for batch in batches:
        values = batch.column(0).to_pylist()
        if values:
            yield pa.RecordBatch.from_arrays([pa.array([("[" if first and not i else ",") + x for i, x in enumerate(values)])], ["value"])
            first = False
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])


@query(f"SELECT sha256(text) AS text_sha256, count(*) AS n FROM conversations WHERE {_LONG} GROUP BY text")
def load_share_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = _turns_of(spark, sf_dir).select(F.transform("texts", lambda x: F.struct(x.alias("value"))).alias("conversations"))
    return _counted(corpus.share_json(spark, _array_file(shared, tables.scratch(spark, "share_json"))))


@query(f"SELECT sha256(text) AS text_sha256, count(*) AS n FROM conversations WHERE {_LONG} GROUP BY text")
def load_chat_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "chat_parquet")
    chats = _turns_of(spark, sf_dir).select(F.transform("texts", lambda x: F.struct(x.alias("content"))).alias("conversation"))
    chats.unionAll(spark.createDataFrame([(None,), ([],)], "conversation array<struct<content:string>>")).write.parquet(path)
    return _counted(corpus.chat_parquet(spark, path))


@query("SELECT sha256(trim(text)) AS text_sha256, count(*) AS n FROM conversations WHERE length(trim(text)) > 100 AND length(trim(text)) < 4000 GROUP BY trim(text)")
def load_dialogue_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated, with the looser bounds."""
    path = tables.scratch(spark, "dialogue_csv")
    turns(spark, sf_dir).select("conv_id", F.concat(F.lit("  "), "text").alias("text")).write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False)
    return _counted(corpus.dialogue_csv(spark, path, 100, 4_000))


@query("SELECT sha256(text) AS text_sha256, count(*) AS n FROM conversations GROUP BY text")
def load_turn_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object or string a line, by turns."""
    path = tables.scratch(spark, "turn_jsonl")
    line = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1))
    turns(spark, sf_dir).select(line.alias("value")).write.text(path)
    return _counted(corpus.turn_jsonl(spark, path))


@query("SELECT role, sha256(trim(text)) AS text_sha256, count(*) AS n FROM conversations WHERE length(trim(text)) > 20 GROUP BY role, trim(text)")
def load_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports with role or sender, and the text as string, as parts, or apart."""
    t = _turns_of(spark, sf_dir)
    messages = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.struct(F.lit("").alias("text"), x["texts"].alias("content"), x["roles"].alias("role")))
    parts = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.struct(F.array(F.struct(x["texts"].alias("text"))).alias("content"), x["roles"].alias("sender")))
    flat = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.struct(x["texts"].alias("text"), x["roles"].alias("sender")))
    found = None
    for i, (name, of) in enumerate((("messages", messages), ("chat_messages", parts), ("chat_messages", flat))):
        path = _array_file(t.where(F.col("conv_id") % 3 == i).select(of.alias(name)), tables.scratch(spark, "export_json"))
        one = corpus.export_json(spark, path)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("role", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")).agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS text_sha256, count(*) AS n FROM documents GROUP BY text")
def load_batch_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-prefixed batches, one file for some thousand rows, read back item by item."""
    path = tables.scratch(spark, "batches")
    corpus.save_batches(docs(spark, sf_dir), "text", path)
    return corpus.read_batches(spark, path).groupBy(F.sha2("data", 256).alias("text_sha256")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total, len(embedding) AS n FROM embeddings")
def load_vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors in their binary form, one file for some thousand rows."""
    path = tables.scratch(spark, "vectors")
    corpus.save_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec")), path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return corpus.read_vectors(spark, path).select(F.col("word").cast("long").alias("vec_id"), F.round(total, 4).alias("total"), F.size("vec").cast("long").alias("n"))
