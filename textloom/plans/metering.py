"""Queries of usage metering: events as calls, user_id as key, value as MB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import bytesview as B

from .registry import query

PLANS = {"free": 100.0, "starter": 5_000.0, "pro": 25_000.0}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account for each customer: key hash, plan by segment, activity by balance."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    plan = F.when(F.col("c_custkey") % 5 == 0, "pro").when(F.col("c_custkey") % 2 == 0, "starter").otherwise("free")
    return c.select(F.col("c_custkey").alias("user_id"), F.sha2(F.concat(F.lit("key_"), F.col("c_custkey").cast("string")), 256).alias("key_hash"), plan.alias("plan"), (F.col("c_acctbal") > 0).alias("active"))


_KEYS = "k AS (SELECT c_custkey AS user_id, sha256('key_' || c_custkey) AS key_hash, CASE WHEN c_custkey % 5 = 0 THEN 'pro' WHEN c_custkey % 2 = 0 THEN 'starter' ELSE 'free' END AS plan, c_acctbal > 0 AS active FROM customer)"
_LIMIT = "CASE plan WHEN 'pro' THEN 25000::DOUBLE WHEN 'starter' THEN 5000::DOUBLE ELSE 100::DOUBLE END"


def limit_of(plan: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for p in PLANS.items() for x in p))[plan], F.lit(PLANS["free"]))


@query(f"WITH {_KEYS} SELECT k.user_id, round(coalesce(sum(value), 0), 4) AS mb, count(event_id) AS calls FROM k LEFT JOIN events e ON e.user_id = k.user_id GROUP BY k.user_id")
def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = events(spark, sf_dir).groupBy("user_id").agg(F.sum("value").alias("v"), F.count("event_id").alias("n"))
    return keys(spark, sf_dir).select("user_id").join(used, "user_id", "left").select("user_id", F.round(F.coalesce("v", F.lit(0.0)), 4).alias("mb"), F.coalesce("n", F.lit(0)).alias("calls"))


@query("SELECT user_id, strftime(ts, '%Y-%m') AS month, round(sum(value), 4) AS mb, count(*) AS calls FROM events GROUP BY ALL")
def usage_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.round(F.sum("value"), 4).alias("mb"), F.count("*").alias("calls"))


@query(f"WITH {_KEYS} SELECT e.event_id, k.plan FROM events e JOIN k ON k.key_hash = sha256('key_' || e.user_id) WHERE k.active")
def auth_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = events(spark, sf_dir).select("event_id", F.sha2(F.concat(F.lit("key_"), F.col("user_id").cast("string")), 256).alias("key_hash"))
    return calls.join(keys(spark, sf_dir).where("active"), "key_hash").select("event_id", "plan")


@query(f"""WITH {_KEYS}, u AS (SELECT user_id, sum(value) AS mb, min(ts) AS first_seen FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT k.user_id, CASE WHEN NOT active THEN 'invalid' WHEN plan = 'free' AND coalesce(mb, 0) >= {_LIMIT} THEN 'over_limit' WHEN plan = 'free' AND first_seen + INTERVAL 14 DAY < now THEN 'trial_expired' ELSE 'ok' END AS status
FROM k LEFT JOIN u ON u.user_id = k.user_id CROSS JOIN n""")
def quota_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    used = e.groupBy("user_id").agg(F.sum("value").alias("mb"), F.min("ts").alias("first_seen"))
    k = keys(spark, sf_dir).join(used, "user_id", "left").crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    free = F.col("plan") == "free"
    status = F.when(~F.col("active"), "invalid").when(free & (F.coalesce("mb", F.lit(0.0)) >= limit_of(F.col("plan"))), "over_limit")
    return k.select("user_id", status.when(free & (F.col("first_seen") + F.expr("INTERVAL 14 DAYS") < F.col("now")), "trial_expired").otherwise("ok").alias("status"))


@query("""SELECT user_id, CASE WHEN kind = 'purchase' THEN 'pro' WHEN kind = 'signup' THEN 'starter' ELSE 'free' END AS plan FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id)""")
def latest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan that each key's latest event leaves it with."""
    last = events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    return last.select("user_id", F.when(F.col("kind") == "purchase", "pro").when(F.col("kind") == "signup", "starter").otherwise("free").alias("plan"))


@query(f"WITH {_KEYS} SELECT user_id, first_event FROM (SELECT user_id, min(event_id) AS first_event FROM events GROUP BY user_id) e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = e.user_id AND active)")
def signup_new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert with uniqueness: the first call of each user that has no active key."""
    first = events(spark, sf_dir).groupBy("user_id").agg(F.min("event_id").alias("first_event"))
    return first.join(keys(spark, sf_dir).where("active"), "user_id", "left_anti")


@query(f"WITH {_KEYS} SELECT user_id, plan, 0::DOUBLE AS mb_used, {_LIMIT} AS mb_limit FROM k")
def monthly_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys(spark, sf_dir).select("user_id", "plan", F.lit(0.0).alias("mb_used"), limit_of(F.col("plan")).alias("mb_limit"))


@query("SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS calls, count(*) > 60 AS refused FROM events GROUP BY ALL")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = events(spark, sf_dir).groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("calls"))
    return w.select("user_id", F.col("w.start").alias("minute"), "calls", (F.col("calls") > 60).alias("refused"))


@query("SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter, count(*) AS calls, greatest(count(*) - 10, 0) AS refused FROM events WHERE event_type = 'signup' GROUP BY ALL")
def signup_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stricter limit of sign-ups: ten in fifteen minutes, and how many calls beyond it are refused."""
    w = events(spark, sf_dir).where("event_type = 'signup'").groupBy("user_id", F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("calls"))
    return w.select("user_id", F.col("w.start").alias("quarter"), "calls", F.greatest(F.col("calls") - 10, F.lit(0)).alias("refused"))


@query("SELECT substr('key_' || sha256('key_' || user_id), 1, 12) AS key_prefix, count(*) AS calls FROM events GROUP BY key_prefix")
def calls_by_key_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage log by what is kept of a key, its first twelve characters."""
    key = F.concat(F.lit("key_"), F.sha2(F.concat(F.lit("key_"), F.col("user_id").cast("string")), 256))
    return events(spark, sf_dir).groupBy(B.key_prefix(key).alias("key_prefix")).agg(F.count("*").alias("calls"))


@query("SELECT user_id, CAST(sum(ceil(value * 10)) AS BIGINT) AS units FROM events GROUP BY user_id")
def meter_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.sum(F.ceil(F.col("value") * 10)).cast("long").alias("units"))


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS mb_so_far FROM events")
def usage_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf_dir).select("user_id", "event_id", F.round(F.sum("value").over(w), 4).alias("mb_so_far"))
