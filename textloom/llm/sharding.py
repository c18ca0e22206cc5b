"""Sharding through fixed virtual slots.

A record's slot depends on its id alone and never changes; which shard a slot is on stands in a small versioned map.
Version 1 spreads the slots evenly; each rebalancing adds a version that moves as few bytes as it can.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, written

SLOTS = 4096
MAP = "slot int, shard int, version int"


def slot_of(id_col: Column, slots: int = SLOTS) -> Column:
    """The slot of an id: the first 32 bits of the MD5 of its form as a string, modulo slots; a null id has slot 0."""
    return F.coalesce(F.pmod(F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(slots)), F.lit(0)).cast("int")


def slot_bytes(records: DataFrame, id_col: str, text_col: str, slots: int = SLOTS) -> DataFrame:
    """(slot, records, bytes) of every slot, those without records included."""
    used = records.select(slot_of(F.col(id_col), slots).alias("slot"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("size"))
    used = used.groupBy("slot").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(F.broadcast(used), "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("records"), F.coalesce("b", F.lit(0)).alias("bytes"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """(version, slot, shard): version 1, equal runs of slots."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("slot"), F.expr(f"id * {shards} div {slots}").cast("int").alias("shard"))


def rebalanced(sizes: DataFrame, current: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """(version, slot, shard): current's next version, in which shards above (1 + tolerance) x the mean give slots away.

    A shard keeps its slots from the largest down while their bytes fit. The slots that don't are laid end to end,
    largest first, along the free room of all shards, laid end to end by shard, and go to the shard at their middle.
    So no slot moves that can stay, and a shard exceeds the limit by less than the last slot that it takes.
    A shard number of current that is not below shards gives all its slots away: so the map shrinks and grows.
    All of it is over the fixed number of slots.
    """
    limit = F.expr(f"cast(ceil(total * (1 + {tolerance}D) / {shards}) as bigint)")
    by_size = [F.col("bytes").desc(), F.col("slot")]
    at = current.join(F.broadcast(sizes), "slot").withColumn("total", F.sum("bytes").over(Window.partitionBy(F.lit(0)))).withColumn("limit", limit)
    at = at.withColumn("upto", F.sum("bytes").over(Window.partitionBy("shard").orderBy(*by_size).rowsBetween(Window.unboundedPreceding, 0)))
    stays = (F.col("upto") <= F.col("limit")) & (F.col("shard") < shards)
    at = written(at.withColumn("stays", stays), "slots")
    held = at.where("stays").groupBy("shard").agg(F.max("upto").alias("held"))
    total = at.agg(F.max("limit").alias("limit"))
    room = sizes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(held, "shard", "left").crossJoin(F.broadcast(total))
    room = room.withColumn("room", F.col("limit") - F.coalesce("held", F.lit(0))).withColumn("high", F.sum("room").over(Window.partitionBy(F.lit(0)).orderBy("shard")))
    room = room.select(F.col("shard").alias("into"), (F.col("high") - F.col("room")).alias("low"), "high")
    moving = at.where("not stays").withColumn("end", F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy(*by_size).rowsBetween(Window.unboundedPreceding, 0)))
    moving = moving.withColumn("middle", F.expr("end - bytes + bytes div 2"))
    placed = moving.join(F.broadcast(room), F.expr("middle >= low and middle < high"), "left")
    placed = placed.select("version", "slot", F.coalesce("into", F.lit(shards - 1)).alias("shard"))
    return at.where("stays").select("version", "slot", "shard").unionAll(placed).withColumn("version", F.col("version") + 1)


def store(map_version: DataFrame, path: str) -> None:
    """Adds versions to the map's table; a version that is there already raises, as one is never written over."""
    spark = map_version.sparkSession
    fresh = {r[0] for r in map_version.select("version").distinct().collect()}
    there = set(versions(spark, path))
    if fresh & there:
        raise ValueError(f"the map at {path} has version {min(fresh & there)} already")
    map_version.write.partitionBy("version").mode("append").parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of the map at path, none if there is no map."""
    try:
        every = spark.read.schema(MAP).parquet(path)
        return sorted(r[0] for r in every.select("version").distinct().collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(slot, shard, version) of one version, by default the latest; one that isn't there raises."""
    there = versions(spark, path)
    wanted = version if version is not None else max(there, default=None)
    if wanted not in there:
        raise ValueError(f"the map at {path} has no version {wanted}")
    return spark.read.schema(MAP).parquet(path).where(F.col("version") == wanted)


def assign(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 24, slots: int = SLOTS, tolerance: float = 0.02, path: str | None = None) -> DataFrame:
    """(doc_id, slot, first_shard, shard): every record's slot, and its shard before and after a rebalancing.

    path: of the map's versioned table, by default one of its own in the shared folder. If it has no map yet version 1
    spreads the slots evenly; the latest version is rebalanced by the bytes of the slots and stored as the next one, and
    both are read from the table. The slot depends on the id as it is, whatever its type.
    A null id is in slot 0, a null text has no bytes, a very long one counts whole. Rows that repeat an id share its slot.
    Ties in bytes go by slot. An empty table leaves the map as it is. Extra columns are ignored. What is broadcast is the
    map, of a fixed number of rows.
    """
    spark = records.sparkSession
    path = path or scratch(spark, "slot_map")
    sizes = written(slot_bytes(records, id_col, text_col, slots), "slot_bytes")
    if not versions(spark, path):
        store(first_map(spark, shards, slots), path)
    before = load(spark, path)
    store(rebalanced(sizes, before, shards, tolerance), path)
    both = before.select("slot", F.col("shard").alias("first_shard")).join(F.broadcast(load(spark, path).select("slot", "shard")), "slot")
    slim = records.select(F.col(id_col).alias("doc_id")).withColumn("slot", slot_of(F.col("doc_id"), slots))
    return slim.join(F.broadcast(both), "slot").select("doc_id", "slot", "first_shard", "shard")


ORACLE = f"""
WITH s AS (
  SELECT doc_id, coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {SLOTS}, 0) AS slot,
         coalesce(octet_length(encode(text)), 0) AS size
  FROM documents
), sizes AS (
  SELECT r.slot, coalesce(u.b, 0) AS bytes, r.slot * 24 // {SLOTS} AS shard
  FROM range({SLOTS}) AS r(slot) LEFT JOIN (SELECT slot, sum(size) AS b FROM s GROUP BY slot) u ON u.slot = r.slot
), ranked AS (
  SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, slot ROWS UNBOUNDED PRECEDING) AS upto,
         CAST(ceil((SELECT sum(bytes) FROM sizes) * CAST(1.02 AS DOUBLE) / 24) AS BIGINT) AS lim
  FROM sizes
), room AS (
  SELECT r.shard, max(lim) - coalesce(max(upto) FILTER (upto <= lim), 0) AS room
  FROM range(24) AS r(shard) LEFT JOIN ranked k ON k.shard = r.shard GROUP BY r.shard
), laid AS (
  SELECT shard, sum(room) OVER (ORDER BY shard) - room AS low, sum(room) OVER (ORDER BY shard) AS high FROM room
), moving AS (
  SELECT slot, sum(bytes) OVER (ORDER BY bytes DESC, slot ROWS UNBOUNDED PRECEDING) - bytes + bytes // 2 AS middle
  FROM ranked WHERE upto > lim
), placed AS (
  SELECT slot, shard FROM ranked WHERE upto <= lim
  UNION ALL
  SELECT m.slot, coalesce(l.shard, 23) FROM moving m LEFT JOIN laid l ON m.middle >= l.low AND m.middle < l.high
)
SELECT s.doc_id, CAST(s.slot AS INT) AS slot, CAST(s.slot * 24 // {SLOTS} AS INT) AS first_shard, CAST(p.shard AS INT) AS shard
FROM s JOIN placed p ON p.slot = s.slot
"""
