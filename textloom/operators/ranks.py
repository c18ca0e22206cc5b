"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.tables import numbered


def percentiles_at(counts: DataFrame, key: str, value: str, n: str, shares: dict[str, float]) -> DataFrame:
    """key and for each share the value at place floor(share x rows) of the key's rows in order, counts (key, value, n)
    saying how often each value occurs.

    The order is parted by ranges; what lies before a part is a sum over at most as many rows as there are parts and keys.
    """
    placed, _ = numbered(counts, [key, value], "place")
    part = F.shiftright("place", 16)  # runs of 65,536 places
    placed = placed.withColumn("part", part)
    sums = placed.groupBy(key, "part").agg(F.sum(n).alias("own"))
    before = sums.select(key, "part", (F.sum("own").over(Window.partitionBy(key).orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy(key)).alias("rows"))
    upto = F.sum(n).over(Window.partitionBy(key, "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("upto", upto).join(before, [key, "part"]).withColumn("end", F.col("before") + F.col("upto"))
    at = lambda p: F.least(F.col("rows") - 1, F.floor(F.lit(p) * F.col("rows")))
    inside = lambda p: (at(p) < F.col("end")) & (at(p) >= F.col("end") - F.col(n))
    return ranked.groupBy(key).agg(*(F.max(F.when(inside(p), F.col(value))).alias(c) for c, p in shares.items()))
