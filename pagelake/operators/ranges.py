"""Byte ranges: gaps and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gaps(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end", label: str = "label") -> DataFrame:
    """Adds ``gap`` and ``overlap``: bytes between a range and the furthest end before it, or that they share. Equal starts go by end, then label."""
    before = Window.partitionBy(*keys).orderBy(start, end, label).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    return ranges.withColumn("gap", F.greatest(F.lit(0), F.col(start) - reach)).withColumn("overlap", F.greatest(F.lit(0), reach - F.col(start))).fillna(0, ["overlap"]).withColumn("gap", F.coalesce("gap", F.lit(0)))


def byte_map(ranges: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """Ranges with their gaps, and a row for what is left after the last."""
    own = ranges.select(*keys, "start", "end", "label")
    tail = own.groupBy(*keys).agg(F.max("end").alias("start")).join(sizes, keys).filter(F.col("size") > F.col("start")).select(*keys, "start", F.col("size").alias("end"), F.lit("tail").alias("label"))
    return gaps(own.unionByName(tail), keys)
