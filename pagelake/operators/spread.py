"""Dealing of few partitions to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it has fewer than two partitions for each (a small file is one, however many cores wait); a large one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if not df.isStreaming and df.rdd.getNumPartitions() < 2 * cores else df
