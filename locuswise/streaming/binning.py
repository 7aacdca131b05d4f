"""Bin means of an unbounded landscape stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bins(landscape: DataFrame, width: str, delay: str) -> DataFrame:
    """Mean per (diploid, block, event-time window); a window is final once the watermark passes it.

    ``landscape(diploid, block_id, ts, value)`` with a timestamp ``ts``.
    """
    return (
        landscape.withWatermark("ts", delay)
        .groupBy("diploid", "block_id", F.window("ts", width).alias("w"))
        .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("sites"))
        .select(
            "diploid",
            "block_id",
            F.unix_seconds("w.start").alias("window_start"),
            "value",
            "sites",
        )
    )
