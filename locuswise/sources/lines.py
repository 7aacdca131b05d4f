"""Text lines with their number inside the file, without a driver pass or a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(
    spark: SparkSession, path, keep: Column | None = None, separator: str | None = None
) -> DataFrame:
    """(file, line, value): 0-based line numbers over the kept lines of each file.

    Lines are counted per file split; the splits' running totals give the offsets, so only one row
    per split is ordered. The offsets are broadcast: the driver plans every split anyway, while the
    size of the lines is unknown (the bytes of compressed files say little) and must not decide.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    raw = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
    )
    if keep is not None:
        raw = raw.filter(keep)
    raw = raw.withColumn("_seq", F.monotonically_increasing_id())
    splits = raw.groupBy("file", "_split").agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "file",
        "_split",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    return raw.join(F.broadcast(offsets), ["file", "_split"]).select(
        "file", (F.col("_offset") + F.col("_seq") - F.col("_first")).alias("line"), "value"
    )


def path_number(name: str) -> Column:
    """Integer after ``name_`` or ``name=`` in the file path."""
    return F.regexp_extract(F.col("file"), rf"{name}[_=](\d+)", 1).cast("int")
