"""Wide binned maps: one file set per bin size, one column per diploid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuswise.operators.blocks import window_coords


def size_suffix(size: int) -> str:
    if size % 1_000_000 == 0:
        return f"{size // 1_000_000}Mb"
    if size % 1_000 == 0:
        return f"{size // 1_000}kb"
    return f"{size}b"


def wide_map(
    bins: DataFrame,
    blocks: DataFrame,
    diploids: list,
    joint: DataFrame | None = None,
    compat: bool = False,
) -> DataFrame:
    """chrom, chromStart, chromEnd, one column per diploid, then sample_mean and joint_decode.

    ``compat`` names chromosomes ``chr1, chr2, ...`` by block order and keeps 1-based starts.
    """
    placed = window_coords(bins, blocks, compat)
    if compat:
        placed = placed.withColumn("chrom", F.concat(F.lit("chr"), F.col("block_id") + 1))
    keys = ["bin_size", "block_id", "bin", "chrom", "chrom_start", "chrom_end"]
    each = [F.max(F.when(F.col("diploid") == d, F.col("value"))).alias(str(d)) for d in diploids]
    wide = placed.groupBy(*keys).agg(*each, F.avg("value").alias("sample_mean"))
    if len(diploids) == 1:
        wide = wide.drop("sample_mean")
    if joint is not None:
        shared = joint.select("block_id", "bin_size", "bin", F.col("value").alias("joint_decode"))
        wide = wide.join(shared, ["block_id", "bin_size", "bin"], "left")
    return wide.withColumnsRenamed({"chrom_start": "chromStart", "chrom_end": "chromEnd"})


def write_bedgraph(
    bins: DataFrame,
    blocks: DataFrame,
    prefix: str,
    diploids: list,
    sizes: list[int],
    joint: DataFrame | None = None,
    compat: bool = False,
) -> list[str]:
    """``<prefix>.<size>.bedgraph`` per bin size, ordered by block and bin."""
    wide = wide_map(bins, blocks, diploids, joint, compat)
    paths = []
    for size in sizes:
        path = f"{prefix}.{size_suffix(size)}.bedgraph"
        (
            wide.filter(F.col("bin_size") == size)
            .orderBy("block_id", "bin")
            .drop("bin_size", "block_id", "bin")
            .write.option("sep", "\t")
            .option("header", True)
            .csv(path)
        )
        paths.append(path)
    return paths


def read_bedgraph(spark: SparkSession, path: str, label: str, window_size: str) -> DataFrame:
    """(chrom, chrom_start, chrom_end, diploid, value, label, window_size)."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    named = [c for c in wide.columns[3:] if not c.startswith("_c")]
    long = wide.unpivot(wide.columns[:3], named, "diploid", "value")
    return long.select(
        F.col(wide.columns[0]).alias("chrom"),
        F.col(wide.columns[1]).cast("long").alias("chrom_start"),
        F.col(wide.columns[2]).cast("long").alias("chrom_end"),
        "diploid",
        F.col("value").cast("double").alias("value"),
        F.lit(label).alias("label"),
        F.lit(window_size).alias("window_size"),
    )
