"""Per-site landscapes: Parquet as the working form, gzip text for exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuswise.operators.blocks import concat_fragments
from locuswise.sources.lines import numbered_lines, path_number

FILE_SITES = 10_000_000
#: Tasks that the diploids of one position range are spread over.
DIPLOID_BUCKETS = 32


def write_landscape(landscape: DataFrame, path: str) -> None:
    """Parquet by metric and block; a block is spread over files of bounded position range and part of the diploids."""
    bucket = F.pmod(F.xxhash64("diploid"), F.lit(DIPLOID_BUCKETS))
    (
        landscape.repartition("metric", "block_id", F.floor(F.col("pos") / FILE_SITES), bucket)
        .sortWithinPartitions("metric", "block_id", "diploid", "pos")
        .write.partitionBy("metric", "block_id")
        .parquet(path)
    )


def read_landscape(
    spark: SparkSession, path: str, metrics: Sequence[str] | None = None
) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.filter(F.col("metric").isin(list(metrics))) if metrics else rows


def _with_fragment(landscape: DataFrame, fragments: DataFrame, size: int) -> DataFrame:
    starts = fragments.groupBy("block_id").agg(F.min("frag_start").alias("_lo"))
    return landscape.join(starts, "block_id").withColumn(
        "file_index", (F.floor((F.col("pos") - F.col("_lo")) / F.lit(size)) + 1).cast("int")
    )


def write_landscape_text(
    landscape: DataFrame,
    fragments: DataFrame,
    size: int,
    path: str,
    columns: Sequence[str] = ("value",),
    per_file: int = 1,
) -> None:
    """Gzip text, one site per line and one file per (diploid, block, fragment).

    ``per_file`` consecutive fragments share a file that bears the index of the first of them: the driver lists
    and plans every file, so short fragments of long blocks want few files.
    """
    keys = ["diploid", "block_id", "file_index"]
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in columns])
    first = (F.floor((F.col("file_index") - 1) / F.lit(per_file)) * per_file + 1).cast("int")
    (
        _with_fragment(landscape, fragments, size)
        .withColumn("file_index", first)
        .repartition(*keys)
        .sortWithinPartitions(*keys, "pos")
        .select(*keys, line.alias("value"))
        .write.partitionBy(*keys)
        .option("compression", "gzip")
        .text(path)
    )


def _site_lines(spark, path):
    return numbered_lines(spark, path, keep=F.trim("value") != "").select(
        path_number("diploid").alias("diploid"),
        path_number("block(?:_id)?").alias("block_id"),
        path_number("file_index").alias("file_index"),
        (F.col("line") + 1).alias("site_index"),
        F.split(F.trim("value"), "\t").alias("f"),
    )


def read_landscape_text(spark: SparkSession, path: str) -> DataFrame:
    """(diploid, block_id, file_index, pos, value): fragments of a block joined in order, from 1."""
    parts = _site_lines(spark, path).withColumn("value", F.col("f")[0].cast("double")).drop("f")
    return concat_fragments(parts)


def read_landscape_pair(spark: SparkSession, path: str) -> DataFrame:
    """(diploid, block_id, file_index, pos, k, rate) from lines ``index<TAB>rate``."""
    parts = (
        _site_lines(spark, path)
        .withColumn("k", F.col("f")[0].cast("int"))
        .withColumn("rate", F.col("f")[1].cast("double"))
        .drop("f")
    )
    return concat_fragments(parts)
