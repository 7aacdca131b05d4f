"""Variant call text files and masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuswise.functions.lineage import settled

FIXED_WITH_FORMAT, FIXED_WITHOUT = 9, 8


def _file_key(column):
    return F.regexp_replace(column, "^[a-z0-9]+:/+", "/")


def _headers(spark: SparkSession, path) -> DataFrame:
    """(file, fixed, samples) of the first header line of each file, in one job over all files."""
    lines = spark.read.text(path).select("value", _file_key(F.col("_metadata.file_path")).alias("file"))
    cols = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    heads = lines.filter(F.col("value").startswith("#CHROM")).groupBy("file").agg(F.min("value").alias("value"))
    fixed = F.when(F.array_contains(cols, "FORMAT"), FIXED_WITH_FORMAT).otherwise(FIXED_WITHOUT)
    return heads.select("file", fixed.alias("fixed"), F.slice(cols, fixed + 1, F.size(cols)).alias("samples"))


def read_variants(
    spark: SparkSession, path, chroms: Sequence[str] | None = None
) -> DataFrame:
    """(chrom, pos, filter, sample, gt), one row per site and sample. Any codec Spark reads.

    A gzip file is read by one task; block-compressed text splits by itself. A file without a header line is an error.
    """
    headers = settled(_headers(spark, path), "headers")
    files = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file string")
    bare = files.select(_file_key(F.col("file")).alias("file")).join(headers, "file", "left_anti").first()
    if bare is not None:
        raise ValueError(f"no #CHROM header in {bare['file']}")
    lines = spark.read.text(path).select("value", _file_key(F.col("_metadata.file_path")).alias("file"))
    cols = F.split(F.rtrim("value"), "\t")
    sites = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        "file", cols.alias("cols")
    )
    if chroms is not None:
        sites = sites.filter(F.col("cols")[0].isin(list(chroms)))
    # one row per file: the lines of compressed files are larger than their bytes say and must not be the side sent round
    joined = sites.join(F.broadcast(headers), "file")
    calls = F.arrays_zip(
        F.col("samples").alias("sample"),
        F.slice("cols", F.col("fixed") + 1, F.size("samples")).alias("gt"),
    )
    return joined.select(
        F.col("cols")[0].alias("chrom"),
        F.col("cols")[1].cast("long").alias("pos"),
        F.col("cols")[6].alias("filter"),
        F.explode(calls).alias("c"),
    ).select("chrom", "pos", "filter", F.col("c.sample").alias("sample"), F.col("c.gt").alias("gt"))


def with_diploid_ids(variants: DataFrame, samples: DataFrame, unknown: str = "error") -> DataFrame:
    """Replace ``sample`` by the ``diploid`` of ``samples(sample, diploid)``.

    A record of a sample that ``samples`` lacks raises at run time; ``unknown="drop"`` leaves such records out.
    """
    if unknown == "drop":
        return variants.join(samples, "sample").drop("sample")
    if unknown != "error":
        raise ValueError(f"unknown rule {unknown!r} for samples without a diploid")
    message = F.concat(F.lit("sample without a diploid: "), F.coalesce("sample", F.lit("null")))
    known = F.coalesce("diploid", F.raise_error(message).cast(samples.schema["diploid"].dataType))
    return variants.join(samples.select("sample", "diploid"), "sample", "left").withColumn("diploid", known).drop("sample")


def read_mask_bed(spark: SparkSession, path) -> DataFrame:
    """(chrom, start0, end0), 0-based half-open. A blank or short line is an error."""
    f = F.split("value", "\t")
    good = F.when(
        (F.trim("value") != "") & (F.size(f) >= 3) & (f[1].try_cast("long") < f[2].try_cast("long")),
        F.lit(True),
    ).otherwise(F.raise_error(F.concat(F.lit("bad mask line: "), F.col("value"))).cast("boolean"))
    return (
        spark.read.text(path)
        .filter(good)
        .select(f[0].alias("chrom"), f[1].cast("long").alias("start0"), f[2].cast("long").alias("end0"))
    )
