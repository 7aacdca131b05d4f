"""Small tab-separated tables: blocks, fragments, labels, estimates, demography."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuswise.sources.lines import numbered_lines

BLOCK_FIELDS = 7


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Seven tab-separated columns without header; line order gives ``block_id`` from 0."""
    lines = numbered_lines(spark, path, keep=F.trim("value") != "")
    f = F.transform(F.split("value", "\t"), lambda x: F.trim(x))
    whole = F.when(F.size(f) == BLOCK_FIELDS, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("block line without 7 columns: "), F.col("value"))).cast("boolean")
    )
    return lines.filter(whole).select(
        F.col("line").cast("int").alias("block_id"),
        f[0].alias("chrom"),
        f[1].cast("long").alias("start"),
        f[2].cast("long").alias("end"),
        f[5].cast("long").alias("lower_cut"),
        f[6].cast("long").alias("upper_cut"),
    )


def write_blocks(blocks: DataFrame, path: str) -> None:
    # one row per chromosome or scaffold, and line order carries the block id: one file
    (
        blocks.orderBy("block_id")
        .select(
            "chrom",
            "start",
            "end",
            F.lit(0).alias("zero"),
            (F.col("end") - F.col("start")).alias("width"),
            "lower_cut",
            "upper_cut",
        )
        .coalesce(1)
        .write.option("sep", "\t")
        .csv(path)
    )


def with_block_ids(table: DataFrame, blocks: DataFrame, unknown: str = "error") -> DataFrame:
    """Replace ``chrom`` by ``block_id``.

    A row of a chromosome that ``blocks`` lacks raises at run time; ``unknown="drop"`` leaves such rows out and
    ``unknown="null"`` keeps them without a block.
    """
    ids = blocks.select("chrom", "block_id")
    if unknown == "drop":
        return table.join(ids, "chrom").drop("chrom")
    joined = table.join(ids, "chrom", "left")
    if unknown == "error":
        message = F.concat(F.lit("chromosome without a block: "), F.coalesce("chrom", F.lit("null")))
        known = F.coalesce("block_id", F.raise_error(message).cast(blocks.schema["block_id"].dataType))
        joined = joined.withColumn("block_id", known)
    elif unknown != "null":
        raise ValueError(f"unknown rule {unknown!r} for chromosomes without a block")
    return joined.drop("chrom")


def write_fragments(fragments: DataFrame, path: str) -> None:
    """Header ``frag_start frag_end seq_block file_index``; blocks counted from 1."""
    (
        fragments.orderBy("block_id", "file_index")
        .select("frag_start", "frag_end", (F.col("block_id") + 1).alias("seq_block"), "file_index")
        .write.option("sep", "\t")
        .option("header", True)
        .csv(path)
    )


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    schema = "frag_start long, frag_end long, seq_block int, file_index int"
    rows = spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)
    return rows.select(
        (F.col("seq_block") - 1).alias("block_id"), "file_index", "frag_start", "frag_end"
    )


def write_diploid_labels(labels: DataFrame, path: str) -> None:
    (
        labels.orderBy("diploid_id")
        .select("decoding_label", "diploid_id")
        .write.option("sep", "\t")
        .option("header", True)
        .csv(path)
    )


def read_diploid_labels(spark: SparkSession, path: str) -> DataFrame:
    schema = "decoding_label string, diploid_id long"
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def write_estimates(params: DataFrame, path: str, loglik: float | None = None) -> None:
    """``name value`` lines in name order, after a first line with the log-likelihood if given."""
    lines = params.select(
        F.lit(2).alias("part"), "name", F.concat_ws(" ", "name", F.col("value").cast("string")).alias("value")
    )
    if loglik is not None:
        spark = params.sparkSession
        head = spark.createDataFrame(
            [(0, "", f"LogLikelihood = {loglik!r}"), (1, "", "")], "part int, name string, value string"
        )
        lines = head.unionByName(lines)
    lines.orderBy("part", "name").select("value").write.text(path)


def read_estimates(spark: SparkSession, path: str) -> DataFrame:
    """(name, value); lines that do not have exactly two tokens are passed over."""
    tokens = F.split(F.trim("value"), r"\s+")
    return (
        spark.read.text(path)
        .filter(F.size(tokens) == 2)
        .select(tokens[0].alias("name"), tokens[1].cast("double").alias("value"))
    )


def write_demography(scaled: DataFrame, path: str) -> None:
    """Header ``time_index left_time_boundary right_time_boundary lambda``, open last cell left out."""
    (
        scaled.filter("right_time_boundary IS NOT NULL")
        .orderBy("time_index")
        .select("time_index", "left_time_boundary", "right_time_boundary", "lambda")
        .write.option("sep", "\t")
        .option("header", True)
        .csv(path)
    )


def read_demography(spark: SparkSession, path: str) -> DataFrame:
    schema = "time_index int, left_time_boundary double, right_time_boundary double, lambda double"
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)
