"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuswise.functions.lineage import settled

#: White space of the word rules: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
ROW = "_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_row_key(df: DataFrame) -> DataFrame:
    """Add ``_row``, one number per row.

    The number follows from the partition and the place in it, so ``df`` must be a scan of stored
    files: then a task that is run again gives the same numbers. Each job cuts the files anew, by the cores it
    finds: what is read more than once must be written with its numbers first.
    """
    return df.withColumn(ROW, F.monotonically_increasing_id())


def boxed(df: DataFrame) -> DataFrame:
    """(doc_id, text, source if there, ``_row``, ``_doc``): all columns of ``df`` lie in ``_doc``, where no name can clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc")
    used = [c for c in ("doc_id", "text", "source") if c in df.columns]
    return df.select(whole, *used, F.monotonically_increasing_id().alias(ROW))


def stored_box(df: DataFrame) -> DataFrame:
    """A boxed table that is written once, so that all its readers find the same ``_row``; text and doc_id are read out of ``_doc``."""
    rows = settled(boxed(df).select("_doc", ROW), "rows")
    used = [c for c in ("doc_id", "text", "source") if c in df.columns]
    return rows.select("_doc", *[F.col("_doc")[c].alias(c) for c in used], ROW)


def keep_rows(box: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of a boxed table whose ``_row`` is in ``kept``, with the columns they had."""
    return box.join(kept.select(ROW).hint("shuffle_hash"), ROW, "left_semi").select("_doc.*")
