"""The corpus pipeline: toxicity, exact copies, near copies, mixing and packing, each stage stored and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locuswise.functions.lineage import scratch_folder
from locuswise.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from locuswise.llm.common import ROW, table


def _toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs).drop(ROW)


STAGES = [
    ("toxicity", _toxic),
    ("exact_dedup", _exact),
    ("near_dedup", _near),
    ("mix_sources", _mix),
    ("pack_sequences", _pack),
]

#: Toxicity, near copies and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; what lies between is written beside the checkpoints."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
