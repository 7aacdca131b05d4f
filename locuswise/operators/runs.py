"""Run-length form of state sequences and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.functions.tiling import TILE, join_touching, neighbours
from locuswise.operators.calling import HETEROZYGOUS, MISSING

KEYS = ["diploid", "block_id"]


def as_runs(table: DataFrame) -> DataFrame:
    """Sites become runs of length one; runs pass through."""
    if "pos" not in table.columns:
        return table
    return table.select(
        *KEYS, F.col("pos").alias("start_pos"), F.col("pos").alias("end_pos"), "state"
    )


def rle_encode(table: DataFrame, tile: int = TILE) -> DataFrame:
    """Maximal runs of equal state from sites or from shorter runs."""
    merged = join_touching(as_runs(table), KEYS, ["state"], tile)
    return merged.select(*KEYS, "start_pos", "end_pos", "state")


def expand_runs(runs: DataFrame) -> DataFrame:
    """Dense sites; only for outputs that need one row per site."""
    return runs.select(
        *KEYS, F.explode(F.sequence("start_pos", "end_pos")).alias("pos"), "state"
    )


def run_length():
    return F.col("end_pos") - F.col("start_pos") + 1


def missing_runs(runs: DataFrame, threshold: int) -> DataFrame:
    """Maximal missing runs of at least ``threshold`` sites."""
    return (
        runs.filter(F.col("state") == MISSING)
        .withColumn("length", run_length())
        .filter(F.col("length") >= threshold)
        .drop("state")
    )


def informative_regions(
    runs: DataFrame, threshold: int, min_length: int = 1_000_000, tile: int = TILE
) -> DataFrame:
    """Stretches of a block between long missing runs, kept when longer than ``min_length``."""
    gaps = missing_runs(runs, threshold).select(*KEYS, "start_pos", "end_pos")
    extent = runs.groupBy(*KEYS).agg(
        F.min("start_pos").alias("_lo"), F.max("end_pos").alias("_hi")
    )
    fence = extent.select(*KEYS, F.explode(F.array(F.col("_lo") - 1, F.col("_hi") + 1)).alias("start_pos"))
    walls = gaps.unionByName(fence.withColumn("end_pos", F.col("start_pos")))
    linked = neighbours(walls, KEYS, "start_pos", previous="prev", tile=tile)
    return (
        linked.filter("prev IS NOT NULL")
        .select(
            *KEYS,
            (F.col("prev.end_pos") + 1).alias("start_pos"),
            (F.col("start_pos") - 1).alias("end_pos"),
        )
        .withColumn("length", run_length())
        .filter(F.col("length") > min_length)
    )


def diploid_theta(runs: DataFrame) -> DataFrame:
    length = run_length()
    return (
        as_runs(runs)
        .groupBy("diploid")
        .agg(
            F.sum(F.when(F.col("state") == HETEROZYGOUS, length).otherwise(0)).alias("het_sites"),
            F.sum(F.when(F.col("state") != MISSING, length).otherwise(0)).alias("callable_sites"),
        )
        .withColumn("theta", F.col("het_sites") / F.nullif(F.col("callable_sites"), F.lit(0)))
    )


def theta_estimate(runs: DataFrame) -> DataFrame:
    """Unweighted mean over diploids; must be positive."""
    mean = diploid_theta(runs).agg(
        F.avg("theta").alias("theta"), F.count(F.lit(1)).alias("diploids")
    )
    checked = F.when(F.col("theta") > 0, F.col("theta")).otherwise(
        F.raise_error(F.lit("theta estimate is not positive")).cast("double")
    )
    return mean.withColumn("theta", checked)


def observed_states(runs: DataFrame) -> DataFrame:
    """Distinct symbols per diploid and whether all diploids agree on their number."""
    symbols = as_runs(runs).select("diploid", "state").distinct()
    counts = symbols.groupBy("diploid").agg(F.count(F.lit(1)).alias("n_states"))
    return counts.agg(
        F.min("n_states").alias("min_states"),
        F.max("n_states").alias("max_states"),
        F.count(F.lit(1)).alias("diploids"),
    ).withColumn("agree", F.col("min_states") == F.col("max_states"))


def state_counts(runs: DataFrame) -> DataFrame:
    return as_runs(runs).groupBy(*KEYS, "state").agg(F.sum(run_length()).alias("sites"))


def variant_counts(sites: DataFrame) -> DataFrame:
    """Per diploid: heterozygous, callable and missing sites."""
    length = run_length()

    def total(condition):
        return F.sum(F.when(condition, length).otherwise(0))

    return (
        as_runs(sites)
        .groupBy("diploid")
        .agg(
            total(F.col("state") == HETEROZYGOUS).alias("het_sites"),
            total(F.col("state") != MISSING).alias("callable_sites"),
            total(F.col("state") == MISSING).alias("missing_sites"),
        )
    )


def polymorphic_sites(sites: DataFrame) -> DataFrame:
    """Per block: positions where at least one diploid is heterozygous."""
    return (
        sites.filter(F.col("state") == HETEROZYGOUS)
        .select("block_id", "pos")
        .distinct()
        .groupBy("block_id")
        .agg(F.count(F.lit(1)).alias("polymorphic"))
    )
