"""Multi-resolution binning of landscapes and state sequences, and operations on the maps."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuswise.operators.blocks import trimmed_limits
from locuswise.operators.calling import HETEROZYGOUS, MISSING
from locuswise.operators.overlay import overlay
from locuswise.operators.runs import as_runs

DEFAULT_SIZES = (10_000, 100_000, 1_000_000)


def _roll_up(cells: DataFrame, keys, step: int, sizes: Sequence[int], totals: Sequence[str]) -> DataFrame:
    """Partial sums at the common step, re-summed for each size: one pass over the sites."""
    sizes = sorted({int(s) for s in sizes})
    return (
        cells.withColumn("bin_size", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])))
        .withColumn("bin", F.floor(F.col("_cell") * F.lit(step) / F.col("bin_size")).cast("long"))
        .groupBy(*keys, "bin_size", "bin")
        .agg(*[F.sum(t).alias(t) for t in totals])
    )


def bin_sums(
    landscape: DataFrame,
    blocks: DataFrame,
    sizes: Sequence[int],
    totals: Mapping[str, Column],
    keys: Sequence[str] = ("block_id", "diploid"),
) -> DataFrame:
    """Sums of column expressions per bin, counted from the clamped lower cut-off of the block."""
    step = math.gcd(*[int(s) for s in sizes])
    keys = list(keys)
    cells = (
        landscape.join(trimmed_limits(blocks), "block_id")
        .filter(F.col("pos").between(F.col("_lower"), F.col("_upper")))
        .withColumn("_cell", F.floor((F.col("pos") - F.col("_lower")) / F.lit(step)))
        .groupBy(*keys, "_cell")
        .agg(*[F.sum(expr).alias(name) for name, expr in totals.items()])
    )
    return _roll_up(cells, keys, step, sizes, list(totals))


def bin_rate(
    landscape: DataFrame,
    blocks: DataFrame,
    sizes: Sequence[int] = DEFAULT_SIZES,
    keys: Sequence[str] = ("block_id", "diploid"),
) -> DataFrame:
    """Mean value per bin."""
    sums = bin_sums(landscape, blocks, sizes, {"total": F.col("value"), "sites": F.lit(1)}, keys)
    return sums.withColumn("value", F.col("total") / F.col("sites")).drop("total")


def bin_tmrca(
    landscape: DataFrame, blocks: DataFrame, sizes: Sequence[int] = DEFAULT_SIZES
) -> DataFrame:
    """Mean coalescence time per bin; expects its values in ``tmrca``."""
    renamed = landscape.withColumn("value", F.col("tmrca"))
    return bin_rate(renamed, blocks, sizes).withColumnRenamed("value", "tmrca")


def bin_rate_dropping_last(
    landscape: DataFrame, blocks: DataFrame, sizes: Sequence[int] = DEFAULT_SIZES
) -> DataFrame:
    """Bin means whose sum leaves out each bin's last site while the divisor counts it."""
    limits = trimmed_limits(blocks)
    sites = landscape.join(limits, "block_id").filter(
        F.col("pos").between(F.col("_lower"), F.col("_upper"))
    )
    each = F.explode(F.array(*[F.lit(int(s)).cast("long") for s in sizes]))
    binned = (
        sites.withColumn("bin_size", each)
        .withColumn("bin", F.floor((F.col("pos") - F.col("_lower")) / F.col("bin_size")))
        .groupBy("block_id", "diploid", "bin_size", "bin")
        .agg(
            F.sum("value").alias("total"),
            F.count(F.lit(1)).alias("sites"),
            F.max_by("value", "pos").alias("last"),
        )
    )
    return binned.withColumn("value", (F.col("total") - F.col("last")) / F.col("sites")).drop(
        "total", "last"
    )


def run_sums(
    runs: DataFrame,
    blocks: DataFrame,
    sizes: Sequence[int],
    totals: Mapping[str, Column],
    keys: Sequence[str] = ("block_id", "diploid"),
) -> DataFrame:
    """Sums per bin straight from runs; ``totals`` are expressions over a run's columns and ``_len``, its sites in the bin.

    A run contributes its overlap with each bin, so dense sites are never produced. Sizes whose common
    step is far below the smallest of them are binned one by one.
    """
    step = math.gcd(*[int(s) for s in sizes])
    if len(sizes) > 1 and 4 * step < min(sizes):
        return reduce(lambda a, b: a.unionByName(b), [run_sums(runs, blocks, [s], totals, keys) for s in sizes])
    keys = list(keys)
    clipped = (
        runs.join(trimmed_limits(blocks), "block_id")
        .withColumn("start_pos", F.greatest("start_pos", "_lower") - F.col("_lower"))
        .withColumn("end_pos", F.least("end_pos", "_upper") - F.col("_lower"))
        .filter("start_pos <= end_pos")
    )
    first = F.floor(F.col("start_pos") / F.lit(step))
    last = F.floor(F.col("end_pos") / F.lit(step))
    overlap = (
        F.least(F.col("end_pos"), (F.col("_cell") + 1) * F.lit(step) - 1)
        - F.greatest(F.col("start_pos"), F.col("_cell") * F.lit(step))
        + 1
    )
    cells = (
        clipped.withColumn("_cell", F.explode(F.sequence(first, last)))
        .withColumn("_len", overlap)
        .groupBy(*keys, "_cell")
        .agg(*[F.sum(expr).alias(name) for name, expr in totals.items()])
    )
    return _roll_up(cells, keys, step, sizes, list(totals))


def bin_states(
    states: DataFrame, blocks: DataFrame, sizes: Sequence[int] = DEFAULT_SIZES
) -> DataFrame:
    """Missing, heterozygous and total sites per bin, straight from runs (or sites)."""
    totals = {
        "missing_sites": F.when(F.col("state") == MISSING, F.col("_len")).otherwise(0),
        "het_sites": F.when(F.col("state") == HETEROZYGOUS, F.col("_len")).otherwise(0),
        "sites": F.col("_len"),
    }
    return run_sums(as_runs(states), blocks, sizes, totals)


def bins_in_time(
    times: DataFrame,
    states: DataFrame,
    rates: DataFrame,
    blocks: DataFrame,
    sizes: Sequence[int],
    lowest: int,
    highest: int,
) -> DataFrame:
    """Rate, missing share and diversity per bin over the sites whose decoded time index lies in ``[lowest, highest)``.

    ``times`` (k), ``states`` (state) and ``rates`` (value) are runs of the same sequences; they are laid over each other,
    so the work follows their edges. A bin without sites in the time range has nulls. Sites without a decoded time
    take no part; missing ones count in the rate, as in :func:`bin_rate_in_time`, but not in the diversity.
    """
    return laid_bins_in_time(overlay({"k": times, "state": states, "value": rates}), blocks, sizes, lowest, highest)


def laid_bins_in_time(laid: DataFrame, blocks: DataFrame, sizes: Sequence[int], lowest: int, highest: int) -> DataFrame:
    """:func:`bins_in_time` where one table of sites or runs holds ``k``, ``state`` and ``value``: a sum per bin, nothing is sorted."""
    if "pos" in laid.columns:
        laid = laid.withColumns({"start_pos": F.col("pos"), "end_pos": F.col("pos")})
    laid = laid.filter("k IS NOT NULL")
    inside = (F.col("k") >= lowest) & (F.col("k") < highest)
    sites = lambda where: F.when(inside & where, F.col("_len")).otherwise(0)
    sums = run_sums(
        laid,
        blocks,
        sizes,
        {
            "sites": F.col("_len"),
            "sites_in_time": sites(F.lit(True)),
            "_missing": sites(F.col("state") == MISSING),
            "_het": sites(F.col("state") == HETEROZYGOUS),
            "_rated": sites(F.col("value").isNotNull()),
            "_total": F.when(inside, F.col("value") * F.col("_len")).otherwise(0.0),
        },
    )
    share = lambda part, whole: part / F.nullif(whole, F.lit(0))
    return sums.select(
        "block_id",
        "diploid",
        "bin_size",
        "bin",
        "sites",
        "sites_in_time",
        share(F.col("_total"), F.col("_rated")).alias("value"),
        share(F.col("_missing"), F.col("sites_in_time")).alias("missing"),
        share(F.col("_het"), F.col("sites_in_time") - F.col("_missing")).alias("diversity"),
    )


def bin_missing(states: DataFrame, blocks: DataFrame, sizes: Sequence[int] = DEFAULT_SIZES) -> DataFrame:
    """Share of missing sites per bin."""
    return bin_states(states, blocks, sizes).select(
        "block_id",
        "diploid",
        "bin_size",
        "bin",
        (F.col("missing_sites") / F.col("sites")).alias("missing"),
    )


def bin_diversity(states: DataFrame, blocks: DataFrame, sizes: Sequence[int] = DEFAULT_SIZES) -> DataFrame:
    """Heterozygous share of the non-missing sites per bin; NULL when none is callable."""
    callable_sites = F.nullif(F.col("sites") - F.col("missing_sites"), F.lit(0))
    return bin_states(states, blocks, sizes).select(
        "block_id",
        "diploid",
        "bin_size",
        "bin",
        (F.col("het_sites") / callable_sites).alias("diversity"),
    )


def bin_rate_in_time(
    landscape: DataFrame,
    blocks: DataFrame,
    sizes: Sequence[int],
    lowest: int,
    highest: int,
) -> DataFrame:
    """Mean rate over the sites whose decoded time index lies in ``[lowest, highest)``."""
    inside = (F.col("k") >= lowest) & (F.col("k") < highest)
    sums = bin_sums(
        landscape,
        blocks,
        sizes,
        {
            "total": F.when(inside, F.col("value")).otherwise(0.0),
            "sites_in_time": F.when(inside, 1).otherwise(0),
            "sites": F.lit(1),
        },
    )
    return sums.withColumn(
        "value", F.col("total") / F.nullif(F.col("sites_in_time"), F.lit(0))
    ).drop("total")


def average_landscape(landscape: DataFrame) -> DataFrame:
    """Per-site mean over diploids, for each metric present."""
    keys = [c for c in ("block_id", "pos", "metric") if c in landscape.columns]
    return landscape.groupBy(*keys).agg(
        F.avg("value").alias("sample_mean"), F.count(F.lit(1)).alias("diploids")
    )


def filter_windows_by_missing(bins: DataFrame, missing: DataFrame, threshold: float) -> DataFrame:
    """Drop bins whose missing share exceeds the threshold."""
    keys = [c for c in ("block_id", "diploid", "bin_size", "bin") if c in missing.columns]
    kept = missing.filter(F.col("missing") <= threshold).select(*keys)
    return bins.join(kept, keys, "left_semi")


def stack_maps(maps: Mapping[str, DataFrame]) -> DataFrame:
    """Union of maps, each tagged with its label; window sizes are ranked from small to large."""
    tagged = [bins.withColumn("label", F.lit(label)) for label, bins in maps.items()]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    text = (
        F.when(F.col("bin_size") % 1_000_000 == 0, F.concat(F.col("bin_size") / 1_000_000, F.lit("Mb")))
        .when(F.col("bin_size") % 1_000 == 0, F.concat(F.col("bin_size") / 1_000, F.lit("kb")))
        .otherwise(F.concat(F.col("bin_size"), F.lit("b")))
    )
    return stacked.withColumn("window_size", F.regexp_replace(text, r"\.0", ""))


def compare_maps(maps: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """Two labelled maps side by side per window."""
    keys = ["block_id", "diploid", "bin_size", "bin"]
    sides = maps.filter(F.col("label").isin(label_a, label_b))
    return (
        sides.groupBy(*keys)
        .agg(
            F.max(F.when(F.col("label") == label_a, F.col("value"))).alias("value_a"),
            F.max(F.when(F.col("label") == label_b, F.col("value"))).alias("value_b"),
        )
        .filter("value_a IS NOT NULL AND value_b IS NOT NULL")
    )


def map_correlation(paired: DataFrame) -> DataFrame:
    """Correlation of two compared maps per window size."""
    return paired.groupBy("bin_size").agg(
        F.corr("value_a", "value_b").alias("corr"), F.count(F.lit(1)).alias("windows")
    )
