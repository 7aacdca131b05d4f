"""All maps of a genome, of every size, in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.operators.bins import DEFAULT_SIZES, bin_states, bin_sums
from locuswise.operators.blocks import window_coords

BIN = ("block_id", "diploid", "bin_size", "bin")
STATES = ("missing_sites", "het_sites", "sites")


def genome_maps(
    landscape: DataFrame,
    states: DataFrame,
    blocks: DataFrame,
    sizes: Sequence[int] = DEFAULT_SIZES,
    metrics: Sequence[str] = ("value", "tmrca"),
) -> DataFrame:
    """Windows with the mean of every metric of ``landscape``, the missing share and the diversity.

    Sites and runs are read once each for all sizes, and their sums per bin meet in one shuffle. A window that only one
    of the two tables covers has nulls in the other's columns; a site whose metric is null takes no part in
    that metric's mean. A null diploid is a diploid of its own.
    """
    totals = {}
    for name in metrics:
        totals[f"_{name}"] = F.col(name).cast("double")
        totals[f"_{name}_sites"] = F.col(name).isNotNull().cast("long")
    sites = bin_sums(landscape, blocks, sizes, totals)
    together = sites.unionByName(bin_states(states, blocks, sizes), allowMissingColumns=True)
    sums = together.groupBy(*BIN).agg(*[F.sum(name).alias(name) for name in (*totals, *STATES)])
    share = lambda part, whole: F.col(part) / F.nullif(whole, F.lit(0))
    found = sums.select(
        *BIN,
        *[share(f"_{name}", F.col(f"_{name}_sites")).alias(name) for name in metrics],
        share("missing_sites", F.col("sites")).alias("missing"),
        share("het_sites", F.col("sites") - F.col("missing_sites")).alias("diversity"),
    )
    return window_coords(found, blocks)
