"""Interval masks and point-in-interval lookups without a nested-loop join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locuswise.functions.tiling import TILE, join_touching, neighbours, split_at_tiles
from locuswise.operators.calling import MISSING
from locuswise.operators.runs import KEYS


def mask_spans(mask: DataFrame) -> DataFrame:
    """0-based half-open (start0, end0) to 1-based inclusive (start_pos, end_pos)."""
    return mask.select(
        "block_id", (F.col("start0") + 1).alias("start_pos"), F.col("end0").alias("end_pos")
    ).filter("start_pos <= end_pos")


def merge_intervals(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """Disjoint, maximal (block_id, start_pos, end_pos) from possibly overlapping intervals."""
    return join_touching(mask_spans(mask), ["block_id"], [], tile).select(
        "block_id", "start_pos", "end_pos"
    )


def mask_by_intervals(runs: DataFrame, mask: DataFrame, tile: int = TILE) -> DataFrame:
    """Sites inside a masked interval become missing for every diploid; the result is maximal runs.

    Runs and intervals are cut at tile borders and met on (block, tile). Their edges are sorted
    once per (diploid, block, tile) and the state in force is carried forward, so the cost follows
    the number of edges and not run x interval pairs. Intervals are clipped to the runs.
    """
    pieces = split_at_tiles(runs.select(*KEYS, "start_pos", "end_pos", "state"), tile=tile)
    masked = split_at_tiles(merge_intervals(mask, tile), tile=tile)
    active = pieces.select(*KEYS, "_tile").distinct()
    run_edges = pieces.select(
        *KEYS,
        "_tile",
        F.explode(
            F.array(
                F.struct(F.col("start_pos").alias("at"), F.col("state").cast("int").alias("cover")),
                F.struct((F.col("end_pos") + 1).alias("at"), F.lit(-1).alias("cover")),
            )
        ).alias("edge"),
    ).select(*KEYS, "_tile", "edge.at", "edge.cover", F.lit(None).cast("int").alias("hidden"))
    mask_edges = (
        masked.select(
            "block_id",
            "_tile",
            F.explode(
                F.array(
                    F.struct(F.col("start_pos").alias("at"), F.lit(1).alias("hidden")),
                    F.struct((F.col("end_pos") + 1).alias("at"), F.lit(0).alias("hidden")),
                )
            ).alias("edge"),
        )
        .select("block_id", "_tile", "edge.at", "edge.hidden")
        .join(active, ["block_id", "_tile"])
        .select(*KEYS, "_tile", "at", F.lit(None).cast("int").alias("cover"), "hidden")
    )
    # a span that ends where the next begins shares its edge; the beginning wins
    edges = (
        run_edges.unionByName(mask_edges)
        .groupBy(*KEYS, "_tile", "at")
        .agg(F.max("cover").alias("cover"), F.max("hidden").alias("hidden"))
    )
    along = Window.partitionBy(*KEYS, "_tile").orderBy("at")
    sofar = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = edges.select(
        *KEYS,
        "_tile",
        F.col("at").alias("start_pos"),
        (F.lead("at").over(along) - 1).alias("end_pos"),
        F.last("cover", ignorenulls=True).over(sofar).alias("cover"),
        F.last("hidden", ignorenulls=True).over(sofar).alias("hidden"),
    ).filter("cover >= 0 AND end_pos IS NOT NULL")
    state = F.when(F.col("hidden") == 1, F.lit(MISSING)).otherwise(F.col("cover")).cast("int")
    marked = swept.select(*KEYS, "_tile", "start_pos", "end_pos", state.alias("state"))
    merged = join_touching(marked, KEYS, ["state"], tile, presplit=True)
    return merged.select(*KEYS, "start_pos", "end_pos", "state")


def mask_by_codes(
    sites: DataFrame, callable_codes: DataFrame, codes: Sequence[str] = ("1", "P")
) -> DataFrame:
    """Sites whose code is not callable, or that have no code, become missing."""
    good = callable_codes.filter(F.col("code").isin(list(codes))).select(
        "block_id", "pos", F.lit(True).alias("_good")
    )
    state = F.when(F.col("_good"), F.col("state")).otherwise(F.lit(MISSING)).cast("int")
    return (
        sites.join(good, ["block_id", "pos"], "left").withColumn("state", state).drop("_good")
    )


def subtract_intervals(blocks: DataFrame, callable_intervals: DataFrame, tile: int = TILE) -> DataFrame:
    """Block minus callable intervals: the negative mask, again 0-based half-open."""
    limits = blocks.select("block_id", F.col("start").alias("_lo"), F.col("end").alias("_hi"))
    covered = (
        merge_intervals(callable_intervals, tile)
        .join(limits, "block_id")
        .select(
            "block_id",
            F.greatest("start_pos", "_lo").alias("start_pos"),
            F.least("end_pos", "_hi").alias("end_pos"),
        )
        .filter("start_pos <= end_pos")
    )
    fence = limits.select(
        "block_id", F.explode(F.array(F.col("_lo") - 1, F.col("_hi") + 1)).alias("start_pos")
    )
    walls = covered.unionByName(fence.withColumn("end_pos", F.col("start_pos")))
    linked = neighbours(walls, ["block_id"], "start_pos", previous="prev", tile=tile)
    return linked.select(
        "block_id",
        F.col("prev.end_pos").alias("start0"),
        (F.col("start_pos") - 1).alias("end0"),
    ).filter("start0 < end0")


def interval_lookup(
    values: DataFrame, time_grid: DataFrame, keys: Sequence[str], value: str = "value"
) -> DataFrame:
    """Grid cell (k, t_lo, t_hi) that holds each value; the last cell is open-ended.

    A grid has tens of cells, so its sorted lower bounds travel as one array per key and the cell
    is found inside the row instead of by a range join.
    """
    keys = list(keys)
    cell = F.struct("t_lo", "k", "t_hi")
    grids = time_grid.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    located = values.join(grids, keys)
    hit = F.element_at(
        F.filter("_cells", lambda c: c["t_lo"] <= F.col(value)), -1
    )
    checked = F.when(
        F.col(value) < F.col("_cells")[0]["t_lo"],
        F.raise_error(F.lit("value lies below the grid")).cast("boolean"),
    ).otherwise(F.lit(True))
    return (
        located.filter(checked)
        .withColumn("_hit", hit)
        .withColumn("k", F.col("_hit.k"))
        .withColumn("t_lo", F.col("_hit.t_lo"))
        .withColumn("t_hi", F.coalesce("_hit.t_hi", F.lit(float("inf"))))
        .drop("_hit", "_cells")
    )


def boundary_index(values: DataFrame, time_grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index of the cell whose lower bound equals the value exactly; raises if there is none."""
    found = interval_lookup(values, time_grid, keys)
    exact = F.when(
        F.col("value") != F.col("t_lo"),
        F.raise_error(F.lit("value is not a grid boundary")).cast("boolean"),
    ).otherwise(F.lit(True))
    return found.filter(exact).select(*values.columns, "k")
