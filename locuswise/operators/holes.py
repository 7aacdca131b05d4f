"""Sequences that are read in part: runs inside regions, and what a chain does in the holes between them.

A hole becomes a run with a symbol of its own, so that packing, transfers and products need no case for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.functions.kernels import DRIFT, OPEN, SKIP
from locuswise.functions.tiling import TILE, neighbours
from locuswise.operators.overlay import overlay
from locuswise.operators.runs import KEYS

WAYS = ("drift", "restart")


def runs_within(runs: DataFrame, regions: DataFrame, tile: int = TILE) -> DataFrame:
    """Parts of ``runs`` that lie in ``regions(diploid, block_id, start_pos, end_pos)``; regions must not overlap."""
    inside = regions.select(*KEYS, "start_pos", "end_pos", F.lit(True).alias("inside"))
    laid = overlay({"state": runs.select(*KEYS, "start_pos", "end_pos", "state"), "inside": inside}, tile=tile)
    return laid.filter("inside AND state IS NOT NULL").drop("inside")


def with_holes(runs: DataFrame, blocks: DataFrame, way: str, tile: int = TILE) -> DataFrame:
    """Runs that cover their blocks: what ``runs`` leave open is filled with hole runs.

    ``drift``: the chain goes on unseen, one transition per site. ``restart``: it stands still in a hole and begins
    anew behind it, as at the start of a block, so the parts are independent. Runs that touch have no hole
    between them. A sequence without any run has no row.
    """
    if way not in WAYS:
        raise ValueError(f"unknown way {way!r} through holes, expected one of {WAYS}")
    known = runs.select(*KEYS, "start_pos", "end_pos", F.col("state").cast("int").alias("state"))
    edges = F.explode(F.array(F.col("start") - 1, F.col("end") + 1)).alias("start_pos")
    fences = known.select(*KEYS).distinct().join(blocks.select("block_id", "start", "end"), "block_id").select(*KEYS, edges)
    rows = known.withColumn("fence", F.lit(False)).unionByName(
        fences.select(*KEYS, "start_pos", F.col("start_pos").alias("end_pos"), F.lit(None).cast("int").alias("state"), F.lit(True).alias("fence"))
    )
    linked = neighbours(rows, KEYS, "start_pos", previous="prev", tile=tile).filter("prev IS NOT NULL")
    behind_hole = F.col("prev.end_pos") + 1 < F.col("start_pos")
    piece = lambda a, b, state: F.struct(a.alias("start_pos"), b.alias("end_pos"), state.alias("state"))
    start, end, state = F.col("start_pos"), F.col("end_pos"), F.col("state")
    hole = F.when(behind_hole, piece(F.col("prev.end_pos") + 1, start - 1, F.lit(SKIP if way == "restart" else DRIFT)))
    if way == "drift":
        parts = [hole, F.when(~F.col("fence"), piece(start, end, state))]
    else:
        opens = behind_hole & ~F.col("fence")
        parts = [
            hole,
            F.when(opens, piece(start, start, F.lit(OPEN) - state)),
            F.when(opens & (end > start), piece(start + 1, end, state)),
            F.when(~behind_hole & ~F.col("fence"), piece(start, end, state)),
        ]
    found = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return linked.select(*KEYS, F.explode(found).alias("p")).select(*KEYS, "p.*")
