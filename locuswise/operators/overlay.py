"""Several run tables of one block laid over each other: stretches in which nothing changes.

Runs are cut at tile borders and turned into edges; one sweep per (key, tile) reads the edges in order. Work follows the
number of edges, not of sites, and no key sits in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locuswise.functions.tiling import TILE, join_touching, split_at_tiles
from locuswise.operators.runs import KEYS


def value_runs(sites: DataFrame, column: str, keys: Sequence[str] = KEYS, tile: int = TILE) -> DataFrame:
    """Maximal runs (keys, start_pos, end_pos, column) of equal values from sites or from shorter runs."""
    if "pos" in sites.columns:
        sites = sites.withColumns({"start_pos": F.col("pos"), "end_pos": F.col("pos")})
    spans = sites.select(*keys, "start_pos", "end_pos", column)
    return join_touching(spans, list(keys), [column], tile).select(*keys, "start_pos", "end_pos", column)


def _edges(runs: DataFrame, keys: Sequence[str], tile: int, opened: Mapping[str, Column], closed: Mapping[str, Column]) -> DataFrame:
    """A row where a run begins and one behind its end, unless that is the end of the tile."""
    pieces = split_at_tiles(runs, tile=tile)
    row = lambda pos, values: F.struct(pos.alias("pos"), *[v.alias(n) for n, v in values.items()])
    after = F.col("end_pos") + 1
    behind = F.when(F.floor(after / tile) == F.col("_tile"), row(after, closed))
    edge = F.explode(F.filter(F.array(row(F.col("start_pos"), opened), behind), lambda e: e.isNotNull()))
    return pieces.select(F.struct(*keys, "_tile").alias("_key"), edge.alias("_edge")).select("_key", "_edge.*")


def _stretches(keys: Sequence[str], tile: int) -> tuple[Window, list[Column]]:
    """The sweep's window, and keys, start_pos and end_pos of the stretch that begins at an edge."""
    order = Window.partitionBy("_key").orderBy("pos")
    last = (F.col("_key")["_tile"] + 1) * tile - 1
    end = F.coalesce(F.lead("pos").over(order) - 1, last)
    return order, [*[F.col("_key")[k].alias(k) for k in keys], F.col("pos").alias("start_pos"), end.alias("end_pos")]


def overlay(tables: Mapping[str, DataFrame], keys: Sequence[str] = KEYS, tile: int = TILE) -> DataFrame:
    """Stretches (keys, start_pos, end_pos, a column per table) that are covered by one of the tables at least.

    ``tables`` maps a column to the runs that hold it; runs of one table and key must not overlap. Where a table has no
    run its column is null, so a run with a null value counts as none. A null key is a key of its own.
    """
    names = list(tables)
    events = []
    for name, runs in tables.items():
        mark = lambda opens, value: F.struct(F.lit(opens).alias("opens"), value.alias("value"))
        kind = runs.schema[name].dataType
        edges = _edges(runs, keys, tile, {name: mark(1, F.col(name))}, {name: mark(0, F.lit(None).cast(kind))})
        events.append(edges)
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), events).repartition("_key")
    # where a run ends and the next one of its table begins, the beginning counts
    points = together.groupBy("_key", "pos").agg(*[F.max(n).alias(n) for n in names])
    order, places = _stretches(keys, tile)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = [F.last(n, ignorenulls=True).over(so_far)["value"].alias(n) for n in names]
    return points.select(*places, *values).filter(F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull())


def covering_sums(runs: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], tile: int = TILE) -> DataFrame:
    """Stretches (keys, start_pos, end_pos, covering, sums) with whole-number sums over all runs that cover them.

    Runs may overlap in any number: each adds its values at its start and takes them away behind its end. The values
    must be whole numbers, so that nothing is lost in between.
    """
    values = {"covering": F.lit(1).cast("long"), **{n: c.cast("long") for n, c in sums.items()}}
    edges = _edges(runs, keys, tile, values, {n: -c for n, c in values.items()})
    points = edges.repartition("_key").groupBy("_key", "pos").agg(*[F.sum(n).alias(n) for n in values])
    order, places = _stretches(keys, tile)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points.select(*places, *[F.sum(n).over(so_far).alias(n) for n in values]).filter("covering > 0")
