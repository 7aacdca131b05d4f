"""Order-dependent helpers that never put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(pos)`` sends every row of a key to one task. When one
sample or chromosome holds a third of the data that task decides the run time of the job. The
helpers below cut the position axis into fixed tiles, run the window inside (key, tile) and then
repair the tile borders from one summary row per tile. The result equals the plain window: rows with
a null key form a group of their own, and rows with a null position come first in their key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a tile. All rows of a key and tile meet in one task, so it bounds a task's share of few long keys;
#: a span is cut once per tile it crosses.
TILE = 1 << 16


def tile_of(position: Column | str, tile: int = TILE) -> Column:
    col = F.col(position) if isinstance(position, str) else position
    return F.floor(col / F.lit(tile)).cast("long")


def _tiled(df: DataFrame, keys: Sequence[str], order: str, tile: int) -> DataFrame:
    # one explicit shuffle that the rows and the tile summaries both read. The key is a struct: it is never
    # null itself, and structs with equal nulls are equal, so null keys and positions are kept
    rows = df.withColumn("_key", F.struct(*keys, tile_of(order, tile).alias("_tile")))
    return rows.repartition("_key")


def _across(keys: Sequence[str]):
    return Window.partitionBy(*[F.col("_key")[k] for k in keys]).orderBy(F.col("_key")["_tile"])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    previous: str | None = None,
    following: str | None = None,
    tile: int = TILE,
    carried_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Add the preceding and/or following row of the key as struct columns (null at the ends).

    The structs hold the ``carried_columns``, by default every column of ``df``.
    """
    keys = list(keys)
    held = list(carried_columns or df.columns)
    whole = F.struct(*held)
    tiled = _tiled(df, keys, order, tile)
    inside = Window.partitionBy("_key").orderBy(order)
    across = _across(keys)
    place = F.coalesce(F.col(order), F.lit(0))
    ends, carried, columns, names = [], [], [], []
    if previous:
        ends.append(F.struct(*[F.max_by(c, place).alias(c) for c in held]).alias("_last"))
        carried.append(F.lag("_last").over(across).alias("_before"))
        columns.append(F.lag(whole).over(inside).alias(previous))
        names.append((previous, "_before"))
    if following:
        ends.append(F.struct(*[F.min_by(c, place).alias(c) for c in held]).alias("_first"))
        carried.append(F.lead("_first").over(across).alias("_after"))
        columns.append(F.lead(whole).over(inside).alias(following))
        names.append((following, "_after"))
    borders = tiled.groupBy("_key").agg(*ends).select("_key", *carried)
    joined = tiled.select("*", *columns).join(borders, "_key")
    for name, border in names:
        joined = joined.withColumn(name, F.coalesce(name, border)).drop(border)
    return joined.drop("_key")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    tile: int = TILE,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum of ``value`` along ``order`` inside ``keys`` (keys may be empty)."""
    keys = list(keys)
    tiled = _tiled(df.withColumn("_value", value), keys, order, tile)
    inside = Window.partitionBy("_key").orderBy(order)
    end = Window.currentRow if inclusive else -1
    local = F.coalesce(
        F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, end)), F.lit(0)
    )
    # one row per tile, so an unkeyed total still only gathers tile summaries
    across = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tiled.groupBy("_key")
        .agg(F.sum("_value").alias("_total"))
        .select("_key", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_offset"))
    )
    return (
        tiled.withColumn("_local", local)
        .join(offsets, "_key")
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", "_key", "_value")
    )


def split_at_tiles(
    spans: DataFrame, start: str = "start_pos", end: str = "end_pos", tile: int = TILE
) -> DataFrame:
    """Cut inclusive spans at tile borders; adds ``_tile``. A span never leaves its tile afterwards.

    A span without a start or an end raises at run time.
    """
    missing = F.raise_error(F.lit(f"span without {start} or {end}")).cast("array<bigint>")
    tiles = F.coalesce(F.sequence(tile_of(start, tile).cast("long"), tile_of(end, tile).cast("long")), missing)
    return (
        spans.withColumn("_tile", F.explode(tiles))
        .withColumn(start, F.greatest(F.col(start), F.col("_tile") * tile))
        .withColumn(end, F.least(F.col(end), F.col("_tile") * tile + (tile - 1)))
    )


def join_touching(
    spans: DataFrame,
    keys: Sequence[str],
    same: Sequence[str] = (),
    tile: int = TILE,
    presplit: bool = False,
) -> DataFrame:
    """Merge spans that touch or overlap and agree on ``same``; output is maximal.

    Spans of one key with different ``same`` values must not overlap. With an empty ``same`` any
    overlap is allowed. Work is done inside (key, tile); only the spans that reach a tile border
    (two per tile) are gathered per key afterwards.
    """
    keys, same = list(keys), list(same)
    pieces = spans if presplit else split_at_tiles(spans, tile=tile)
    if not same:
        # copies of an interval collapse before the shuffle, however many there are
        pieces = pieces.groupBy(*keys, "_tile", "start_pos").agg(F.max("end_pos").alias("end_pos"))
    inside = Window.partitionBy(*keys, "_tile").orderBy("start_pos")
    local = _islands(pieces, inside, [*keys, "_tile"], same)
    at_border = (F.col("start_pos") == F.col("_tile") * tile) | (
        F.col("end_pos") == F.col("_tile") * tile + (tile - 1)
    )
    inner = local.filter(~at_border).select(*keys, *same, "start_pos", "end_pos")
    across = Window.partitionBy(*keys).orderBy("start_pos")
    outer = _islands(local.filter(at_border), across, keys, same)
    return inner.unionByName(outer.select(*keys, *same, "start_pos", "end_pos"))


def _islands(spans, window, group, same):
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    joins = F.max("end_pos").over(before) >= F.col("start_pos") - 1
    for name in same:
        joins = joins & (F.lag(name).over(window) == F.col(name))
    fresh = F.when(joins, F.lit(0)).otherwise(F.lit(1))
    return (
        spans.withColumn("_fresh", fresh)
        .withColumn("_island", F.sum("_fresh").over(window))
        .groupBy(*group, "_island")
        .agg(
            F.min("start_pos").alias("start_pos"),
            F.max("end_pos").alias("end_pos"),
            *[F.first(name).alias(name) for name in same],
        )
        .drop("_island")
    )
