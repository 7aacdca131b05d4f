"""Block tables, fragments and the coordinates derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.functions.tiling import running_total

ORDER_TILE = 4096


def derive_blocks(variants: DataFrame, key: str = "block_id") -> DataFrame:
    """First and last position per block; cut-offs equal them."""
    return (
        variants.groupBy(key)
        .agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
        .withColumn("lower_cut", F.col("start"))
        .withColumn("upper_cut", F.col("end"))
    )


def block_offsets(blocks: DataFrame) -> DataFrame:
    """0-based half-open range of each block in the genome laid end to end."""
    length = F.col("end") - F.col("start") + 1
    summed = running_total(blocks, [], "block_id", length, "genome_end", ORDER_TILE)
    return summed.withColumn("genome_start", F.col("genome_end") - length)


def fragment_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """ceil(length/size) fragments per block, numbered from 1, inclusive 1-based coordinates."""
    length = F.col("end") - F.col("start") + 1
    last = F.ceil(length / F.lit(float(size))).cast("int")
    return blocks.select(
        "block_id",
        F.col("start").alias("_lo"),
        F.col("end").alias("_hi"),
        F.explode(F.sequence(F.lit(1), last)).alias("file_index"),
    ).select(
        "block_id",
        "file_index",
        (F.col("_lo") + (F.col("file_index") - 1) * F.lit(int(size))).cast("long").alias("frag_start"),
        F.least(F.col("_hi"), F.col("_lo") + F.col("file_index") * F.lit(int(size)) - 1)
        .cast("long")
        .alias("frag_end"),
    )


def concat_fragments(parts: DataFrame, index: str = "site_index") -> DataFrame:
    """Per-fragment site indices (from 1) become positions that continue through the block.

    The shifts, one row per fragment file, are broadcast and never the sites: read from compressed
    text they look smaller than they are.
    """
    keys = [c for c in ("diploid", "block_id") if c in parts.columns]
    lengths = parts.groupBy(*keys, "file_index").agg(F.max(index).alias("_sites"))
    shifts = running_total(
        lengths, keys, "file_index", F.col("_sites"), "_shift", ORDER_TILE, inclusive=False
    ).drop("_sites")
    return (
        parts.join(F.broadcast(shifts), [*keys, "file_index"])
        .withColumn("pos", F.col(index) + F.col("_shift"))
        .drop("_shift", index)
    )


def diploid_labels(sites: DataFrame, label: str) -> DataFrame:
    """``<label>_diploid_<i>`` per diploid in id order, i from 1."""
    ids = sites.select("diploid").distinct()
    numbered = running_total(ids, [], "diploid", F.lit(1), "index", ORDER_TILE)
    return numbered.select(
        F.concat(F.lit(f"{label}_diploid_"), F.col("index").cast("string")).alias("decoding_label"),
        F.col("diploid").alias("diploid_id"),
    )


def trimmed_limits(blocks: DataFrame) -> DataFrame:
    """Cut-offs clamped into their block, as ``_lower`` and ``_upper`` per block."""
    return blocks.select(
        "block_id",
        F.greatest("start", "lower_cut").alias("_lower"),
        F.least("end", "upper_cut").alias("_upper"),
    )


def trim_to_cutoffs(landscape: DataFrame, blocks: DataFrame, upper_exclusive: bool = False) -> DataFrame:
    """Sites between the clamped cut-offs of their block.

    ``upper_exclusive`` leaves out the site at the upper cut-off, to compare with maps made that way.
    """
    last = F.col("_upper") - (1 if upper_exclusive else 0)
    return (
        landscape.join(trimmed_limits(blocks), "block_id")
        .filter(F.col("pos").between(F.col("_lower"), last))
        .drop("_lower", "_upper")
    )


def window_coords(bins: DataFrame, blocks: DataFrame, compat: bool = False) -> DataFrame:
    """0-based half-open chromosome coordinates of each bin, the last one clipped.

    ``compat`` keeps the 1-based lower cut-off as the first start and an exclusive upper cut-off.
    """
    base = F.col("_lower") - (0 if compat else 1)
    last = F.col("_upper") - (1 if compat else 0)
    limits = trimmed_limits(blocks).join(blocks.select("block_id", "chrom"), "block_id")
    return (
        bins.join(limits, "block_id")
        .withColumn("chrom_start", base + F.col("bin") * F.col("bin_size"))
        .withColumn(
            "chrom_end", F.least(base + (F.col("bin") + 1) * F.col("bin_size"), last)
        )
        .drop("_lower", "_upper")
    )
