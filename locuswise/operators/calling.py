"""From variant records and haplotypes to site states: 0 homozygous, 1 heterozygous, 2 missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuswise.functions.tiling import TILE, neighbours

HOMOZYGOUS, HETEROZYGOUS, MISSING = 0, 1, 2
# fixed values: symbols of haplotypes that count as known
KNOWN_BASES = ("A", "C", "G", "T", "0", "1")


def passes_filter(flag: Column, threshold: float = 0.0) -> Column:
    number = F.coalesce(flag.try_cast("double"), F.lit(0.0))
    return flag.isin("PASS", ".") | (number > F.lit(float(threshold)))


def genotype_state(genotype: Column) -> Column:
    alleles = F.split(F.split(genotype, ":")[0], r"[/|]")
    return (
        F.when(F.array_contains(alleles, "."), F.lit(MISSING))
        .when(F.size(F.array_distinct(alleles)) > 1, F.lit(HETEROZYGOUS))
        .otherwise(F.lit(HOMOZYGOUS))
    )


def pass_filter(variants: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Flag column, not a row drop: a failing site is a missing site, not an absent one."""
    return variants.withColumn("passes", passes_filter(F.col("filter"), threshold))


def call_state(variants: DataFrame, threshold: float = 0.0) -> DataFrame:
    state = F.when(passes_filter(F.col("filter"), threshold), genotype_state(F.col("gt"))).otherwise(
        F.lit(MISSING)
    )
    return variants.withColumn("state", state.cast("int")).drop("filter", "gt")


def duplicate_positions(
    variants: DataFrame, keys: Sequence[str] = ("diploid", "block_id")
) -> DataFrame:
    return (
        variants.groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("records")).filter("records > 1")
    )


def resolve_duplicates(
    variants: DataFrame,
    order: str,
    policy: str = "error",
    keys: Sequence[str] = ("diploid", "block_id"),
) -> DataFrame:
    """One record per position: raise on a repeat, or keep the first by ``order``."""
    rest = [c for c in variants.columns if c not in (*keys, "pos", order)]
    grouped = variants.groupBy(*keys, "pos").agg(
        *[F.min_by(c, order).alias(c) for c in rest], F.count(F.lit(1)).alias("records")
    )
    if policy == "error":
        message = F.concat(F.lit("repeated position "), F.col("pos").cast("string"))
        grouped = grouped.filter(
            F.when(F.col("records") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        )
    elif policy != "keep_first":
        raise ValueError(f"unknown duplicate policy {policy!r}")
    return grouped.select(*keys, "pos", *rest)


def fill_gaps(
    sparse: DataFrame,
    blocks: DataFrame,
    standard_state: int = HOMOZYGOUS,
    tile: int = TILE,
    diploids: DataFrame | None = None,
) -> DataFrame:
    """Runs covering every block: called sites plus gap runs in the standard state.

    Gaps before the first and after the last record of a block are padded up to the block's
    ``start`` and ``end``. Use state 2 as standard for inputs that list every callable site.

    With ``diploids`` (diploid), every block of every one of them is covered, also where no record
    is; without it, only pairs of a diploid and a block that have a record. A record of a block that
    ``blocks`` lacks raises at run time.
    """
    keys = ["diploid", "block_id"]
    limits = blocks.select("block_id", F.col("start").alias("_lo"), F.col("end").alias("_hi"))
    points = sparse.select(*keys, "pos", "state")
    message = F.concat(F.lit("record of an unknown block "), F.coalesce(F.col("block_id").cast("string"), F.lit("null")))
    linked = neighbours(points, keys, "pos", "prev", "next", tile, ["pos"]).join(limits, "block_id", "left")
    linked = linked.withColumn("_lo", F.coalesce("_lo", F.raise_error(message).cast("long")))

    def run(first, last, state):
        return F.struct(first.alias("start_pos"), last.alias("end_pos"), state.cast("int").alias("state"))

    fill = F.lit(int(standard_state))
    pos = F.col("pos")
    before = run(F.coalesce(F.col("prev.pos") + 1, F.col("_lo")), pos - 1, fill)
    after = run(pos + 1, F.when(F.col("next").isNull(), F.col("_hi")), fill)
    runs = (
        linked.select(*keys, F.explode(F.array(before, run(pos, pos, F.col("state")), after)).alias("run"))
        .select(*keys, "run.*")
        .filter("start_pos <= end_pos")
    )
    if diploids is None:
        return runs
    # the product is the size of the result: one run at least per diploid and block
    every = diploids.select("diploid").distinct().crossJoin(limits)
    bare = every.join(points.select(*keys).distinct(), keys, "left_anti").filter("_lo <= _hi")
    return runs.unionByName(bare.select(*keys, run(F.col("_lo"), F.col("_hi"), fill).alias("run")).select(*keys, "run.*"))


def mask_first_site(sites: DataFrame) -> DataFrame:
    """First site of every (diploid, block) becomes missing. Accepts sites or runs."""
    keys = ["diploid", "block_id"]
    if "pos" in sites.columns:
        first = sites.groupBy(*keys).agg(F.min("pos").alias("_first"))
        masked = F.when(F.col("pos") == F.col("_first"), F.lit(MISSING)).otherwise(F.col("state"))
        return sites.join(first, keys).withColumn("state", masked.cast("int")).drop("_first")
    first = sites.groupBy(*keys).agg(F.min("start_pos").alias("_first"))
    head = F.struct(
        F.col("_first").alias("start_pos"),
        F.col("_first").alias("end_pos"),
        F.lit(MISSING).cast("int").alias("state"),
    )
    tail = F.struct(
        F.greatest(F.col("start_pos"), F.col("_first") + 1).alias("start_pos"),
        F.col("end_pos").alias("end_pos"),
        F.col("state").alias("state"),
    )
    pieces = F.when(F.col("start_pos") == F.col("_first"), F.array(head, tail)).otherwise(F.array(tail))
    return (
        sites.join(first, keys)
        .select(*keys, F.explode(pieces).alias("run"))
        .select(*keys, "run.*")
        .filter("start_pos <= end_pos")
    )


def slice_range(sites: DataFrame, start: int, end: int) -> DataFrame:
    """Sites with ``start <= pos <= end``; bounds outside a block's own range raise at run time."""
    if start > end:
        raise ValueError(f"slice start {start} lies after its end {end}")
    keys = ["diploid", "block_id"]
    extent = sites.groupBy(*keys).agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    inside = (F.col("_lo") <= F.lit(start)) & (F.lit(end) <= F.col("_hi"))
    message = F.concat(
        F.lit(f"slice [{start}, {end}] leaves block "), F.col("block_id").cast("string")
    )
    checked = F.when(inside, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return (
        sites.filter(F.col("pos").between(start, end))
        .join(extent.filter(checked), keys)
        .drop("_lo", "_hi")
    )


def haplotype_pairs(indices: Sequence[int]) -> list[tuple[int, int, int]]:
    """(diploid, first, second) from a flat index list; consecutive entries form a pair."""
    if len(indices) % 2:
        raise ValueError("haplotype index list must have even length")
    pairs = [(i // 2, indices[i], indices[i + 1]) for i in range(0, len(indices), 2)]
    for _, first, second in pairs:
        if first == second:
            raise ValueError(f"haplotype {first} is paired with itself")
    return pairs


def _roles(pairs: DataFrame) -> DataFrame:
    """(hap, diploid, side): a haplotype may belong to several pairs."""
    valid = F.when(
        F.col("hap1") == F.col("hap2"), F.raise_error(F.lit("haplotype paired with itself")).cast("boolean")
    ).otherwise(F.lit(True))
    return pairs.filter(valid).select(
        "diploid", F.posexplode(F.array(F.col("hap1"), F.col("hap2"))).alias("side", "hap")
    )


def pair_sequences(pieces: DataFrame, pairs: DataFrame, piece_length: int) -> DataFrame:
    """Sites of pseudo-diploids from text pieces ``(hap, piece, text)`` of ``piece_length`` symbols.

    Missing if either base is a gap, unknown or absent, else equal or not. The two sides of a pair
    meet piece by piece, so what is shuffled is text and a site first becomes a row in the result.
    """
    sides = pieces.join(_roles(pairs), "hap").groupBy("diploid", "piece").agg(
        *[F.max(F.when(F.col("side") == i, F.col("text"))).alias(f"text{i}") for i in (0, 1)]
    )

    def state(x, y):
        known = x.isin(*KNOWN_BASES) & y.isin(*KNOWN_BASES)
        return F.when(known & (x == y), HOMOZYGOUS).when(known, HETEROZYGOUS).otherwise(MISSING)

    symbols = [F.coalesce(F.split(f"text{i}", ""), F.array().cast("array<string>")) for i in (0, 1)]
    return sides.select(
        "diploid", "piece", F.posexplode(F.zip_with(*symbols, state)).alias("i", "state")
    ).select(
        "diploid",
        (F.col("piece").cast("long") * piece_length + F.col("i") + 1).alias("pos"),
        F.col("state").cast("int").alias("state"),
    )


def pair_haplotypes(haps: DataFrame, pairs: DataFrame) -> DataFrame:
    """As :func:`pair_sequences` from one row per (hap, pos, base), the form of a SNP matrix.

    The two sides meet in one aggregation on (diploid, pos) instead of a self join.
    """
    joined = haps.join(_roles(pairs).drop("side"), "hap")
    other = [c for c in haps.columns if c not in ("hap", "pos", "base")]
    known = F.col("base").isin(*KNOWN_BASES)
    return (
        joined.groupBy(*other, "diploid", "pos")
        .agg(
            F.count(F.lit(1)).alias("_sides"),
            F.min(known).alias("_known"),
            F.min("base").alias("_lo"),
            F.max("base").alias("_hi"),
        )
        .withColumn(
            "state",
            F.when((F.col("_sides") < 2) | ~F.col("_known"), F.lit(MISSING))
            .when(F.col("_lo") == F.col("_hi"), F.lit(HOMOZYGOUS))
            .otherwise(F.lit(HETEROZYGOUS))
            .cast("int"),
        )
        .drop("_sides", "_known", "_lo", "_hi")
    )
