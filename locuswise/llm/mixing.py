"""Mixing sources to target weights: repetition rates and hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locuswise.functions.lineage import settled
from locuswise.llm.common import boxed, table, word_count

#: Weights dealt to the sources by name, repeating; most words a target takes of each word of its source.
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: its words, its weight and its target, from one row per source (source, source_size).

    The targets share the words of all sources by weight; a target above ``most`` times its source is held
    there and the rest reshared. That ends at min(most * size, level * weight), with one level for all: sources
    are held in the order of size / weight, so running sums over that order give the level in whole numbers.
    Both windows run over one row per source (not per document), so a single task holds only the source names.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    number = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (number + 1).cast("int")).cast("long")
    weighed = sizes.select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("bound"))
    order = [F.col("bound") * 1.0 / F.col("weight"), F.col("source").isNull(), F.col("source")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = weighed.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    # a source is held if its share of what the ones before leave is above its bound
    is_held = F.col("left_words") * F.col("weight") > F.col("bound") * F.col("left_weight")
    first_free = F.min_by(F.struct("left_words", "left_weight"), F.struct(*order)).over(Window.partitionBy("held"))
    return (
        held.withColumn("held", is_held)
        .withColumn("level", first_free)
        .select(
            "source",
            "source_size",
            "weight",
            F.when(F.col("held"), F.col("bound").cast("double"))
            .otherwise((F.col("level.left_words") * F.col("weight")).cast("double") / F.col("level.left_weight"))
            .alias("target"),
        )
    )


def hash_share(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that follows from the doc_id and the seed only."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): its size, its source's size and target, and its copies.

    Copies are floor(rate) and one more with probability rate - floor(rate), drawn from a hash of the doc_id,
    so a rerun agrees; rate is target / size of the source. Null and empty texts have size 0 (and may still be
    copied); a null source is a source of its own, after the others. Repeated rows draw alike. A source without
    words has rate 0. An empty table gives an empty result. Other columns are ignored.
    """
    sized = settled(docs.select("doc_id", word_count(F.col("text")).alias("size"), "source"), "sizes")
    return copies(sized, _targets(sized, weights, most), seed)


def _targets(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # written and read back: Catalyst then knows its size, broadcasts it if small and joins by key if not
    return settled(source_targets(sizes, weights, most), "targets").withColumnRenamed("source", "named")


def copies(rows: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """``rows`` (doc_id, source and others) with rate and n_copies."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("named"))).drop("named").withColumn("rate", rate)
    draw = F.when(hash_share(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.withColumn("n_copies", (F.floor("rate") + draw).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as its copies say, with all its columns."""
    sized = settled(docs.select(word_count(F.col("text")).alias("size"), "source"), "sizes")
    rated = copies(boxed(docs).select("_doc", "doc_id", "source"), _targets(sized, weights, most), seed)
    times = F.col("n_copies").cast("int")
    return rated.filter(times > 0).select("_doc", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("_doc.*")


def query(spark, sf_dir):
    mixed = mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1, 2, 3][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::BIGINT AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, 3 * source_size AS bound,
         row_number() OVER (ORDER BY 3.0 * source_size / weight, source IS NULL, encode(source)) AS n FROM s
), h AS (
  SELECT a.*, (SELECT sum(source_size) FROM s)::BIGINT
              - coalesce((SELECT sum(b.bound) FROM o b WHERE b.n < a.n), 0)::BIGINT AS left_words,
         (SELECT sum(b.weight) FROM o b WHERE b.n >= a.n)::BIGINT AS left_weight
  FROM o a
), f AS (
  SELECT left_words, left_weight FROM h WHERE left_words * weight <= bound * left_weight ORDER BY n LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN left_words * weight > bound * left_weight THEN bound::DOUBLE
              ELSE (SELECT left_words FROM f) * weight::DOUBLE / (SELECT left_weight FROM f) END AS target
  FROM h
)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CASE WHEN t.source_size > 0 THEN
         d.size * (floor(t.target / t.source_size)
           + (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':mix-1'), 1, 8))::BIGINT / 4294967296.0
              < t.target / t.source_size - floor(t.target / t.source_size))::INT)
       ELSE 0 END::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
