"""Exact duplicates by a tree-merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.functions.lineage import settled
from locuswise.llm.common import ROW, SPACES, keep_rows, stored_box, with_row_key

#: Leaf runs, and runs merged into one per round (three rounds of a binomial tree, two levels each).
RUNS = 64
FAN_IN = 4
KEY = ["text_sha256", "check_md5", "norm_chars"]


def digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: digest of its text without white space, its length and its order in a group.

    ``check_md5`` and ``norm_chars`` verify a digest: texts count as equal when all three agree. ``place``
    sorts the rows of a group: most code points first, then smallest doc_id (null last), then the row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    base = docs.select("doc_id", ROW, text.alias("text"), bare.alias("bare"))
    return base.select(
        "doc_id",
        ROW,
        F.sha2("bare", 256).alias("text_sha256"),
        F.md5("bare").alias("check_md5"),
        F.length("bare").cast("long").alias("norm_chars"),
        F.struct(
            (-F.length("text")).cast("long").alias("less"),
            F.col("doc_id").isNull().alias("unnamed"),
            "doc_id",
            ROW,
        ).alias("place"),
    )


def merge_runs(rows: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct text: the first row by ``place`` and the number of rows.

    Rows are dealt to ``runs`` leaf runs. A run is sorted by digest and reduced to one row per digest before
    it moves; then ``fan_in`` runs at a time are merged, round by round, until one is left. A group of copies,
    however large, reaches each round as at most one row per run.
    """
    run = F.pmod(F.xxhash64(ROW), F.lit(runs)).cast("int")
    merged = rows.select(run.alias("run"), *KEY, "place", F.lit(1).cast("long").alias("group_size"))
    while True:
        merged = (
            merged.sortWithinPartitions("run", *KEY)
            .groupBy("run", *KEY)
            .agg(F.min("place").alias("place"), F.sum("group_size").alias("group_size"))
        )
        if runs <= 1:
            return merged.drop("run")
        runs = -(-runs // fan_in)
        merged = merged.withColumn("run", F.pmod(F.col("run"), F.lit(runs)).cast("int"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (columns doc_id, text and ``_row``): the row that stays and the size of its group.

    A null text counts as empty, and empty texts are equal to each other. Rows repeated with the same doc_id
    are members of the group like others, and one of them stays. Rows with a null doc_id stay only in a group
    without named rows of that length. An empty table gives an empty result; other columns are ignored.
    """
    rows = settled(digests(docs), "digests")
    groups = settled(merge_runs(rows).select(*KEY, F.col("place").alias("first"), "group_size"), "digest-groups")
    return rows.join(groups, KEY).select(
        "doc_id",
        ROW,
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col(ROW) == F.col(f"first.{ROW}")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of ``docs``."""
    box = stored_box(docs)
    return keep_rows(box, exact_groups(box).filter("kept"))


def query(spark, sf_dir):
    from locuswise.llm.common import table

    return exact_groups(with_row_key(table(spark, sf_dir, "documents"))).drop(ROW)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
