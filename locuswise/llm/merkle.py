"""Merkle manifest of a dataset, level by level with sibling-shift self-joins (DataFrame functions only).

A node is (tree, place, digest, n): its tree, its place among the n nodes of its level, its digest. At every level
the places of a run's nodes are computed from its slot zero (offsets 0, 1, ... up to the arity), an equijoin of the
level with itself on (tree, place) brings their digests, and the rows of slot zero emit the parents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locuswise.functions.lineage import settled

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
ROW_BITS = 33


def field(value: Column) -> Column:
    """A value as it enters a digest: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def tree_name(value: Column) -> Column:
    """A name that is never null and sorts as the value does, null first."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with place, their rank within ``tree`` by ``order`` (nulls first), and n, the rows of the tree.

    Rows are dealt by ranges of (tree, order), so a tree that holds most rows lies in many partitions. A row's place
    in its partition is stored with it; one row per tree and partition says where the partition begins in the tree.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = settled(dealt.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", ROW_BITS).alias("_part")
    parts = stored.groupBy("tree", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    by_tree = Window.partitionBy("tree")
    before = F.sum("_rows").over(by_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = parts.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(by_tree).alias("n"))
    joined = stored.withColumn("_part", part).join(settled(begins, "begins"), ["tree", "_part"])
    return joined.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _up(place: Column, arity: int) -> Column:
    return F.floor(place / F.lit(arity)).cast("long")


def emitted_parents(nodes: DataFrame, arity: int) -> DataFrame:
    """The next level of the trees that have several nodes at this one, with ``run``, the digests of a parent's nodes.

    The row of slot zero computes the places of its run (itself and the slots after it, as far as the level goes); an
    equijoin brings their digests. A run has at most ``arity`` nodes, so no group grows.
    """
    zero = nodes.filter((F.col("n") > 1) & (F.pmod("place", F.lit(arity)) == 0))
    run = F.sequence("place", F.least(F.col("place") + arity, "n") - 1)
    wanted = zero.select("tree", "n", _up(F.col("place"), arity).alias("up"), F.explode(run).alias("sibling"))
    met = wanted.join(nodes.select("tree", F.col("place").alias("sibling"), "digest"), ["tree", "sibling"])
    runs = met.groupBy("tree", "up", "n").agg(F.sort_array(F.collect_list(F.struct("sibling", "digest"))).alias("run"))
    text = F.array_join(F.transform("run", lambda x: _hex(x["digest"])), "")
    return runs.select(
        "tree",
        F.col("up").alias("place"),
        F.ceil(F.col("n") / arity).cast("long").alias("n"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.transform("run", lambda x: x["digest"]).alias("run"),
    )


class Forest:
    """All levels of the trees over ``leaves`` (tree, place, n, digest and others), stored level by level.

    Digests are kept as bytes and turned to text where they are hashed.
    """

    def __init__(self, leaves: DataFrame, arity: int = ARITY):
        self.arity, self.levels = arity, [leaves]
        most = leaves.agg(F.max("n")).first()[0] or 0
        while most > 1:
            nodes = self.levels[-1].select("tree", "place", "n", "digest")
            self.levels.append(settled(emitted_parents(nodes, arity), f"nodes-{len(self.levels)}"))
            most = -(-most // arity)

    def tops(self) -> DataFrame:
        """(tree, digest) of each tree's last node."""
        last = [nodes.filter("n = 1").select("tree", "digest") for nodes in self.levels]
        return reduce(DataFrame.unionByName, last)

    def paths(self, above: DataFrame, carried: list[str]) -> DataFrame:
        """``leaves`` with ``path``, the siblings before and after a node for each level upwards, then what is above its tree.

        ``above`` has a row per tree with its own path and the columns ``carried`` down. A parent hands its run and its
        path to at most ``arity`` children, so the tree alone is no join key but for the trees' last nodes.
        """
        down = None
        for level in reversed(range(len(self.levels))):
            nodes = self.levels[level]
            met = nodes.filter("n = 1").join(above, "tree")
            if down is not None:
                slot = F.pmod(F.col("place"), F.lit(self.arity)).cast("int")
                all_of = lambda run: F.concat(F.lit(b""), *[F.coalesce(F.get(run, F.lit(i)), F.lit(b"")) for i in range(self.arity)])
                sides = F.struct(
                    all_of(F.slice("upper_run", F.lit(1), slot)).alias("before"),
                    all_of(F.slice("upper_run", slot + 2, F.lit(self.arity))).alias("after"),
                )
                upper = down.select("tree", F.col("place").alias("up"), F.col("run").alias("upper_run"), F.col("path").alias("upper_path"), *carried)
                inner = nodes.filter("n > 1").withColumn("up", _up(F.col("place"), self.arity)).join(upper, ["tree", "up"])
                inner = inner.withColumn("path", F.concat(F.array(sides), "upper_path")).drop("up", "upper_run", "upper_path")
                met = met.unionByName(inner)
            down = settled(met, f"paths-{level}") if level else met
        return down


EMPTY_PATH = "CAST(array() AS array<struct<before: binary, after: binary>>)"


def folded(claim: Column, path: Column) -> Column:
    """The root (text) that follows from a leaf's digest (bytes) and its siblings, level by level."""
    return F.aggregate(path, _hex(claim), lambda h, s: F.sha2(F.concat(_hex(s["before"]), h, _hex(s["after"])), 256))


def proof(path: Column) -> Column:
    """One digest of all siblings, level by level from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), ""), 256)


def manifest(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """Add subroot, root and path to ``leaves`` (tree, doc_id, digest as bytes, and others without these names).

    A tree's leaves ascend by doc_id (null first, equal ones by digest); its subroot is what remains after joining runs of
    ``arity`` nodes, and the subroots in order of their trees' names give the root alike. A lone leaf is its subroot,
    a lone subroot the root. Repeated rows are leaves each. An empty table gives an empty result.
    """
    placed = settled(numbered(settled(leaves, "digests"), ["doc_id", "digest"]), "leaves")
    below = Forest(placed, arity)
    subroots = settled(below.tops().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tops")
    top = Forest(settled(numbered(subroots, ["name"]), "subroots"), arity)
    start = top.tops().select("tree", F.expr(EMPTY_PATH).alias("path"), F.col("digest").alias("root"))
    over = top.paths(settled(start, "root"), ["root"])
    over = settled(over.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "over")
    return below.paths(over, ["subroot", "root"]).drop("tree", "place", "n")


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its leaf, its proof, and the root recomputed after tampering with some texts.

    Where 3 divides the crc32 of the decimal doc_id, A-Z of the text are lower-cased before the leaf is taken
    again; a null text stays, and a row without a doc_id is never tampered with. Other columns are ignored.
    """
    values = [F.col(c) for c in FIELDS]
    changed = row_digest(*values[:-1], F.translate("text", UPPER, LOWER))
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    leaves = docs.select(
        tree_name(F.col("lang")).alias("tree"), "doc_id", row_digest(*values).alias("digest"), F.when(hit, changed).alias("claim")
    )
    made = manifest(leaves)
    again = folded(F.coalesce("claim", "digest"), F.col("path"))
    named = [_hex(F.col(c)).alias(name) for c, name in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"))]
    rows = made.select("doc_id", *named, proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark, sf_dir):
    from locuswise.llm.common import table

    return verified_manifest(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE
steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8),
           lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)) AS step
),
encoded AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS d, coalesce(strlen(source) || ':' || source, '-') AS s,
         coalesce(strlen(lang) || ':' || lang, '-') AS l, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, text,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT),
             lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, steps
),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(d || s || l || n || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(d || s || l || n || coalesce(strlen(low) || ':' || low, '-')) END AS claim
  FROM encoded
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
),
below AS (
  SELECT 0 AS level, tree, place, n, leaf AS digest FROM placed
  UNION ALL
  SELECT level + 1, tree, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM below WHERE n > 1
  GROUP BY level, tree, place // 8, n
),
subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n FROM below WHERE n = 1
),
above AS (
  SELECT 0 AS level, place, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM above WHERE n > 1
  GROUP BY level, place // 8, n
),
nodes AS (SELECT 0 AS part, level, tree, place, n, digest FROM below UNION ALL SELECT 1, level, '', place, n, digest FROM above),
sides AS (
  SELECT a.part, a.level, a.tree, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS left_side,
         coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS right_side
  FROM nodes a JOIN nodes b ON a.part = b.part AND a.level = b.level AND a.tree = b.tree AND a.place // 8 = b.place // 8
  WHERE a.n > 1 GROUP BY a.part, a.level, a.tree, a.place
),
climb AS (
  SELECT 0 AS level, tree, place AS leaf_place, place, coalesce(claim, leaf) AS h, '' AS seen FROM placed
  UNION ALL
  SELECT c.level + 1, c.tree, c.leaf_place, c.place // 8, sha256(left_side || h || right_side), seen || left_side || right_side
  FROM climb c JOIN sides s ON s.part = 0 AND s.level = c.level AND s.tree = c.tree AND s.place = c.place
),
reached AS (
  SELECT c.tree, leaf_place, s.place, h, seen, s.digest AS subroot FROM climb c JOIN subroots s ON s.tree = c.tree
  JOIN below b ON b.tree = c.tree AND b.level = c.level AND b.n = 1
),
over AS (
  SELECT 0 AS level, tree, leaf_place, place, h, seen, subroot FROM reached
  UNION ALL
  SELECT o.level + 1, o.tree, leaf_place, o.place // 8, sha256(left_side || h || right_side), seen || left_side || right_side, subroot
  FROM over o JOIN sides s ON s.part = 1 AND s.level = o.level AND s.place = o.place
)
SELECT p.doc_id, p.leaf, o.subroot, a.digest AS root, sha256(o.seen) AS proof_sha256, o.h AS folded_root, o.h = a.digest AS verified
FROM placed p JOIN over o ON o.tree = p.tree AND o.leaf_place = p.place JOIN above a ON a.n = 1 AND a.level = o.level
"""
