"""Spelling variants: words one code point apart, found by a dictionary of pairs of trie nodes.

All words stand in a trie of their beginnings and in one of their endings, and the nodes of both have numbers. What is
left of a word when one position is skipped is a pair of numbers (node before, node after); a word cut at a position
is such a pair too. Words that differ by a replaced code point share a pair of two skips; a word that has one code
point more shares the pair of its skip with the cut of the shorter one. Pairs are exact: equal numbers are equal texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.functions.lineage import settled

#: Code points of a word, occurrences of a word, and times a form must be as frequent as its variant, at least.
LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5
#: One run in so many loses a code point (see ``word_counts``).
DAMAGED = 199
#: Different words that a task counts before it hands its counts on.
HELD_WORDS = 1 << 18


def _counted(least: int, damaged: int | None):
    runs = re.compile(rf"[A-Za-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def given() -> pa.RecordBatch:
            made = pa.record_batch({"word": pa.array(list(held.keys()), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                # bytes.lower changes A-Z alone
                found = Counter(runs.findall((text.as_py() or "").encode().lower().decode()))
                doc_id = doc_id.as_py()
                before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in found.items():
                    if damaged and (h := zlib.crc32(run.encode(), before)) % damaged == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        if len(run) < least:
                            continue
                    held[run] += n
                if len(held) >= HELD_WORDS:
                    yield given()
        yield given()

    return count


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damaged: int | None = None) -> DataFrame:
    """(word, n): letter runs of whole texts (A-Z lower-cased) with enough code points and occurrences.

    With ``damaged``, a run whose crc32 of ``<doc_id>:<run>`` is divided by it loses the code point at crc32 modulo
    its length first. Tasks count before the shuffle, so a word that all texts use is a row per task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.mapInArrow(_counted(least_length, damaged), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _shared(a: str, b: str) -> int:
    for at, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return at
    return min(len(a), len(b))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word of a sorted partition, for each depth: the place of the first word here that has this beginning."""
    part, place, last, path = TaskContext.get().partitionId(), 0, "", []
    for batch in batches:
        words, firsts = batch["key"].to_pylist(), []
        for word in words:
            path = path[: _shared(last, word) + 1]
            path += [place] * (len(word) + 1 - len(path))
            firsts.append(path)
            last, place = word, place + 1
        yield pa.record_batch(
            {
                **{c: batch[c] for c in batch.schema.names},
                "part": pa.array([part] * len(words), pa.int32()),
                "place": pa.array(range(place - len(words), place), pa.int64()),
                "firsts": pa.array(firsts, pa.list_(pa.int64())),
            }
        )


def _borders(parts: list) -> dict[int, tuple[int, list[int]]]:
    """Per partition: the words before it, and for the depths its first word shares with the word before: the first word's rank.

    ``parts`` has one row per partition (part, words, least, most, firsts of the last word).
    """
    known, ranks, last, begin = {}, [], "", 0
    for row in sorted(parts, key=lambda r: r["part"]):
        carried = ranks[: _shared(last, row["least"]) + 1] if begin else []
        known[row["part"]] = (begin, carried)
        ranks = [carried[d] if not at and d < len(carried) else begin + at for d, at in enumerate(row["firsts"])]
        last, begin = row["most"], begin + row["words"]
    return known


def _node_numbers(borders: dict[int, tuple[int, list[int]]], stride: int):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ranks = [], []
            for part, place, firsts in zip(*(batch[c].to_pylist() for c in ("part", "place", "firsts")), strict=True):
                begin, carried = borders[part]
                own = [carried[d] if not at and d < len(carried) else begin + at for d, at in enumerate(firsts)]
                nodes.append([first * stride + d for d, first in enumerate(own)])
                ranks.append(begin + place)
            kept = {c: batch[c] for c in batch.schema.names if c not in ("key", "part", "place", "firsts")}
            yield pa.record_batch({**kept, "rank": pa.array(ranks, pa.int64()), "nodes": pa.array(nodes, pa.list_(pa.int64()))})

    return number


def trie_nodes(words: DataFrame) -> DataFrame:
    """Number the nodes of the trie over ``key``, and give each word its rank and the nodes on its path.

    The words are sorted by ranges. A node is named by the first word below it and its depth, so a task needs
    the word before and no table of nodes. A beginning that words of several partitions share is named by the word
    in the first of them: one row per partition (its first and last word) settles that on the driver. ``key`` must be
    distinct and not null; other columns stay.
    """
    others = [c for c in words.columns if c != "key"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema if f.name != "key")
    ordered = words.select("key", *others).repartitionByRange("key").sortWithinPartitions("key")
    stored = settled(ordered.mapInArrow(_paths, f"key string, {kinds}, part int, place long, firsts array<long>"), "paths")
    parts = stored.groupBy("part").agg(
        F.count("*").alias("words"), F.min("key").alias("least"), F.max("key").alias("most"), F.max_by("firsts", "key").alias("firsts"), F.max(F.size("firsts")).alias("longest")
    ).collect()
    stride = max((r["longest"] for r in parts), default=1)
    numbers = _node_numbers(_borders(parts), stride)
    return settled(stored.mapInArrow(numbers, f"{kinds}, rank long, nodes array<long>"), "trie")


def pair_dictionary(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words with rank, skips, cuts) of ``words`` (word, n).

    ``rank`` is a word's place in code-point order. ``skips`` (ahead, behind, rank, n, fresh) has a row per position
    left out; ``fresh`` is false where the code point before is the same one, as leaving out either gives one text.
    ``cuts`` (ahead, behind, rank, n) has a row per place where a code point may be put in.
    """
    forward = trie_nodes(words.select(F.col("word").alias("key"), "word", "n"))
    backward = trie_nodes(forward.select(F.reverse("word").alias("key"), "rank").withColumnRenamed("rank", "forward_rank"))
    both = settled(
        forward.select("word", "n", "rank", F.col("nodes").alias("heads")).join(
            backward.select(F.col("forward_rank").alias("rank"), F.col("nodes").alias("tails")), "rank"
        ),
        "words",
    )
    letters = F.split("word", "")
    numbered = both.select("rank", "n", "heads", "tails", letters.alias("letters"), F.size(letters).alias("size"))
    # tails[d] is the node of the ending of d code points
    skip = lambda i: F.struct(
        F.get("heads", i).alias("ahead"),
        F.get("tails", F.col("size") - 1 - i).alias("behind"),
        F.coalesce(F.get("letters", i) != F.get("letters", i - 1), F.lit(True)).alias("fresh"),
    )
    cut = lambda i: F.struct(F.get("heads", i).alias("ahead"), F.get("tails", F.col("size") - i).alias("behind"))
    skips = numbered.select("rank", "n", F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), skip)).alias("pair"))
    cuts = numbered.select("rank", "n", F.explode(F.transform(F.sequence(F.lit(0), F.col("size")), cut)).alias("pair"))
    return both.select("word", "n", "rank"), settled(skips.select("pair.*", "rank", "n"), "skips"), settled(cuts.select("pair.*", "rank", "n"), "cuts")


def near_words(skips: DataFrame, cuts: DataFrame) -> DataFrame:
    """Per word with a near one: (rank, n_near, best), where best is the near word (less = -n, rank) that comes first.

    Words that share a pair of skips differ there alone, so a pair has at most as many words as the alphabet has
    letters; their number and the first two of them tell each its own count and best without forming their pairs.
    """
    place = F.struct((-F.col("n")).alias("less"), "rank")
    alike = skips.groupBy("ahead", "behind").agg(F.count("*").alias("members"), F.sort_array(F.collect_list(place)).alias("order"))
    alike = alike.filter("members > 1").select("ahead", "behind", "members", F.slice("order", 1, 2).alias("first_two"))
    first, second = (F.element_at("first_two", i) for i in (1, 2))
    replaced = skips.join(alike, ["ahead", "behind"]).select(
        "rank", (F.col("members") - 1).alias("others"), F.when(first["rank"] == F.col("rank"), second).otherwise(first).alias("best")
    )
    longer = skips.filter("fresh").select("ahead", "behind", "rank", place.alias("long"))
    shorter = cuts.select("ahead", "behind", place.alias("short"))
    inserted = settled(longer.join(shorter, ["ahead", "behind"]).select("long", "short"), "inserted")
    one = F.lit(1).cast("long").alias("others")
    found = replaced.unionByName(inserted.select(F.col("long.rank").alias("rank"), one, F.col("short").alias("best")))
    found = found.unionByName(inserted.select(F.col("short.rank").alias("rank"), one, F.col("long").alias("best")))
    return found.groupBy("rank").agg(F.sum("others").alias("n_near"), F.min("best").alias("best"))


def last_forms(links: DataFrame) -> DataFrame:
    """(rank, last): where following ``links`` (rank, to) ends, by doubling the steps until nothing moves.

    ``links`` must have no circle; a word has few links to it (its near words), so no key is hot.
    """
    ahead = settled(links, "forms")
    while True:
        step = ahead.select(F.col("rank").alias("to"), F.col("to").alias("next"))
        moved = settled(ahead.join(step, "to", "left").select("rank", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("on")), "forms")
        ahead = moved.select("rank", "to")
        if moved.filter("on").isEmpty():
            return ahead.withColumnRenamed("to", "last")


def variant_groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Per word of ``words`` (word, n): its form, its root and its near words.

    Two words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its near
    word of largest n (of equal ones the first in code-point order) if that n is at least ``times`` as large; following
    forms to the last gives the root (n grows at each step, so that ends). A word without a form is its own root.
    Words must be distinct; null words and empty tables give nothing.
    """
    ranked, skips, cuts = pair_dictionary(words.filter("word IS NOT NULL AND word != ''").select("word", "n"))
    near = ranked.join(near_words(skips, cuts), "rank", "left")
    of_best = -F.col("best.less")
    formed = settled(
        near.select(
            "word", "n", "rank", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(of_best >= times * F.col("n"), F.col("best.rank")).alias("to"),
            F.when(of_best >= times * F.col("n"), of_best).alias("form_n"),
        ),
        "formed",
    )
    ends = last_forms(formed.filter("to IS NOT NULL").select("rank", "to"))
    named = lambda key, name: ranked.select(F.col("rank").alias(key), F.col("word").alias(name))
    joined = formed.join(ends, "rank", "left").join(named("to", "form"), "to", "left").join(named("last", "last_word"), "last", "left")
    return joined.select("word", "form", F.coalesce("last_word", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, damaged: int | None = None) -> DataFrame:
    """``variant_groups`` of the words of ``docs`` (doc_id, text).

    Null and empty texts have no words; a null doc_id enters the damaging hash as nothing. Repeated rows count each.
    Other columns are ignored.
    """
    return variant_groups(settled(word_counts(docs, damaged=damaged), "counts"))


def query(spark, sf_dir):
    from locuswise.llm.common import table

    return spelling_variants(table(spark, sf_dir, "documents"), damaged=DAMAGED)


SQL = r"""
WITH RECURSIVE
steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8),
           lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)) AS step
),
found AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM found GROUP BY ALL
),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || flatten(list_transform(string_split(doc_id || ':' || run, ''),
             lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)),
           lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, steps
),
damaged AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
skips AS (
  SELECT word, n, i, left(word, i) AS ahead, substr(word, i + 2) AS behind FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.ahead = b.ahead AND a.behind = b.behind AND a.i = b.i
  WHERE a.word != b.word
  UNION
  SELECT a.word, b.word, b.n FROM skips a JOIN words b ON a.ahead || a.behind = b.word
  UNION
  SELECT b.word, a.word, a.n FROM skips a JOIN words b ON a.ahead || a.behind = b.word
),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
),
follow AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL
  SELECT f.word, g.form, f.step + 1 FROM follow f JOIN formed g ON g.word = f.root WHERE g.form IS NOT NULL
),
ends AS (SELECT word, arg_max(root, step) AS root FROM follow GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM formed f JOIN ends e ON e.word = f.word
"""
