"""Near duplicates by an LSH forest: several sorted signature orders, with a depth that adapts to each region."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.functions.lineage import settled
from locuswise.llm import shingles
from locuswise.llm.common import ROW, keep_rows, stored_box, with_row_key
from locuswise.llm.graph import component_names

TREES = 16
#: Signature values that the rows of a region share, level by level; a region stops at the first level where it is small.
DEPTHS = (2, 4, 8, 16, 32, 64)
#: Members up to which a region gives all its pairs.
SMALL = 32
#: Percent of the union that linked sets share, and signature values (of 64) that a candidate pair shares at least:
#: a pair at 75 % shares 48 on average, and fewer than 28 once in some hundred million.
SIMILARITY = 75
AGREEING = 28
#: Bits a shingle that say which pairs cannot be similar enough.
BITS = 4
#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 512
#: Counters that say how common a shingle is: a table of one size for every input, used for an order only.
COUNTERS_LOG2 = 18
#: Rows of a slice of a posting, and shingles of one; a block holds two slices.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20

SIGNED = "doc_id long, _row long, n_shingles long, set_key binary, signature binary"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, bounds = shingles.shingle_hashes(batch["text"])
        values = shingles.signatures(hashes, bounds)
        sets = shingles.distinct_sets(hashes, bounds)
        yield pa.record_batch(
            {
                "doc_id": batch["doc_id"].cast(pa.int64()),
                ROW: batch[ROW],
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_key": pa.array([shingles.set_key(s) if len(s) else None for s in sets], pa.binary()),
                "signature": pa.array([v.astype("<u4").tobytes() for v in values], pa.binary()),
            }
        )


def signed_rows(docs: DataFrame) -> DataFrame:
    """Per row: size of its shingle set, a 128-bit name of the set (null if empty) and its MinHash signature."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select("doc_id", ROW, "text").mapInArrow(_signed, SIGNED)


def _region_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of each small region that their sizes and signatures allow."""
    for batch in batches:
        left, right = [], []
        for members in batch["members"]:
            rows = sorted(members.as_py(), key=lambda m: m["node"])
            node = np.array([m["node"] for m in rows])
            size = np.array([m["n_shingles"] for m in rows])
            low = np.frombuffer(b"".join(m["low"] for m in rows), np.uint8).reshape(len(rows), -1)
            for i in range(len(rows) - 1):
                near = (low[i + 1 :] == low[i]).sum(axis=1) >= AGREEING
                near &= 100 * np.minimum(size[i + 1 :], size[i]) >= SIMILARITY * np.maximum(size[i + 1 :], size[i])
                found = node[i + 1 :][near]
                left.append(np.full(len(found), node[i]))
                right.append(found)
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _star_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mine, other = (
            np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(len(batch), shingles.VALUES) for c in ("low", "pivot_low")
        )
        n, m = (batch[c].to_numpy() for c in ("n_shingles", "pivot_shingles"))
        near = (mine == other).sum(axis=1) >= AGREEING
        near &= 100 * np.minimum(n, m) >= SIMILARITY * np.maximum(n, m)
        yield batch.select(["pivot", "node"]).rename_columns(["a", "b"]).filter(pa.array(near))


def candidate_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes that may be near copies, from ``nodes`` (node, n_shingles, signature).

    A tree orders all signatures from another value on. Rows that share the first values of a tree form a
    region. A region of at most ``SMALL`` rows gives all its pairs. A larger one gives the pairs of all its rows
    with one pivot, the row that lies in the most crowded regions over all trees (of copies of one text, the
    text itself), and is looked at again at more values, until it falls apart into small ones. No region is
    cut off: each row of it meets at least the pivot, at every depth. What a large region leaves unsaid is for
    ``rest_links``: the large regions of the first depth (region, node) come second.
    """
    doubled = F.concat("signature", "signature")
    low = F.expr("array_join(transform(sequence(0, %d), i -> hex(substring(signature, 4 * i + 1, 1))), '')" % (shingles.VALUES - 1))
    sketch = settled(nodes.select("node", "n_shingles", F.unhex(low).alias("low")), "sketches")
    per_tree = shingles.VALUES // TREES
    key_at = lambda depth: F.array(
        *[F.xxhash64(F.lit(t), F.substring(doubled, 4 * per_tree * t + 1, 4 * depth)) for t in range(TREES)]
    )
    rows = nodes.select("node", F.explode(key_at(DEPTHS[0])).alias("region"))
    # counts are stored first: the join then deals both sides by region itself, and adaptive execution can split hot ones
    counts = settled(rows.groupBy("region").agg(F.count("*").alias("members")).filter("members > 1"), "counts")
    shared = settled(rows.join(counts, "region"), "regions")
    small = shared.filter(F.col("members") <= SMALL).select("region", "node")
    crowded = shared.filter(F.col("members") > SMALL).select("region", "node")
    stars = None
    if not crowded.isEmpty():
        places = _places(nodes, shared, F.array(*[key_at(depth) for depth in DEPTHS]))
        small = small.unionByName(places.filter(F.col("members") <= SMALL).select("region", "node"))
        meets = places.filter((F.col("members") > SMALL) & (F.col("pivot") != F.col("node"))).select("pivot", "node").distinct()
        other = sketch.select(
            F.col("node").alias("pivot"), F.col("n_shingles").alias("pivot_shingles"), F.col("low").alias("pivot_low")
        )
        stars = settled(meets, "meets").join(sketch, "node").join(other, "pivot").mapInArrow(_star_pairs, "a long, b long")
    members = F.collect_list(F.struct("node", "n_shingles", "low")).alias("members")
    pairs = small.join(sketch, "node").groupBy("region").agg(members).select("members").mapInArrow(_region_pairs, "a long, b long")
    if stars is not None:
        pairs = pairs.unionByName(stars)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), crowded


def _places(nodes: DataFrame, shared: DataFrame, keys) -> DataFrame:
    """Rows (node, region, members, pivot) of the large regions of the first depth and of all regions looked at below them.

    ``keys`` has a region per depth and tree. The regions of a tree lie in each other, so one count of all depths says
    which ones are looked at: those whose region one depth up is large.
    """
    spot = F.when(F.col("members") > SMALL, F.col("region"))
    spots = shared.groupBy("node").agg(F.sum("members").alias("crowd"), F.collect_list(spot).alias("regions")).filter("size(regions) > 0")
    each = nodes.select("node", "signature").join(settled(spots, "spots"), "node")
    each = each.select("node", "crowd", keys.alias("keys"), F.explode("regions").alias("region"))
    tree = F.array_position(F.col("keys")[0], F.col("region")).cast("int")
    each = each.select("node", "crowd", F.transform("keys", lambda k: F.element_at(k, tree)).alias("path"))
    each = each.select("node", "crowd", "path", F.posexplode("path").alias("depth", "region"))
    above = F.when(F.col("depth") > 0, F.col("path")[F.col("depth") - 1])
    places = settled(each.select("node", "crowd", "region", above.alias("above")), "places")
    first = F.min(F.struct((-F.col("crowd")).alias("less"), "node")).alias("first")
    found = places.groupBy("region").agg(F.count("*").alias("members"), F.min("above").alias("above"), first)
    found = settled(found.filter("members > 1").select("region", "members", "above", F.col("first.node").alias("pivot")), "counts-below")
    large = found.filter(F.col("members") > SMALL).select(F.col("region").alias("above"))
    looked_at = settled(found.filter("above IS NULL").unionByName(found.join(large, "above", "left_semi")).drop("above"), "looked-at")
    return settled(places.select("node", "region").join(looked_at, "region"), "places")


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """Full shingle sets: made where they are read, as eight bytes a shingle are more than its text and don't compress."""
    return shingles.distinct_sets(*shingles.shingle_hashes(texts))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNTERS_LOG2, np.int64)
    for batch in batches:
        for values in _sets(batch["text"]):
            np.add.at(counts, (values >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64), 1)
    used = np.flatnonzero(counts)
    yield pa.record_batch({"counter": pa.array(used, pa.int64()), "n": pa.array(counts[used], pa.int64())})


def _rare_shingles(counts):
    """Per set its rarest shingles, so many that two sets at ``SIMILARITY`` percent have one of them in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare, sizes = [], []
            for values in _sets(batch["text"]):
                order = np.lexsort((values, counts.value[(values >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64)]))
                rare.append(values[order[: len(values) - (SIMILARITY * len(values) + 99) // 100 + 1]].view(np.int64))
                sizes.append(len(values))
            times = np.repeat(np.arange(len(batch)), [len(r) for r in rare])
            posting = np.concatenate(rare) if rare else np.empty(0, np.int64)
            at = pa.array(times)
            columns = [pa.array(posting, pa.int64()), batch["node"].take(at), batch["component"].take(at), pa.array(np.array(sizes, np.int64)[times])]
            yield pa.record_batch(columns, ["posting", "node", "component", "n_shingles"])

    return run


def block_links(node: np.ndarray, component: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the components of a block as far as its full sets do: a spanning forest, not all links.

    Rows of the component that most rows have are looked for, not from: between two of them nothing is open.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
    names, label = np.unique(component, return_inverse=True)
    most = np.bincount(label).argmax()
    links = []
    for u in np.flatnonzero(label != most):
        first, last = (np.searchsorted(flat, sets[u], side=side) for side in ("left", "right"))
        count = last - first
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        linked = 100 * both >= SIMILARITY * (sizes + sizes[u] - both)
        for v in np.flatnonzero(linked & (label != label[u])):
            if label[v] != label[u]:
                label[label == label[v]] = label[u]
                links.append((min(node[u], node[v]), max(node[u], node[v])))
        if (label == label[0]).all():
            break
    return links


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for members in batch["members"]:
            rows = members.values
            node, component = (rows.field(c).to_numpy() for c in ("node", "component"))
            links = block_links(node, component, _sets(rows.field("text")))
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def rest_links(crowded: DataFrame, names: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed links (a, b) across components that large regions may have left out: enough to join what is linked.

    ``names`` (node, component) says what is linked so far. A large region whose rows are one component has
    nothing to add. The rows of the others are dealt by their rarest shingles (two sets at 75 % share one of these
    whatever the order is, so nothing is lost; the order keeps passages that many documents share out of it). A
    posting with one component again has nothing to add, and of postings with the same rows one is enough. The others
    are compared in their tasks on the full sets, in blocks of a slice of all rows and one of those outside the
    posting's largest component, and a block gives fewer links than it has rows, however many of its texts are alike.
    """
    spark = crowded.sparkSession
    known = settled(
        crowded.join(names, "node", "left").select("region", "node", F.coalesce("component", "node").alias("component")), "crowded"
    )
    mixed = known.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    mixed = settled(mixed.select("region"), "mixed")
    rest = settled(known.join(mixed, "region", "left_semi").select("node", "component").distinct(), "rest")
    texts = settled(texts.join(rest, "node").select("node", "component", "text"), "rest-texts")
    counted = texts.select("text").mapInArrow(_counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << COUNTERS_LOG2, np.int64)
    for part in counted.toArrow().to_batches():  # one row per counter at most
        counts[part["counter"].to_numpy()] = part["n"].to_numpy()
    run = _rare_shingles(spark.sparkContext.broadcast(counts))
    postings = settled(texts.mapInArrow(run, "posting long, node long, component long, n_shingles long"), "postings")
    # most rare shingles are those of one text or one component: what is left without them is little
    spread = postings.groupBy("posting").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    postings = settled(postings.join(settled(spread.select("posting"), "spread"), "posting"), "spread-postings")
    by_component = postings.groupBy("posting", "component").agg(
        F.count("*").alias("n"),
        F.sum("n_shingles").alias("shingles"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("xor"),
    )
    largest = F.max(F.struct("n", "component")).alias("largest")
    mixed = by_component.groupBy("posting").agg(
        F.count("*").alias("components"), largest, *[f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "shingles"), (F.sum, "sum"), (F.bit_xor, "xor"))]
    )
    mixed = mixed.filter("components > 1").groupBy("n", "sum", "xor").agg(F.min(F.struct("posting", "shingles", "largest")).alias("first"))
    slices = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("first.shingles") / BLOCK_SHINGLES)).cast("long")
    seeking = F.ceil(slices * (F.col("n") - F.col("first.largest.n")) / F.col("n")).cast("long")
    once = settled(mixed.select("first.posting", F.col("first.largest.component").alias("largest"), slices.alias("slices"), seeking.alias("seeking")), "mixed-postings")
    met = settled(postings.select("posting", "node", "component").join(once, "posting"), "across")
    texts = texts.join(settled(met.select("node").distinct(), "met"), "node", "left_semi")
    # a row lies in one slice; rows outside the largest component are seekers too, and meet every slice
    own, from_ = (F.pmod(F.xxhash64("node"), F.col(c)) for c in ("slices", "seeking"))
    as_member = met.select("posting", "node", own.alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("seeking") - 1)).alias("i"))
    as_seeker = met.filter("component != largest").select(
        "posting", "node", own.alias("own"), from_.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("j")
    )
    blocks = as_member.unionByName(as_seeker.filter("j != own").drop("own"))
    members = F.collect_list(F.struct("node", "component", "text")).alias("members")
    found = blocks.join(texts, "node").groupBy("posting", "i", "j").agg(members).select("members").mapInArrow(_block_links, "a long, b long")
    return settled(found.distinct(), "rest-links")


def linked_components(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of all nodes with a link: the pairs of the trees first, then what large regions left out."""
    pairs, crowded = candidate_pairs(nodes)
    links = settled(confirmed_links(pairs, texts), "links")
    names = component_names(links)
    if crowded.isEmpty():
        return names
    rest = rest_links(crowded, names, texts)
    if rest.isEmpty():
        return names
    return component_names(names.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 64):
            part = batch.slice(start, 64)
            sets = [shingles.distinct_sets(*shingles.shingle_hashes(part[c])) for c in ("text_a", "text_b")]
            linked = []
            for mine, other in zip(*sets, strict=True):
                both = len(np.intersect1d(mine, other, assume_unique=True))
                linked.append(100 * both >= SIMILARITY * (len(mine) + len(other) - both))
            yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def shingle_bits(values: np.ndarray) -> np.ndarray:
    """A bit per remainder of the hashes of a set, as bytes: a power of two of bits, at least ``BITS`` a shingle."""
    size = max(64, 1 << (BITS * len(values) - 1).bit_length())
    flags = np.zeros(size, np.uint8)
    flags[(values & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little")


def _with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingles.distinct_sets(*shingles.shingle_hashes(batch["text"]))
        sizes = pa.array([len(s) for s in sets], pa.int64())
        bits = pa.array([shingle_bits(s).tobytes() for s in sets], pa.binary())
        yield pa.record_batch([batch["node"], sizes, bits], ["node", "n", "bits"])


def most_common(n: int, mine: np.ndarray, m: int, other: np.ndarray) -> int:
    """Shingles that sets of ``n`` and ``m`` with these bits can have in common: a bit of one only is a shingle of one only."""
    while len(mine) > len(other):
        mine = mine[: len(mine) // 2] | mine[len(mine) // 2 :]
    while len(other) > len(mine):
        other = other[: len(other) // 2] | other[len(other) // 2 :]
    only = lambda x, y: int(np.bitwise_count(x & ~y).sum())
    return min(n - only(mine, other), m - only(other, mine))


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        columns = (batch[c].to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b"))
        for n, mine, m, other in zip(*columns, strict=True):
            both = most_common(n, np.frombuffer(mine, np.uint8), m, np.frombuffer(other, np.uint8))
            kept.append(100 * both >= SIMILARITY * (n + m - both))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def possible_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that bits of their full shingle sets leave open: no link is lost, and most other pairs need no texts."""
    wanted = settled(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    bits = settled(texts.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(_with_bits, "node long, n long, bits binary"), "bits")
    a, b = (bits.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    return pairs.join(b, "b").join(a, "a").mapInArrow(_possible, "a long, b long")


def confirmed_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough; ``texts`` has (node, text)."""
    pairs = settled(possible_pairs(settled(pairs, "pairs"), texts), "possible")
    wanted = settled(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    texts = settled(texts.join(wanted, "node", "left_semi"), "wanted-texts")
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.mapInArrow(_confirmed, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """Groups without the internal name of the component; see ``grouped_rows``. Rows are written with their ``_row`` first."""
    return grouped_rows(settled(docs.select("doc_id", ROW, "text"), "rows")).drop("component")


def grouped_rows(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text and a stored ``_row``): shingles of its text, its component and whether it stays.

    Equal shingle sets are one node from the start, so copies cost one row each. Null, empty and blank texts have
    no shingles and are linked with nothing; their component is their own doc_id. Rows repeated under one doc_id
    all carry the same component, and each of them with the smallest doc_id is marked; a null doc_id is never
    the smallest unless it is alone. An empty table gives an empty result; other columns are ignored.
    """
    rows = settled(signed_rows(docs), "signatures")
    filled = rows.filter("set_key IS NOT NULL")
    nodes = settled(
        filled.groupBy("set_key").agg(
            F.min(ROW).alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.min("doc_id").alias("least")
        ),
        "nodes",
    )
    texts = docs.select(F.col(ROW).alias("node"), "text")
    names = linked_components(nodes, texts)
    named = settled(
        nodes.select("set_key", "node", "least")
        .join(names, "node", "left")
        .select("set_key", F.coalesce("component", "node").alias("component"), "least"),
        "named",
    )
    least = settled(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    sets = settled(named.join(least, "component").select("set_key", "component", "component_id"), "sets")
    joined = rows.select("doc_id", ROW, "n_shingles", "set_key").join(sets, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    return joined.select("doc_id", ROW, "n_shingles", component.alias("component_id"), kept.alias("kept"), "component")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group, with all columns of ``docs``; rows without words all stay."""
    box = stored_box(docs)
    groups = grouped_rows(box)
    once = groups.filter("kept AND n_shingles > 0").groupBy("component").agg(F.min(ROW).alias(ROW)).select(ROW)
    return keep_rows(box, once.unionByName(groups.filter("n_shingles = 0").select(ROW)))


def query(spark, sf_dir):
    from locuswise.llm.common import table

    return near_groups(with_row_key(table(spark, sf_dir, "documents"))).drop(ROW)
