"""Connected components by randomised contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.functions.lineage import settled

#: Links that a task joins at once; as many that are left are joined by one task.
LINKS = 1 << 16


def star_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links but the least of its component, and that least one: what is joined stays joined."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in at.reshape(2, -1).T.tolist():
        x, y = top(x), top(y)
        up[max(x, y)] = min(x, y)
    tops = np.array([top(x) for x in range(len(nodes))], np.int64)
    lower = tops != np.arange(len(nodes))
    return nodes[lower], nodes[tops[lower]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def joined(parts):
        a, b = star_links(*(np.concatenate([p[c].to_numpy() for p in parts]) for c in "ab"))
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    waiting, held = [], 0
    for batch in batches:
        for first in range(0, batch.num_rows, LINKS):
            part = batch.slice(first, LINKS)
            if held + part.num_rows > LINKS:
                yield joined(waiting)
                waiting, held = [], 0
            waiting.append(part)
            held += part.num_rows
    if waiting:
        yield joined(waiting)


def _contracted(links: DataFrame) -> DataFrame:
    """Links with the same components, at most one less than nodes of each bundle of ``LINKS`` that a task sees."""
    kept = links.filter("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    return settled(kept.mapInArrow(_stars, "a long, b long"), "edges")


def component_names(links: DataFrame) -> DataFrame:
    """Per node of ``links`` (a, b): a node that names its component, from rounds of contraction.

    Tasks first join the links that they hold. When at most ``LINKS`` are left one task joins them. Until then, in each
    round every node moves to the neighbour (or itself) that comes first in an order drawn for the round;
    links inside a node vanish and tasks again join what they hold. An order drawn anew keeps chains of moves short, so the
    number of nodes falls by a constant factor a round. Only aggregates with partial sums and joins on node names are
    used; a node with many links is one row after the partial aggregation.
    """
    edges = _contracted(links)
    moves = []
    step = 0
    while (left := edges.count()) > LINKS:
        rank = lambda c, s=step: F.struct(F.xxhash64(c, F.lit(s)).alias("rank"), c.alias("node"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("other")).select(
            F.col("a").alias("old"), F.least(rank(F.col("a")), F.col("other"))["node"].alias("new")
        )
        move = settled(move, f"moves-{step}")
        moves.append(move)
        to_a, to_b = (move.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}")) for c in "ab")
        edges = _contracted(edges.join(to_a, "a").join(to_b, "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b")))
        step += 1
    if left:
        stars = settled(edges.coalesce(1).mapInArrow(_stars, "a long, b long"), f"moves-{step}")
        ends = stars.select(F.col("b").alias("old"), F.col("b").alias("new")).distinct()
        moves.append(stars.select(F.col("a").alias("old"), F.col("b").alias("new")).unionByName(ends))
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).filter(F.lit(False))
    names = settled(moves[-1].select(F.col("old").alias("node"), F.col("new").alias("component")), "names")
    for move in reversed(moves[:-1]):
        later = names.select(F.col("node").alias("new"), "component")
        names = settled(
            move.join(later, "new", "left").select(F.col("old").alias("node"), F.coalesce("component", "new").alias("component")),
            "names",
        )
    return names
