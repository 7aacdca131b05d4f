"""Mixture-controlled packing: deficit round-robin over one queue of tokens per source fills every sequence."""

from __future__ import annotations

import zlib
from collections import OrderedDict, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locuswise.functions.lineage import settled
from locuswise.llm import tokens

CAPACITY = 2048
END_ID = 1
#: Stretches into which a stretch of sequences is divided until single ones are left, and numbers that a task remembers.
FAN = 64
HELD_NUMBERS = 1 << 22
#: Rows that a task turns at once.
SLICE_ROWS = 256

TOKENISED = "doc_id long, source string, part int, begin long, doc_tokens long, ids binary"
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def served(size: int, weights: np.ndarray, deficits: np.ndarray, left: np.ndarray) -> np.ndarray:
    """One round: the tokens that each queue gives to a window of ``size`` tokens.

    A queue earns its share of the window on top of its deficit and gives as many whole tokens as that allows;
    what stays is carried in ``deficits`` (changed in place). Tokens that the fractions leave open come from the queues
    that are owed most. An empty queue keeps no deficit: its share goes to the others.
    """
    given, pool = np.zeros(len(left), np.int64), float(size)
    while size:
        live = left > given
        if not live.any():
            break
        pool += deficits[~live].sum()
        deficits[~live] = 0
        share = np.where(live, weights, 0.0)
        if not share.sum():
            share = live.astype(float)
        deficits += pool * share / share.sum()
        pool = 0.0
        more = np.where(live, np.clip(np.floor(deficits), 0, left - given), 0).astype(np.int64)
        if not more.any():
            owed = np.flatnonzero(live)
            more[owed[np.argsort(-deficits[owed], kind="stable")[:size]]] = 1
        while (excess := int(more.sum()) - size) > 0:
            ahead = np.flatnonzero(more)
            more[ahead[np.argsort(deficits[ahead] - more[ahead], kind="stable")[:excess]]] -= 1
        given += more
        deficits -= more
        size -= int(more.sum())
    return given


def shares(sizes: Sequence[int], weights: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Tokens that each queue has given before each window of ``sizes`` and after the last one."""
    out = np.zeros((len(sizes) + 1, len(left)), np.int64, order="F")
    deficits = np.zeros(len(left))
    for k, size in enumerate(sizes):
        out[k + 1] = out[k] + served(size, weights, deficits, left - out[k])
    return out


class Turns:
    """Which tokens of which queue stand in which sequence, from the queues' sizes alone.

    The rounds are played over long stretches of sequences first, then within a stretch over shorter ones, down to single
    sequences: each stretch knows what every queue gives to it, so tasks play just the stretches they need and still
    agree. Queues give to a stretch by ``weights`` (at first their sizes, so that all end together); the shorter
    ones within it share out what it was given in the same way, and a queue that runs empty does so evenly over the
    last of the first ``fan`` stretches that it reaches. The tokens that do not fill a sequence at the end form ones of powers of
    two, which need no padding.
    """

    def __init__(self, sizes: Sequence[int], weights: Sequence[float] | None = None, capacity: int = CAPACITY, fan: int = FAN):
        totals = np.array(sizes, np.int64)
        whole, rest = divmod(int(totals.sum()), capacity)
        self.capacity, self.fan, self.whole = capacity, fan, whole
        per = self._step(whole)
        first = [self.capacity * min(per, whole - at) for at in range(0, whole, per)]
        tail = [1 << k for k in reversed(range(capacity.bit_length())) if rest >> k & 1]
        weights = totals.astype(float) if weights is None else np.array(weights, float)
        self.top, self.per = shares([*first, *tail], weights, totals), per
        self.stretches = len(first)
        self.known: OrderedDict = OrderedDict()
        self.most = max(8, HELD_NUMBERS // max(1, (fan + 1) * len(totals)))

    def _step(self, n: int) -> int:
        per = 1
        while per * self.fan < n:
            per *= self.fan
        return per

    def _within(self, at: int, n: int, low: np.ndarray, high: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Of a stretch: sequences a part, what the queues gave before each part, and where each queue's tokens lie in a part."""
        if (at, n) in self.known:
            self.known.move_to_end((at, n))
            return self.known[at, n]
        per, own = self._step(n), high - low
        sizes = [self.capacity * min(per, n - k) for k in range(0, n, per)]
        bounds = np.asfortranarray(low + shares(sizes, own.astype(float), own))
        taken = np.diff(bounds, axis=0)
        found = self.known[at, n] = per, bounds, np.asfortranarray(np.cumsum(taken, axis=1) - taken)
        if len(self.known) > self.most:
            self.known.popitem(last=False)
        return found

    def cut(self, queue: int, begin: int, end: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(from, to, sequence, offset) of the pieces of the queue's tokens from ``begin`` to ``end``."""
        while begin < end:
            column = self.top[:, queue]
            k = int(np.searchsorted(column, begin, side="right")) - 1
            stop = min(end, int(column[k + 1]))
            if k >= self.stretches:
                before = int((self.top[k + 1] - self.top[k])[:queue].sum())
                place = before + begin - int(column[k])
                yield tuple(np.array([x]) for x in (begin, stop, self.whole + k - self.stretches, place))
            else:
                at = k * self.per
                yield from self._cut(queue, begin, stop, at, min(self.per, self.whole - at), self.top[k], self.top[k + 1])
            begin = stop

    def _cut(self, queue, begin, end, at, n, low, high):
        per, bounds, places = self._within(at, n, low, high)
        column = bounds[:, queue]
        first, last = int(np.searchsorted(column, begin, side="right")) - 1, int(np.searchsorted(column, end, side="left"))
        if per > 1:
            for k in range(first, last):
                inner = max(begin, int(column[k])), min(end, int(column[k + 1]))
                if inner[0] < inner[1]:
                    yield from self._cut(queue, *inner, at + k * per, min(per, n - k * per), bounds[k], bounds[k + 1])
            return
        starts, ends = np.maximum(column[first:last], begin), np.minimum(column[first + 1 : last + 1], end)
        held = starts < ends
        offsets = places[first:last, queue] + starts - column[first:last]
        yield starts[held], ends[held], at + np.arange(first, last)[held], offsets[held]


def _tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.Encoder(path), TaskContext.get().partitionId()
        kind = "<u2" if encoder.of.n_vocab <= 1 << 16 else "<u4"
        begun: dict = defaultdict(int)
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                begins, counts, kept = [], [], []
                for source, text in zip(rows["source"].to_pylist(), rows["text"], strict=True):
                    ids = encoder.ids(text.as_py(), end_id)
                    begins.append(begun[source])
                    counts.append(len(ids))
                    kept.append(ids.astype(kind).tobytes())
                    begun[source] += len(ids)
                parts = pa.array([part] * len(rows), pa.int32())
                columns = [rows["doc_id"], rows["source"], parts, pa.array(begins, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())]
                yield pa.record_batch(columns, ["doc_id", "source", "part", "begin", "doc_tokens", "ids"])

    return run


def tokenised(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Per row its token ids (closed by ``end_id``; two bytes each where the vocabulary allows) and its place in a queue.

    A task appends its rows to one queue per source as they come; ``begin`` counts the tokens of that source
    before a row in the task, and ``part`` is the task. The result must be stored before it is used.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(_tokenised(path or tokens.vocabulary_path(), end_id), TOKENISED)


def _cut_pieces(sizes: list[int], weights: list[float] | None, capacity: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = Turns(sizes, weights, capacity)
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                yield _slice_pieces(turns, batch.slice(at, SLICE_ROWS), keep_ids)

    return cut


def _slice_pieces(turns: Turns, rows: pa.RecordBatch, keep_ids: bool) -> pa.RecordBatch:
    row, numbers, sums, parts = [], [[], [], [], []], [], []
    columns = (rows[c].to_pylist() for c in ("queue", "begin", "doc_tokens"))
    for k, (queue, begin, count) in enumerate(zip(*columns, strict=True)):
        raw = rows["ids"][k].as_py()
        ids = np.frombuffer(raw, f"<u{len(raw) // count}").astype("<u4").tobytes()
        for found in turns.cut(queue, begin, begin + count):
            starts, ends = found[0] - begin, found[1] - begin
            row += [k] * len(starts)
            for into, x in zip(numbers, (starts, ends - starts, *found[2:]), strict=True):
                into.append(x)
            for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True):
                sums.append(zlib.crc32(ids[a:b]))
                if keep_ids:
                    parts.append(ids[a:b])
    at = pa.array(row, pa.int64())
    start, length, sequence, offset = (pa.array(np.concatenate(x) if x else [], pa.int64()) for x in numbers)
    made = {
        "doc_id": rows["doc_id"].take(at), "source": rows["source"].take(at), "start": start, "length": length,
        "ids_crc32": pa.array(sums, pa.int64()), "doc_tokens": rows["doc_tokens"].take(at), "sequence_id": sequence, "offset": offset,
    }
    return pa.record_batch(made | ({"ids": pa.array(parts, pa.binary())} if keep_ids else {}))


def pack_mixture(
    docs: DataFrame, weights: dict[str | None, float] | None = None, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, source, text) in sequences that each hold the sources in the target proportions.

    ``weights`` says the proportions by source name; a source without one gets what the others leave when they are
    empty. Without it the proportions are the sources' own shares of all tokens, so that every sequence mirrors the
    whole. Every token of every row lies in one piece, all sequences are full and the last ones have a power of two, so
    nothing is padded. A null or empty text is its closing id alone; a null source is a queue of its own, the last.
    Repeated rows are packed each. An empty table gives an empty result; other columns are ignored.

    The driver sees one row per source (the mixture is a table by source: name sources so that they fit there).
    """
    rows = settled(tokenised(docs, path), "tokens")
    sizes = settled(rows.groupBy("source", "part").agg(F.sum("doc_tokens").alias("tokens")), "queue-parts")
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    queues = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    queues = settled(queues.withColumn("queue", F.row_number().over(by_name) - 1), "queues")
    found = sorted(queues.collect(), key=lambda r: r["queue"])
    wanted = None if weights is None else [float(weights.get(r["source"], 0)) for r in found]
    before = F.sum("tokens").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    named = sizes.join(queues.select(F.col("source").alias("name"), "queue"), F.col("source").eqNullSafe(F.col("name")))
    begins = named.select("name", F.col("part").alias("of"), "queue", F.coalesce(before, F.lit(0)).alias("ahead"))
    placed = rows.join(settled(begins, "queue-begins"), F.col("source").eqNullSafe(F.col("name")) & (F.col("part") == F.col("of")))
    placed = placed.select("doc_id", "source", "queue", (F.col("begin") + F.col("ahead")).alias("begin"), "doc_tokens", "ids")
    cut = _cut_pieces([r["tokens"] for r in found], wanted, capacity, keep_ids)
    return placed.mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def query(spark, sf_dir):
    from locuswise.llm.common import table

    return pack_mixture(table(spark, sf_dir, "documents")).drop("source")
