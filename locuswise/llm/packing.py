"""Packing documents into fixed-size sequences by length patterns fitted with non-negative least squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locuswise.functions.lineage import settled
from locuswise.llm import tokens
from locuswise.llm.common import ROW, with_row_key

CAPACITY = 2048
END_ID = 0
#: Lengths are fitted in classes of this width, with patterns of at most this many documents.
CLASS_WIDTH = 16
PATTERN_DOCS = 3
BATCH_ROWS = 256

PIECES = "doc_id long, _row long, piece int, start long, length long, ids_crc32 long"


def _token_pieces(path: str, capacity: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, row, text in zip(*(batch[c].to_pylist() for c in ("doc_id", ROW, "text")), strict=True):
                ids = encoder.ids(text, END_ID)
                ends = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                start = 0
                for piece, end in enumerate(ends):
                    raw = ids[start:end].tobytes()
                    out.append((doc_id, row, piece, start, end - start, zlib.crc32(raw), raw))
                    start = end
            names = ["doc_id", ROW, "piece", "start", "length", "ids_crc32", "ids"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            kept = len(names) - (not keep_ids)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns[:kept], kinds, strict=False)], names[:kept])

    return cut


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The documents' token ids, each closed by id 0 and cut into pieces; only the first piece may be shorter.

    Ids are those of the byte-level BPE vocabulary with 50,257 entries (see ``tokens.Encoder``). With ``keep_ids``,
    column ids has them as little-endian bytes.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    cut = _token_pieces(path or tokens.vocabulary_path(), capacity, keep_ids)
    rows = docs.select(F.col("doc_id").cast("long"), ROW, "text")
    return rows.mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """min |a x - b| with x >= 0, by an active set: the column with the steepest descent enters, negative ones leave."""
    gram, aim = a.T @ a, a.T @ b
    gram[np.diag_indices_from(gram)] += 1e-9
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = np.where(active, -np.inf, aim - gram @ x)
        best = int(np.argmax(slope))
        if slope[best] <= 1e-7 * max(1.0, np.abs(aim).max()):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            trial = np.linalg.solve(gram[np.ix_(at, at)], aim[at])
            if (trial > 0).all():
                x[:] = 0
                x[at] = trial
                break
            falls = trial <= 0
            step = np.min(x[at][falls] / np.maximum(x[at][falls] - trial[falls], 1e-300))
            x[at] += step * (trial - x[at])
            active[at[falls & (x[at] <= 1e-12)]] = False
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    return x


class Plan:
    """Patterns of lengths with repeat counts, made from the histogram of lengths alone (at most ``capacity`` numbers)."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY, width: int = CLASS_WIDTH, docs: int = PATTERN_DOCS):
        self.capacity, self.left = capacity, counts.astype(np.int64).copy()
        self.groups: list[tuple[tuple[int, ...], int]] = []
        self._fit(max(1, min(width, capacity // 4)), docs)
        self._best_fit()

    def _fit(self, width: int, docs: int) -> None:
        size, left = self.capacity, self.left
        self._add((size,), int(left[size]))
        classes = -(-(size - 1) // width)
        middle = np.arange(classes) * width + (width + 1) / 2
        present = np.add.reduceat(left[1:size], np.arange(0, size - 1, width)).astype(float)
        usable = np.flatnonzero(present)
        patterns = [
            p
            for n in range(2, docs + 1)
            for p in combinations_with_replacement(usable, n)
            if size - width < sum(middle[list(p)]) <= size
        ]
        if not patterns:
            return
        a = np.zeros((classes, len(patterns)))
        for j, p in enumerate(patterns):
            np.add.at(a[:, j], list(p), 1.0)
        repeats = np.rint(nnls(a, present)).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] > 0:
                self._realise(patterns[j], int(repeats[j]), width)

    def _add(self, lengths: tuple[int, ...], times: int) -> None:
        if times > 0:
            self.groups.append((lengths, times))
            np.subtract.at(self.left, list(lengths), times)

    def _realise(self, pattern: tuple[int, ...], times: int, width: int) -> None:
        """Fill a pattern's places with lengths that are left, while they fill the sequence to the last token.

        The last two places are chosen together: lengths near their classes that add up to just what is open.
        """
        *ahead, second, _ = sorted(pattern, reverse=True)
        while times:
            chosen: list[int] = []
            spare = self.left.copy()
            for c in ahead:
                low, high = c * width + 1, min((c + 1) * width, self.capacity - 1)
                there = np.flatnonzero(spare[low : high + 1] > 0)
                if not len(there):
                    return
                chosen.append(low + int(there[-1]))
                spare[chosen[-1]] -= 1
            gap = self.capacity - sum(chosen)
            one = np.arange(max(second * width + 1, 1), min((second + 1) * width, gap - 1) + 1)
            fits = one[(spare[one] > (2 * one == gap)) & (spare[gap - one] > 0)]
            if not len(fits):
                return
            chosen += [int(fits[-1]), gap - int(fits[-1])]
            need = {n: chosen.count(n) for n in chosen}
            repeat = min(times, *(int(self.left[n]) // k for n, k in need.items()))
            if not repeat:
                return
            self._add(tuple(chosen), repeat)
            times -= repeat

    def _best_fit(self) -> None:
        """Best fit for what is left, longest first, on groups of equal sequences: open ones are those with room."""
        room: dict[int, list[list]] = {}
        for lengths, times in self.groups:
            gap = self.capacity - sum(lengths)
            room.setdefault(gap, []).append([lengths, times])
        spaces = np.zeros(self.capacity + 1, bool)
        spaces[list(room)] = True
        for n in range(self.capacity, 0, -1):
            todo = int(self.left[n])
            while todo:
                fits = np.flatnonzero(spaces[n:])
                if len(fits):
                    gap = n + int(fits[0])
                    lengths, times = room[gap].pop()
                    take = min(times, todo)
                    if take < times:
                        room[gap].append([lengths, times - take])
                else:
                    each = self.capacity // n
                    lengths, gap, take = (), self.capacity, -(-todo // each) if todo >= each else 1
                if gap in room and not room[gap]:
                    spaces[gap] = False
                room.setdefault(gap - n, []).append([(*lengths, n), take])
                spaces[gap - n] = True
                todo -= take
        self.left[:] = 0
        self.groups = [(lengths, times) for all_of in room.values() for lengths, times in all_of]

    def slots(self) -> dict[str, np.ndarray]:
        """Places by length: the documents of a length numbered from 0 take its places in order."""
        rows, used, first = [], np.zeros(self.capacity + 1, np.int64), 0
        for lengths, times in self.groups:
            offset = 0
            for n in lengths:
                rows.append((n, used[n], first, offset))
                used[n] += times
                offset += n
            first += times
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        return dict(zip(("length", "begin", "sequence", "offset"), table.T, strict=True))


def _placed(slots: dict[str, np.ndarray]):
    # lengths are below 2^12 and numbers below 2^50: one sorted key finds both
    keys = (slots["length"] << 50) + slots["begin"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 50) + rank, side="right") - 1
            columns = {c: batch[c] for c in batch.schema.names if c != "rank"}
            columns["sequence_id"] = pa.array(slots["sequence"][at] + rank - slots["begin"][at])
            columns["offset"] = pa.array(slots["offset"][at])
            yield pa.record_batch(columns)

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (``_row``, piece, length) its sequence and its place in it.

    The histogram of lengths (at most ``capacity`` rows) is all that the driver sees. Pieces of a length are
    numbered within slices drawn by a hash, then slices are laid end to end, so a length that a third of all pieces
    have is spread over as many tasks as there are slices.
    """
    pieces = settled(pieces, "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    slots = Plan(histogram, capacity).slots()
    slices = max(16, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64(ROW, "piece"), F.lit(slices)))
    sizes = sliced.groupBy("length", "slice").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    begins = settled(sizes.select("length", "slice", F.coalesce(before, F.lit(0)).alias("begin")), "begins")
    local = F.row_number().over(Window.partitionBy("length", "slice").orderBy(ROW, "piece")) - 1
    ranked = sliced.withColumn("local", local).join(begins, ["length", "slice"])
    ranked = ranked.select(*pieces.columns, (F.col("begin") + F.col("local")).alias("rank"))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(_placed(slots), schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with sequence_id and offset.

    A null or empty text is one piece with the closing id alone. Repeated rows are packed each for itself. An empty
    table gives an empty result; other columns are ignored. ``docs`` must be a scan of stored files.
    """
    return pack(token_pieces(with_row_key(docs), capacity=capacity, keep_ids=keep_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids (little-endian bytes), from pieces packed with ``keep_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda whole, part: F.concat(whole, part["ids"])).alias("ids"),
    )


def query(spark, sf_dir):
    from locuswise.llm.common import table

    return pack_documents(table(spark, sf_dir, "documents")).drop(ROW)
