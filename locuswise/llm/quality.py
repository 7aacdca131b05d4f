"""Quality rules: counts of each text, and a calibrated logistic regression on hashed words and characters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.functions.lineage import settled
from locuswise.llm import linear

THRESHOLD = 0.5
MIN_WORDS, MOST_REPEATED = 50, 50
#: Labelled rows that train the model, at most; taken in the order of a hash of their doc_id.
TRAIN_ROWS = 2_000
#: Buckets for characters and for words.
BUCKETS = 1 << 14
BATCH_ROWS = 512
SYMBOLS = b"#*$%&|<>"
_SPACE, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL[list(SYMBOLS)] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(ids: np.ndarray) -> int:
    """Words in windows of three that are found twice or more."""
    if len(ids) < 3:
        return 0
    size = np.int64(ids.max()) + 1
    pairs = ids[:-1] * size + ids[1:]
    if size > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """The counts of a text, and its hashed features with values (each kind of length 1/2 at most)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    table: dict[bytes, int] = {}
    ids = np.array([table.setdefault(w, len(table)) for w in words], dtype=np.int64)
    data = np.frombuffer(raw, np.uint8)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    counts = (
        len(words),
        int((_HEAD[data] & ~_SPACE[data]).sum()),
        int(_SYMBOL[data].sum()),
        len(lines) - len(set(lines)),
        _repeated(ids),
    )
    chars = np.zeros(BUCKETS)
    for start in range(0, len(data), 1 << 20):
        part = data[start : start + (1 << 20) + 3].astype(np.uint32)
        gram = part
        for n in (1, 2, 3, 4):
            if n > 1:
                gram = gram[:-1] * np.uint32(0x01000193) + part[n - 1 :]
            if not len(gram):
                break
            spread = (gram * np.uint32(0x9E3779B1)) >> np.uint32(18)
            chars += np.bincount(spread[: 1 << 20], minlength=BUCKETS)
    tokens = np.zeros(BUCKETS)
    if len(words):
        hashed = np.array([zlib.crc32(w) for w in table], dtype=np.uint32)[ids]
        for gram in (hashed, hashed[:-1] * np.uint32(3) + hashed[1:]):
            tokens += np.bincount((gram * np.uint32(0x85EBCA6B)) >> np.uint32(18), minlength=BUCKETS)
    at, values = [], []
    for base, found in ((0, chars), (BUCKETS, tokens)):
        there = np.flatnonzero(found)
        value = np.sqrt(found[there])
        at.append(there + base)
        values.append(value / (np.linalg.norm(value) * np.sqrt(2)) if len(value) else value)
    return counts, np.concatenate(at), np.concatenate(values)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> linear.Fitted:
    """Fit P(quality = 1) on at most ``train_rows`` labelled rows.

    Rows with a null doc_id or label don't train; a doc_id labelled twice counts with its lower label.
    """
    usable = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = settled(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "labelled")
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id")
    sample = sample.agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    sparse = sample.select("doc_id", "quality", "text").mapInArrow(_features, "doc_id long, quality double, at binary, value binary")
    rows: pd.DataFrame = sparse.toPandas().sort_values("doc_id")  # train_rows at most
    data = linear.Rows.of(
        [(np.frombuffer(a, "<u4"), np.frombuffer(v, "<f4")) for a, v in zip(rows["at"], rows["value"], strict=True)]
    )
    return linear.fit(data, (rows["quality"].to_numpy() > 0).astype(float), 2 * BUCKETS, steps=80, parts=2)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(t.as_py())[1:] for t in batch["text"]]
        yield pa.record_batch(
            {
                "doc_id": batch["doc_id"].cast(pa.int64()),
                "quality": batch["quality"].cast(pa.float64()),
                "at": pa.array([a.astype("<u4").tobytes() for a, _ in found], pa.binary()),
                "value": pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary()),
            }
        )


def _measured(model: linear.Fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, margins = [], []
            for text in batch["text"]:
                one, at, value = measure(text.as_py())
                counts.append(one)
                margins.append(float(model.weights[at] @ value) + model.bias)
            columns = {c: batch[c] for c in batch.schema.names if c != "text"}
            for name, values in zip(COUNTS, list(zip(*counts, strict=True)) or [()] * len(COUNTS), strict=True):
                columns[name] = pa.array(values, pa.int64())
            columns["quality_score"] = pa.array(model.probability(np.array(margins, float)), pa.float64())
            yield pa.record_batch(columns)

    return run


def judged(docs: DataFrame, model: linear.Fitted, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts, base_failed, the model's probability and the verdict.

    Null, empty and blank texts have no words and fail the base rule. Repeated rows are judged alike. An empty table
    gives an empty result; other columns are ignored.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", quality_score double"
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measured(model), schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= threshold))


def query(spark, sf_dir):
    from locuswise.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, train(docs, table(spark, sf_dir, "labels")))
