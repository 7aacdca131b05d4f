"""Toxicity by noisy-channel restoration: Viterbi over character lattices, then a word model on the restored text."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.functions.lineage import settled
from locuswise.llm.common import boxed

THRESHOLD = 0.3
#: Rows with crc32(doc_id as text) mod FOLDS = HELD_OUT never train.
FOLDS, HELD_OUT = 4, 2
#: Labelled rows that train the word model, at most; taken in the order of a hash of their doc_id.
TRAIN_ROWS = 6_000
#: Labelled documents that must have a feature for it to tell anything.
SEEN = 3
#: Buckets of the counts of 2, 3 and 4 letters.
BUCKET_BITS = 19
BUCKETS = 1 << BUCKET_BITS
#: Letters that a sign of "leetspeak" may stand for.
LEET = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "<": "c",
    "€": "e",
    "£": "l",
}
#: Signs that may stand between letters without meaning anything, and those stripped from a word's ends.
FILLERS = "*.-_~^'`\"#%&=/\\,:;·•"
EDGES = ".,;:!?\"'()[]{}|*#%&$~^`=/\\_-<>+"
#: Signs that may hide a vowel ("st*pid").
MASKS, VOWELS = "*#_", "aeiou"
#: Costs of the channel in nats: a sign read as a letter or as a hidden one, a filler left out, a repeated letter left out.
COST_LEET, COST_MASK, COST_FILLER, COST_REPEAT = 0.7, 2.5, 0.3, 0.4
#: Costs against the normal course: a plain letter left out is not allowed, a digit kept as it is is dear.
COST_KEPT = 9.0
SPACED = re.compile(r"(?<!\S)\W?\w(?:[^\w\s]*[ \t]+[^\w\s]*[\w@$!]){2,}[^\w\s]*(?!\S)")
ODD = re.compile(r"[^\W\d_].*[\W\d_]|[\W\d_].*[^\W\d_]|(.)\1\1")
#: Two single letters in a row, as every run of three has them; letters in runs; runs of a sign at an end.
SINGLES = re.compile(r"\s\W?\w\W*\s\W*[\w@$!]\W*(?:\s|\Z)")
THRICE = re.compile(r"([^\W\d_])\1\1")
RUNS = re.compile(r"^([^\w])\1+|([^\w])\2+$")
BATCH_ROWS = 512

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_MULTIPLIERS = {2: 0x9E3779B1, 3: 0x85EBCA6B, 4: 0xC2B2AE35}


def _gram_ids(raw: np.ndarray, n: int) -> np.ndarray:
    value = raw[: len(raw) - n + 1]
    for k in range(1, n):
        value = value * np.uint32(257) + raw[k : len(raw) - n + 1 + k]
    return (value * np.uint32(_MULTIPLIERS[n])) >> np.uint32(32 - BUCKET_BITS)


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = {n: np.zeros(BUCKETS, np.int64) for n in (2, 3, 4)}
    for batch in batches:
        # a whole batch at a time, texts apart by a blank
        raw = b" " + b" ".join((t or "").encode() for t in batch["text"].to_pylist()) + b" "
        for start in range(0, len(raw), 1 << 20):
            part = _LETTER[np.frombuffer(raw[start : start + (1 << 20) + 3], np.uint8)].astype(np.uint32)
            for n, table in counts.items():
                if len(part) >= n:
                    # windows that begin in the next part are counted there
                    table += np.bincount(_gram_ids(part, n)[: 1 << 20], minlength=BUCKETS)
    for n, table in counts.items():
        at = np.flatnonzero(table)
        yield pa.record_batch({"n": pa.array(np.full(len(at), n, np.int32)), "bucket": pa.array(at), "seen": pa.array(table[at])})


class Letters:
    """A character language model: counts of 2, 3 and 4 letters, interpolated."""

    def __init__(self, counts: dict[int, np.ndarray]):
        self.counts = counts
        self.total = max(1, int(counts[2].sum()))
        self.memo: dict[bytes, float] = {}

    def seen(self, gram: bytes) -> float:
        value = 0
        for b in gram:
            value = value * 257 + b
        n = len(gram)
        return float(self.counts[n][(value * _MULTIPLIERS[n] & (2**32 - 1)) >> (32 - BUCKET_BITS)])

    def cost(self, before: bytes, letter: bytes) -> float:
        """Nats of ``letter`` (one character) after the last three bytes ``before``."""
        key = before + letter
        if key not in self.memo:
            total = 0.0
            context = before
            for b in letter:
                one = bytes([b])
                p = 1e-4
                for n in (2, 3, 4):
                    whole = self.seen(context[-(n - 1) :] + one)
                    part = self.seen(context[-(n - 1) :]) if n > 2 else self.total / 40
                    p = (whole + 4.0 * p) / (max(part, whole) + 4.0)
                total -= math.log(max(p, 1e-9))
                context = (context + one)[-3:]
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[key] = total
        return self.memo[key]


def restore(word: str, letters: Letters) -> str:
    """The likeliest plain word behind ``word``: a Viterbi pass over its lattice of readings, whole and of any length.

    A sign may be read as one of its letters, left out if it is a filler, or kept; a letter equal to the one before
    may be left out. Paths that end in the same three letters (and the same last sign) compete.
    """
    paths = {(b"   ", ""): (0.0, None)}
    trail: list[dict] = []
    for sign in word:
        options: list[tuple[float, str]] = []
        if sign.isalpha() or sign == " ":
            options.append((0.0, sign))
        else:
            options += [(COST_LEET, x) for x in LEET.get(sign, "")]
            options += [(COST_MASK, x) for x in VOWELS if sign in MASKS]
            options.append((COST_KEPT, sign))
        fillers = sign in FILLERS or sign in "!|+( "
        step: dict = {}
        for state, (cost, _) in paths.items():
            before, last = state
            moves = [(c + letters.cost(before, x.encode()), x) for c, x in options]
            if fillers:
                moves.append((COST_FILLER, ""))
            moves += [(COST_REPEAT, "") for c, x in options[:1] if x == last or LEET.get(sign, "").find(last) >= 0 and last]
            for more, x in moves:
                new = ((before + x.encode())[-3:], x) if x else state
                if new not in step or cost + more < step[new][0]:
                    step[new] = (cost + more, (state, x))
        # far dearer paths can't win: a letter costs some nats at most
        least = min(c for c, _ in step.values())
        paths = {s: v for s, v in step.items() if v[0] < least + 25}
        trail.append(paths)
    best = min(paths, key=lambda s: paths[s][0] + letters.cost(s[0], b" "))
    out: list[str] = []
    for step in reversed(trail):
        best, x = step[best][1]
        out.append(x)
    return "".join(reversed(out))


def _plain(token: str, bare: str) -> bool:
    """A token whose only reading is ``bare``: letters alone, with no sign at its ends that may be a letter."""
    return bare.isalpha() and (len(bare) == len(token) or (token[0] not in LEET and token[-1] not in LEET))


def readings(token: str, letters: Letters) -> tuple[str, ...]:
    """What a token may say: itself without the signs at its ends, what it restores to, the words of letters set apart."""
    if " " in token:  # letters apart: a blank is left out, or ends a word
        whole = token.replace(" ", "").strip(EDGES)
        # a word of one letter may stand before or after
        parts = (whole, whole[1:], whole[:-1], whole[1:-1]) if len(whole) > 3 else (whole,)
        return tuple(dict.fromkeys((*parts, *restore(token, letters).split())))
    bare = token.strip(EDGES)
    # signs in a run at an end ("word$$$") decorate; a single one may be a letter
    inner = RUNS.sub("", token.strip(".,;:?\"'()[]{}"))
    found = [bare]
    if ODD.search(inner):
        found.append(restore(inner, letters))
    if bare != inner and ODD.search(bare):
        found.append(restore(bare, letters))
    return tuple(dict.fromkeys(w for w in found if w))


def tokens_of(low: str) -> set[str]:
    """The tokens of a lower-cased text, and each run of single letters (apart by a blank) as one."""
    found = set(low.split())
    if SINGLES.search(low):
        found.update(" ".join(run[0].split()) for run in SPACED.finditer(low))
    return found


def restored_words(text: str, letters: Letters, memo: dict[str, tuple[str, ...]]) -> set[str]:
    """The words of a text, lower-cased, with what odd ones and runs of single letters restore to."""
    low = text.lower()
    runs = THRICE.search(low) is not None
    words: set[str] = set()
    for token in tokens_of(low):
        bare = token.strip(EDGES)
        if _plain(token, bare) and not (runs and THRICE.search(bare)):
            words.add(bare)
            continue
        if token not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[token] = readings(token, letters)
        words.update(memo[token])
    return words


def features(word: str) -> list[int]:
    """Hashes of a word and of its first 6, 5 and 4 letters, from the most to the least specific."""
    parts = ["=" + word, *("^" + word[:n] for n in (6, 5, 4) if n < len(word))]
    return [zlib.crc32(p.encode()) for p in parts]


class Model(NamedTuple):
    """Weights of features, and the line that turns a document's two highest word scores into log-odds."""

    letters: dict[int, np.ndarray]
    weights: dict[int, float]
    #: Last features of the words that some feature speaks against.
    stems: frozenset[int]
    line: tuple[float, float, float]


def _evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-odds of a feature by the documents that have it, drawn towards none for rare ones; NaN for those too rare to tell."""
    odds = np.log((toxic + 1.0) / (n_toxic + 2.0)) - np.log((clean + 1.0) / (n_clean + 2.0)) - 4.0 / (1.0 + toxic)
    return np.where(toxic + clean >= SEEN, odds, np.nan)


def _summary(scores: list[float]) -> tuple[float, float]:
    top = sorted(scores, reverse=True)[:2] + [0.0, 0.0]
    return max(top[0], 0.0), max(top[1], 0.0)


def _feature_rows(counts: dict[int, np.ndarray]):
    """Per labelled row: the features of its restored words laid end to end, and how many each word has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, memo = Letters(counts), {}
        for batch in batches:
            found = [[features(w) for w in restored_words(t.as_py() or "", letters, memo)] for t in batch["text"]]
            yield batch.select(["doc_id", "toxic"]).append_column(
                "features", pa.array([np.array([f for w in one for f in w], "<u4").tobytes() for one in found], pa.binary())
            ).append_column("sizes", pa.array([np.array([len(w) for w in one], "<u4").tobytes() for one in found], pa.binary()))

    return run


def fit_words(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[dict[int, float], frozenset[int], tuple[float, float, float]]:
    """Word weights from document frequencies; the line by Newton steps on scores that leave each document out."""
    own = [np.unique(flat) for flat, _ in rows]
    names, inverse = np.unique(np.concatenate(own), return_inverse=True)
    owner = np.repeat(labels, [len(o) for o in own])
    counts = [np.bincount(inverse, weights=owner == y, minlength=len(names)) for y in (0, 1)]
    n = [int((labels == y).sum()) for y in (0, 1)]
    summaries = []
    for (flat, sizes), label in zip(rows, labels, strict=True):
        if not len(flat):
            summaries.append((0.0, 0.0))
            continue
        at = np.searchsorted(names, flat)
        weight = _evidence(counts[1][at] - label, counts[0][at] - (1 - label), n[1], n[0])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        # each word is judged by its most specific feature that enough documents have
        first = np.minimum.reduceat(np.where(np.isnan(weight), len(weight), np.arange(len(weight))), begins)
        summaries.append(_summary(list(np.append(weight, 0.0)[first])))
    weight = _evidence(counts[1], counts[0], n[1], n[0])
    kept = ~np.isnan(weight)
    bad = np.where(kept, weight, 0.0) > 0
    stems: set[int] = set()
    for flat, sizes in rows:
        if len(flat):
            ends = np.cumsum(sizes).astype(np.int64)
            speaks = np.logical_or.reduceat(bad[np.searchsorted(names, flat)], np.concatenate([[0], ends[:-1]]))
            stems.update(flat[ends - 1][speaks].tolist())
    weights = dict(zip(names[kept].tolist(), weight[kept].tolist(), strict=True))
    x = np.column_stack([np.array(summaries), np.ones(len(summaries))])
    line = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ (labels - p) - 0.01 * line
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.01 * np.eye(3)
        move = np.linalg.solve(curve, slope)
        line += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return weights, frozenset(stems), tuple(line)


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The letter counts of all ``docs``, and the word model of at most ``train_rows`` labelled rows outside the held-out fold.

    Rows with a null label or doc_id don't train. A doc_id labelled twice with different labels counts as toxic. With one
    class only, or none, the word model is empty and every document scores the share of toxic labels (0 without any).
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    grams = docs.select("text").mapInArrow(_letter_counts, "n int, bucket long, seen long").groupBy("n", "bucket").agg(F.sum("seen").alias("seen"))
    counts = {n: np.zeros(BUCKETS, np.float32) for n in (2, 3, 4)}
    table = grams.toPandas()  # 3 x BUCKETS rows at most
    for n, part in table.groupby("n"):
        counts[int(n)][part["bucket"].to_numpy()] = part["seen"].to_numpy()
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold(F.col("doc_id")) != HELD_OUT)
    chosen = (
        usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    chosen = settled(chosen, "labelled")
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").groupBy("doc_id")
    sample = sample.agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    rows = sample.mapInArrow(_feature_rows(counts), "doc_id long, toxic int, features binary, sizes binary").toPandas()  # train_rows at most
    rows = rows.sort_values("doc_id")
    target = (rows["toxic"].to_numpy() > 0).astype(int)
    if len(set(target)) < 2:
        share = float(target.mean()) if len(target) else 0.0
        return Model(counts, {}, frozenset(), (0.0, 0.0, math.log((share + 1e-6) / (1 - share + 1e-6))))
    sparse = [tuple(np.frombuffer(x, "<u4") for x in pair) for pair in zip(rows["features"], rows["sizes"], strict=True)]
    return Model(counts, *fit_words(sparse, target))


def _scored(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(model.letters)
        memo: dict = {}
        stems: dict[str, bool] = {}
        a, b, c = model.line
        for batch in batches:
            out = []
            for text in batch["text"]:
                scores = []
                for word in restored_words(text.as_py() or "", letters, memo):
                    stem = word[:4]
                    hot = stems.get(stem) if len(word) > 4 else None
                    if hot is None:
                        # a word can only count if its first four letters, or the whole of a short one, do
                        hot = features(word)[-1] in model.stems
                        if len(word) > 4:
                            stems[stem] = hot
                    if hot:
                        scores.append(next((w for w in map(model.weights.get, features(word)) if w is not None), 0.0))
                top, second = _summary(scores)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a * top + b * second + c)))))
            yield batch.drop_columns(["text"]).append_column("score", pa.array(out, pa.float64()))

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` (one of them text) but text, with the score of each row.

    Null, empty and blank texts have no words and score what a text without any sign of toxicity does. Repeated rows
    score alike. An empty table gives an empty result. The score depends on the text alone.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", score double"
    return docs.mapInArrow(_scored(model), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with all columns of ``docs``."""
    model = train(docs, labels)
    rated = scored(boxed(docs).select("_doc", "text"), model)
    return rated.filter(F.col("score") < threshold).select("_doc.*")


def query(spark, sf_dir):
    from locuswise.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    result = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return result.select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
