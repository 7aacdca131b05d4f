"""Word shingles and MinHash signatures of many texts at once, on the bytes of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Values of a signature.
VALUES = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, _U(base), dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def coefficients(values: int = VALUES, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (
        rng.integers(0, 2**63, values, dtype=np.uint64) * _U(2) + _U(1),
        rng.integers(0, 2**63, values, dtype=np.uint64),
    )


def _fold_table() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, dtype=bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return lower, space


_LOWER, _SPACE = _fold_table()


def _spans(first: np.ndarray, last: np.ndarray, size: int = 1 << 20):
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(last, first[i] + size)))
        yield i, j
        i = j


def _word_sums(raw: np.ndarray, in_word: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word, from its place in the word on."""
    length = last - first + 1
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    place[~in_word] = 0
    with np.errstate(over="ignore"):
        terms = (_LOWER[raw].astype(np.uint64) + _U(1)) * _powers(_BASE, int(length.max()) + 1)[place]
        terms[~in_word] = 0
        return _mixed(np.add.reduceat(terms, first) + length.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) and, per text, where its words begin (one more entry at the end)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    in_word = ~_SPACE[raw]
    # a word begins where the byte before is a space or belongs to another text
    begins = in_word.copy()
    begins[1:] &= ~in_word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    begins[heads] = in_word[heads]
    ends = in_word.copy()
    ends[:-1] &= ~in_word[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = in_word[tails]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    hashes = np.empty(len(first), np.uint64)
    # a megabyte of words at a time keeps the 8-byte tables short, for one long text as for many short ones
    for i, j in _spans(first, last):
        part = slice(first[i], last[j - 1] + 1)
        hashes[i:j] = _word_sums(raw[part], in_word[part], first[i:j] - first[i], last[i:j] - first[i])
    return hashes, np.searchsorted(first, offsets).astype(np.int64)


def shingle_hashes(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word windows of ``width`` (with fewer words: of the whole sequence), and where each text's begin."""
    words, starts = word_hashes(texts)
    count = np.diff(starts)
    n = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    if not bounds[-1]:
        return np.empty(0, np.uint64), bounds
    with np.errstate(over="ignore"):
        padded = np.concatenate([words, np.zeros(width, np.uint64)])
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - starts[:-1], n)
        limit = np.repeat(starts[1:], n)
        out = np.zeros(len(at), np.uint64)
        for k in range(width):
            inside = at + k < limit
            out = _mixed(out * _U(3) + np.where(inside, padded[at + k], _U(k + 1)) + _U(k))
    return out, bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray, values: int = VALUES) -> np.ndarray:
    """MinHash values (texts x values, uint32); texts without shingles get zeros."""
    out = np.zeros((len(bounds) - 1, values), np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return out
    with np.errstate(over="ignore"):
        for k, (a, b) in enumerate(zip(*coefficients(values), strict=True)):
            least = np.minimum.reduceat((hashes ^ b) * a, bounds[full])
            out[full, k] = (least >> _U(32)).astype(np.uint32)
    return out


def distinct_sets(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def set_key(values: np.ndarray) -> bytes:
    """128 bits that follow from a set of hashes."""
    with np.errstate(over="ignore"):
        return np.array([_mixed(values).sum(dtype=np.uint64), _mixed(values ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], dtype="<u8").tobytes()
