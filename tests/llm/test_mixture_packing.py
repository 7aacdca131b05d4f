import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import awkward, documents
from locuswise.llm import mixture_packing as mp
from locuswise.llm.common import table


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_sequences(rows, capacity=mp.CAPACITY):
    """Gapless places, no padding; returns the tokens of each sequence."""
    by_sequence = {}
    for r in rows:
        assert r.length > 0
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    lengths = {}
    for sequence, places in by_sequence.items():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end == capacity or (end < capacity and end & (end - 1) == 0)
        lengths[sequence] = end
    return lengths


def check_pieces(rows, texts, tokenizer):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, pieces in by_doc.items():
        ids = np.array(ids_of(tokenizer, texts[doc_id]), "<u4")
        end = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == end and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            end += p.length
        assert end == len(ids)


def test_whole_table(spark, small, tokenizer):
    docs = table(spark, small, "documents")
    rows = mp.pack_mixture(docs).collect()
    check_pieces(rows, {r.doc_id: r.text for r in docs.collect()}, tokenizer)
    lengths = check_sequences(rows)
    total = sum(lengths.values())
    assert sum(n < mp.CAPACITY for n in lengths.values()) == bin(total % mp.CAPACITY).count("1")
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append((r.sequence_id, r.length))
    for found in sources.values():
        share = sum(n for _, n in found) / total
        held = {}
        for sequence, n in found:
            held[sequence] = held.get(sequence, 0) + n
        for sequence, size in lengths.items():
            assert abs(held.get(sequence, 0) - share * size) < 4
    columns = mp.query(spark, small).columns
    assert columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, tmp_path, tokenizer, clashing):
    rows = [r for r in awkward() if r[0] != 4] + [(8, "it's <|endoftext|>  two\n\n é中\U0001f600 123,456", None), (9, "b c d", ""), (10, None, None)]
    got = mp.pack_mixture(documents(spark, tmp_path, rows, clashing)).collect()
    check_pieces(got, {r[0]: r[1] for r in rows}, tokenizer)
    check_sequences(got)


def test_repeated_rows_and_reruns(spark, tmp_path):
    docs = documents(spark, tmp_path, [(1, "a b c", "x")] * 50 + [(2, "a b c d e", "y")] * 20)
    first, second = (sorted(map(tuple, mp.pack_mixture(docs, capacity=16).collect()), key=str) for _ in range(2))
    assert first == second and sum(r[3] for r in first) == 50 * 4 + 20 * 6
    check_sequences(mp.pack_mixture(docs, capacity=16).collect(), 16)


def test_empty_table(spark, tmp_path):
    assert mp.pack_mixture(documents(spark, tmp_path, [])).count() == 0


def test_wanted_proportions(spark, tmp_path):
    rows = [(i, "word " * 30, "a") for i in range(60)] + [(100 + i, "word " * 30, "b") for i in range(60)] + [(200, "x", None)]
    got = mp.pack_mixture(documents(spark, tmp_path, rows), {"a": 3, "b": 1}, capacity=32, keep_ids=True).collect()
    check_sequences(got, 32)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, {}).setdefault(r.source, []).append(r.length)
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for sequence in range(40):  # a is not empty yet
        assert abs(sum(held[sequence]["a"]) - 24) <= 1
    last = max(k for k, v in held.items() if "a" in v)
    assert all("b" in held[k] for k in held if k > last and held[k].keys() != {None})


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.integers(0, 5000), min_size=1, max_size=9),
    st.sampled_from([1, 3, 8, 64]),
    st.sampled_from([2, 4, 64]),
    st.booleans(),
    st.randoms(use_true_random=False),
)
def test_every_token_has_one_place(sizes, capacity, fan, weighted, rng):
    sizes = [s // (1 + 63 * (capacity == 1)) for s in sizes]
    weights = [rng.choice([0, 1, 2.5]) for _ in sizes] if weighted else None
    turns = mp.Turns(sizes, weights, capacity, fan)
    places = set()
    for queue, size in enumerate(sizes):
        at = 0
        while at < size:
            end = min(size, at + rng.choice([1, 7, 300]))
            reached = at
            for starts, ends, sequences, offsets in turns.cut(queue, at, end):
                for a, b, s, o in zip(starts.tolist(), ends.tolist(), sequences.tolist(), offsets.tolist(), strict=True):
                    assert a == reached and b > a
                    reached = b
                    places.update((s, o + k) for k in range(b - a))
            assert reached == end
            at = end
    total = sum(sizes)
    assert len(places) == total
    assert sum(s < total // capacity for s, _ in places) == total // capacity * capacity


@pytest.mark.parametrize("m", [2, 20, 300])
def test_deficits_stay_small(m):
    rng = np.random.default_rng(m)
    totals = np.exp(rng.normal(4, 3, m)).astype(np.int64) + 1
    n = int(totals.sum()) // 64
    bounds = mp.shares([64] * n, totals.astype(float), totals)
    assert (np.diff(bounds, axis=0) >= 0).all() and (np.diff(bounds, axis=0).sum(axis=1) == 64).all()
    ideal = np.arange(n + 1)[:, None] * 64 * (totals / totals.sum())
    # queues that a window is too small to hold are lent a token now and then; the large ones wait for it
    assert np.abs(bounds - ideal).max() < max(2, m / 16)
