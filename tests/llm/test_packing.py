import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import awkward, documents
from locuswise.llm import packing, tokens
from locuswise.llm.common import table


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check_places(rows, capacity=packing.CAPACITY):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def check_pieces(rows, texts, tokenizer):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, pieces in by_doc.items():
        ids = np.array(ids_of(tokenizer, texts[doc_id]), "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        end = 0
        for p in pieces:
            assert p.start == end and (p.piece == 0 or p.length == packing.CAPACITY)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            end += p.length
        assert end == len(ids)


def test_whole_table_against_the_other_library(spark, small, tokenizer):
    rows = packing.query(spark, small).collect()
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    check_pieces(rows, texts, tokenizer)
    sequences = check_places(rows)
    assert sequences <= 1.02 * -(-sum(r.length for r in rows) // packing.CAPACITY) + 1


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, tmp_path, tokenizer, clashing):
    rows = [r for r in awkward() if r[0] != 4] + [(8, "it's <|endoftext|>  two\n\n  spaces \u00e9\u4e2d\U0001f600 123,456")]
    got = packing.pack_documents(documents(spark, tmp_path, rows, clashing)).collect()
    check_pieces(got, dict(rows), tokenizer)
    check_places(got)


def test_repeated_rows_are_packed_each(spark, tmp_path):
    got = packing.pack_documents(documents(spark, tmp_path, [(1, "a b c")] * 3)).collect()
    assert len(got) == 3 and check_places(got) == 1


def test_ids_come_back(spark, tmp_path, tokenizer):
    texts = {i: " ".join(f"w{j}" for j in range(i * 40)) for i in range(30)}
    packed = packing.pack_documents(documents(spark, tmp_path, list(texts.items())), keep_ids=True).cache()
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        ids = ids_of(tokenizer, texts[r.doc_id])[r.start : r.start + r.length]
        assert whole[r.sequence_id][r.offset : r.offset + r.length].tolist() == ids


def test_empty_table(spark, tmp_path):
    assert packing.pack_documents(documents(spark, tmp_path, [])).count() == 0


def test_long_texts_are_encoded_in_segments(tokenizer):
    text = "some words, and 12 numbers\n\n  here " * 40_000
    assert "".join(tokens.segments(text)) == text and len(list(tokens.segments(text))) > 1
    assert tokens.Encoder(tokens.vocabulary_path()).ids(text, 0).tolist() == ids_of(tokenizer, text)


@pytest.mark.parametrize(
    "text", ["a<|endoftext|>b", "<|endoftext|>", "  <|endoftext|>  \n<|endoftext|><|endoftext|", "x <|endoftext|> y\t", "<|endofText|>", ""]
)
def test_the_added_token(tokenizer, text):
    ids = tokens.Encoder(tokens.vocabulary_path()).ids(text, 0).tolist()
    assert ids == ids_of(tokenizer, text)
    assert ids.count(50256) == text.count("<|endoftext|>")


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_length_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(packing.CAPACITY + 1, np.int64)
    lengths = np.minimum(np.exp(rng.normal(5 + seed / 2, 1, 3000)).astype(int) + 1, packing.CAPACITY)
    np.add.at(counts, lengths, rng.integers(1, 50, len(lengths)))
    plan = packing.Plan(counts)
    seen = np.zeros_like(counts)
    for group, times in plan.groups:
        assert sum(group) <= packing.CAPACITY
        np.add.at(seen, list(group), times)
    assert (seen == counts).all()
    least = -(-int((counts * np.arange(len(counts))).sum()) // packing.CAPACITY)
    assert sum(times for _, times in plan.groups) <= 1.01 * least + 1


def test_least_squares_is_not_negative_and_optimal():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 30)), rng.random(12) * 10
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope <= 1e-4).all() and np.abs(slope[x > 1e-9]).max() < 1e-4
