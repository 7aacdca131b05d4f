import hashlib
import re

import numpy as np
import pytest

from helpers import awkward, documents
from locuswise.llm import crf, pii
from locuswise.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(digits[::-1]):
        d = int(d) * (2 if k % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": max(map(int, re.findall("[0-9]+", m[0]))) <= 255 if kind == "ip" else True}
            fits |= {"card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if fits[kind]:
                out.append((m.start(), list(PATTERNS).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


@pytest.fixture(scope="module")
def model():
    return pii.train()


TRICKY = [
    "a@b.c_d@e.f.g @x.y z@ q@r. a@@b.c a@b..c x@y-z.com.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.255 1.2.3 99999999999.1.1.1",
    "4539 1488 0343 6467 and 4539148803436467x 1234-5678-9012-3456 4539  1488",
    "+1 (555) 123-4567 +12 3 +49.30.123456789012345 ++1 234 567 890",
    "mail me: x@y.com, x@y.com é@ü.com 用户@例子.com",
    "+1 23 45 67 89 0 4539148803436467 10.0.0.1@host.com",
]


@pytest.mark.parametrize("text", [*TRICKY, "1" * 5000, "a." * 3000 + "@b.c", "@" * 2000, "+" * 2000 + "1"])
def test_patterns_equal_plain_ones(text):
    assert [f"{s.kind}:{s.start}:{s.end}" for s in pii.base_spans(text)] == plain(text)


@pytest.mark.parametrize("clashing", [False, True])
def test_rows(spark, tmp_path, model, clashing):
    rows = [*awkward(), *((100 + i, t) for i, t in enumerate(TRICKY)), (200, "x" * 20_000 + " me@a.org")]
    got = pii.detected(documents(spark, tmp_path, rows, clashing), model).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS]
        assert set(want) <= set(r.spans.split(",")) or not want
    assert pii.detected(documents(spark, tmp_path, []), model).count() == 0


def test_whole_table(spark, small):
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    for r in pii.query(spark, small).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(plain(texts[r.doc_id])).encode()).hexdigest()


def test_unseen_texts(model):
    hit = extra = missed = 0
    for text, gold in pii.labelled_texts(150, seed=321):
        found = {tuple(s) for s in pii.find_spans(text, model)[1]}
        gold = {tuple(s) for s in gold}
        hit, extra, missed = hit + len(found & gold), extra + len(found - gold), missed + len(gold - found)
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.95


def test_distant_repeats_take_the_same_label(model):
    text = "call me at 555 019 4423 today. " + "plain words follow here " * 50 + "or 555 019 4423 again"
    assert [s.kind for s in pii.find_spans(text, model)[1]] == ["phone", "phone"]


def test_loopy_beliefs_are_exact_on_trees_and_viterbi_is_best():
    rng = np.random.default_rng(2)
    chain = crf.Chain({}, np.zeros((0, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3))
    score, bond = rng.normal(size=(4, 3)), np.eye(3)
    links = []
    grid = np.stack(np.meshgrid(*[range(3)] * 4, indexing="ij"), -1).reshape(-1, 4)
    value = score[range(4), grid].sum(1) + chain.start[grid[:, 0]] + chain.end[grid[:, 3]] + sum(chain.step[grid[:, t], grid[:, t + 1]] for t in range(3))
    weight = np.exp(value - value.max())
    want = np.array([[weight[grid[:, t] == y].sum() for y in range(3)] for t in range(4)]) / weight.sum()
    np.testing.assert_allclose(np.exp(crf.loopy_beliefs(score, chain, links, bond)), want, rtol=1e-6)
    assert crf.viterbi(score, chain) == grid[value.argmax()].tolist()
    # one link closes a loop: beliefs come near the exact ones
    value += 0.5 * bond[grid[:, 0], grid[:, 3]]
    weight = np.exp(value - value.max())
    want = np.array([[weight[grid[:, t] == y].sum() for y in range(3)] for t in range(4)]) / weight.sum()
    assert np.abs(np.exp(crf.loopy_beliefs(score, chain, [(0, 3)], 0.5 * bond)) - want).max() < 0.05
