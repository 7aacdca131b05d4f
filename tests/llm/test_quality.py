import re

import pytest
from pyspark.sql import functions as F

from helpers import awkward, documents, stored
from locuswise.llm import linear, quality
from locuswise.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


@pytest.fixture(scope="module")
def model():
    return linear.Fitted(__import__("numpy").zeros(2 * quality.BUCKETS), 0.0, 1.0, 0.0)


@pytest.mark.parametrize("clashing", [False, True])
def test_counts_of_awkward_rows(spark, tmp_path, model, clashing):
    rows = [r for r in awkward() if r[0] != 4] + [(10, "a b c a b c a b c d"), (11, "x\n\nx\n x\nx\n\n"), (12, "é$%\u00a0ü <b>\x1c z\x85"), (13, "a a a a a a")]
    got = quality.judged(documents(spark, tmp_path, rows, clashing), model).collect()
    assert {r.doc_id: tuple(r[c] for c in quality.COUNTS) for r in got} == {d: base(t) for d, t in rows}
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_whole_table_against_plain_counts_and_held_out_labels(spark, small):
    docs = table(spark, small, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.query(spark, small).collect()
    assert {r.doc_id: tuple(r[c] for c in quality.COUNTS) for r in got} == {d: base(t) for d, t in texts.items()}


def test_unseen_rows_are_judged_as_their_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    train = quality.train(docs.select("doc_id", "text"), labels.filter("doc_id % 2 = 0"))
    rows = quality.judged(docs, train).join(labels.filter("doc_id % 2 = 1").groupBy("doc_id").agg(F.min("quality").alias("q")), "doc_id")
    rows = rows.filter("NOT base_failed").toPandas()
    assert (rows.kept == (rows.q == 1)).mean() > 0.97
    assert abs(rows.quality_score.mean() - (rows.q == 1).mean()) < 0.03


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, tmp_path, [])
    none = stored(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path)
    assert quality.judged(docs, quality.train(docs, none)).count() == 0
