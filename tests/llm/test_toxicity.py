import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import awkward, documents, stored
from locuswise.llm import toxicity
from locuswise.llm.common import table

INSULTS = ("dimwit", "rotface", "scumbag", "wretchling")
PLAIN = "the river ran slowly past old green hills while people talked about bread stone and winter weather".split()


def corpus(n=600, seed=1):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(PLAIN, 30))
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                words[int(rng.integers(30))] = str(rng.choice(INSULTS))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("toxic")
    rows, labels = corpus()
    labels = stored(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp)
    return toxicity.train(documents(spark, tmp, rows), labels)


@pytest.mark.parametrize(
    "written,meant",
    [("d1mw1t", "dimwit"), ("r0tf@ce", "rotface"), ("d.i.m.w.i.t", "dimwit"), ("dimmmmwiiit", "dimwit"), ("$cumb4g", "scumbag"), ("r*o*t*f*a*c*e", "rotface"), ("river", "river")],
)
def test_restores(trained, written, meant):
    assert toxicity.restore(written, toxicity.Letters(trained.letters)) == meant


def test_obfuscated_texts_score_high_and_clean_ones_low(spark, tmp_path, trained):
    rows = [
        (1, "the river ran past you d1mw1t"),
        (2, "what a r o t f a c e you are"),
        (3, "old green hills $cumb4g and winter"),
        (4, "people talked about bread and winter weather"),
        (5, "room 101 costs 40$ and opens at 7pm on 3.5.2024"),
        (6, "the river " * 20_000 + "dimwit"),
        (7, None),
        (8, ""),
    ]
    got = {r.doc_id: r.score for r in toxicity.scored(documents(spark, tmp_path, rows).select("doc_id", "text"), trained).collect()}
    assert all(got[i] >= toxicity.THRESHOLD for i in (1, 2, 3, 6)), got
    assert all(got[i] < toxicity.THRESHOLD for i in (4, 5, 7, 8)), got
    assert got[7] == got[8]


@pytest.mark.parametrize("clashing", [False, True])
def test_stage_keeps_awkward_rows_with_their_columns(spark, tmp_path, clashing):
    rows, labels = corpus(200)
    docs = documents(spark, tmp_path, [*awkward(), *((1000 + i, t) for i, t in rows)], clashing)
    marks = spark.createDataFrame([*((1000 + i, q, x) for i, q, x in labels), (None, 1, 1), (1001, 1, None)], "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(docs, stored(marks, tmp_path))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(str(i) for i in ids if i is None or i < 1000) == sorted(str(d) for d, _ in awkward())
    assert {i for i in ids if i is not None and i >= 1000} == {1000 + i for i, _, bad in labels if not bad}


def test_without_labels_or_rows(spark, tmp_path):
    docs = documents(spark, tmp_path, awkward())
    none = stored(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path)
    assert toxicity.drop_toxic(docs, none).count() == len(awkward())
    assert toxicity.drop_toxic(documents(spark, tmp_path, []), none).count() == 0


def test_fold_equals_crc32(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 4 for r in df.select("doc_id", toxicity.fold(F.col("doc_id")).alias("f")).collect())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity.query(spark, folder).join(labels, "doc_id").filter("held_out").toPandas()
    hit = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert hit / (rows.toxic == 1).sum() > 0.88
    assert hit / (rows.predicted == 1).sum() > 0.85
