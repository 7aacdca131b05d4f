import duckdb
import pytest
from pyspark.sql import functions as F

from helpers import awkward, documents
from locuswise.llm import mixing


def _targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, hold what is above its bound, share the rest again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        rest = total - sum(held.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return {**held, **share}
        held |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 1000, "b": 1, "c": 1, None: 5},
        {"a": 10, "b": 0, "c": 500, "ä": 3, "z": 1, "Z": 40, None: 0},
        {"only": 7},
        {"a": 0, "b": 0},
    ],
)
def test_targets_equal_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = _targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-12)


def test_taken_words_come_near_targets_and_reruns_agree(spark, tmp_path):
    rows = [(i, "w " * (1 + i % 30), ("hot", "b", "c", None)[0 if i % 3 else 1 + i % 4 % 3]) for i in range(6000)]
    docs = documents(spark, tmp_path, rows)
    mixed = mixing.mixture(docs)
    first, second = ({tuple(r) for r in mixing.mixture(docs).collect()} for _ in range(2))
    assert first == second
    for r in mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("n_copies")).alias("t"), F.first("target").alias("want")).collect():
        assert r.t == pytest.approx(r.want, rel=0.08)
    assert mixed.agg(F.max("n_copies")).first()[0] <= 3


@pytest.mark.parametrize("clashing", [False, True])
def test_mix_emits_copies_with_all_columns(spark, tmp_path, clashing):
    docs = documents(spark, tmp_path, [(*r, ("a", "b", None)[i % 3]) for i, r in enumerate(awkward())], clashing)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    times = mixing.mixture(docs).agg(F.sum("n_copies")).first()[0]
    assert out.count() == times


def test_empty_table(spark, tmp_path):
    docs = documents(spark, tmp_path, [])
    assert mixing.mixture(docs).count() == 0 and mixing.mix(docs).count() == 0


def test_query_equals_its_sql(spark, small):
    got = {tuple(r) for r in mixing.query(spark, small).collect()}
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert got == set(duckdb.sql(mixing.SQL).fetchall())
