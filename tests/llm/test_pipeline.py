import sys

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from helpers import awkward, documents
from locuswise.llm import exact_dedup, mixing, packing, toxicity
from locuswise.llm.common import table
from test_near_dedup import expected


def test_stages_are_named_and_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]


def test_stages_against_brute_force(spark, small, tmp_path):
    docs = table(spark, small, "documents")
    columns = docs.columns
    predicted = {r.doc_id for r in toxicity.query(spark, small).filter("predicted = 1").collect()}
    steps, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, small)
        if name != "pack_sequences":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        steps[name] = at = spark.read.parquet(f"{tmp_path}/{name}")
    rows = {n: d.collect() for n, d in steps.items() if n != "pack_sequences"}
    ids = {n: sorted(r.doc_id for r in found) for n, found in rows.items()}
    assert ids["toxicity"] == sorted(r.doc_id for r in docs.collect() if r.doc_id not in predicted)
    best = {}
    for r in rows["toxicity"]:
        bare = "".join(c for c in r.text or "" if c not in " \t\n\x0b\f\r")
        best[bare] = min(best.get(bare, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert ids["exact_dedup"] == sorted(d for _, d in best.values())
    near = expected([(r.doc_id, r.text) for r in rows["exact_dedup"]])
    assert ids["near_dedup"] == sorted(d for d, _, c in near if d == c)
    times = {r.doc_id: r.n_copies for r in mixing.mixture(steps["near_dedup"]).collect()}
    assert ids["mix_sources"] == sorted(d for d, n in times.items() for _ in range(n))
    packed = steps["pack_sequences"].groupBy("doc_id").agg(F.sum((F.col("piece") == 0).cast("int")).alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {d: n for d, n in times.items() if n}


def test_run_equals_its_stages(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.agg(F.sum("length")).first()[0] > 0


@pytest.mark.parametrize("rows", [[], awkward(2000)])
def test_stages_take_awkward_and_empty_tables(spark, small, tmp_path, rows):
    at = documents(spark, tmp_path, rows, clashing=True)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, small).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    assert (at.count() > 0) == bool(rows)
