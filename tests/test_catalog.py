"""Every query with SQL gives the SQL's rows; the others give some rows."""

import pytest
from compare import compare, connect

from locuswise import catalog
from locuswise.catalog import files, hmm
from locuswise.catalog.maps import SIZES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, small, name):
    ok, note, _ = compare(spark, con, name, small)
    assert ok is not False, note


def test_a_haplotype_without_a_partner_is_left_out_as_in_sql(spark, small, tmp_path):
    table = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 8 AND doc_id <> 5")
    table.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["pair_haplotypes"](spark, str(tmp_path))
    assert {r.diploid for r in got.select("diploid").distinct().collect()} == {0, 1, 3}


def test_the_list_of_samples_is_not_sorted_with_the_records(spark, small, monkeypatch):
    """It is as long as there are samples, so it may meet a site or a block but never go through a sort of the records."""
    plans = []
    monkeypatch.setattr(files.variants, "read_variants", lambda *_: None)
    writer = type(spark.range(1).write)
    monkeypatch.setattr(writer, "text", lambda self, path, **_: plans.append(self._df._jdf.queryExecution().sparkPlan().toString()))
    catalog.queries()["read_variants"](spark, small)
    (plan,) = plans
    assert "first(" not in plan and "try_element_at" not in plan


def test_maps_of_every_resolution_are_read_back(spark, small):
    found = catalog.queries()["bedgraph_sizes"](spark, small).select("window_size").distinct().collect()
    assert {r.window_size for r in found} == {f"{n}b" for n in SIZES}


def test_oracles_belong_to_queries():
    assert set(catalog.oracles()) <= set(catalog.queries())


def test_whole_dataset_is_what_its_sql_gives(spark, con, small):
    """Every row, to the last of the nine digits."""
    place = lambda r: (r[0], -1 if r[1] is None else r[1], r[2], r[3], r[4])
    names = ["source", "diploid", "block_id", "pos", "metric", "value"]
    got = sorted((tuple(r) for r in catalog.queries()["decode_dataset"](spark, small).select(names).collect()), key=place)
    want = sorted(con.execute(hmm.WHOLE_DATASET).fetchall(), key=place)
    assert [place(r) for r in got] == [place(r) for r in want]
    assert max(abs(g[5] - w[5]) for g, w in zip(got, want)) < 0.6e-9


def test_curvature_matrix_is_what_its_sql_gives(spark, con, small):
    """Every cell but for what rounding does to differences of log-likelihoods."""
    got = {(r.name_i, r.name_j): r.value for r in catalog.queries()["curvature_cov"](spark, small).collect()}
    want = {(i, j): value for i, j, value in con.execute(hmm.CURVATURE_COV).fetchall()}
    assert got == pytest.approx(want, rel=1e-3) and len(got) == 16


@pytest.mark.parametrize("name", ["emission_symbol_runs", "mask_decoded_runs", "emission_symbols", "mask_decoded"])
def test_runs_are_made_once_for_decoding_and_for_what_lies_over_it(spark, small, monkeypatch, name):
    made, plain = [], hmm.b.state_runs
    monkeypatch.setattr(hmm.b, "state_runs", lambda *args: made.append(1) or plain(*args))
    found = catalog.queries()[name](spark, small)
    assert len(made) == 1 and "events.parquet" not in " ".join(found.inputFiles())
