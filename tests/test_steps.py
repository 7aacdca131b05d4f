"""Steps that must not be done over and over: by their plans, and by rows on small tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from locuswise import bindings, catalog
from locuswise.catalog import hmm
from locuswise.functions.kernels import RunPowers
from locuswise.functions.lineage import settled
from locuswise.llm import near_dedup
from locuswise.operators import bins, scoring
from locuswise.operators.overlay import value_runs
from locuswise.streaming.filtering import stream_filter
from locuswise.streaming.sinks import run_available


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_posteriors_are_made_once_a_row(spark, small):
    for name in ("time_marginal", "rate_marginal"):
        assert plan(catalog.queries()[name](spark, small)).count("transform(") == 2, name


def test_time_bins_of_one_table_are_sums(spark, small):
    assert "Window" not in plan(catalog.queries()["bins_in_time"](spark, small))
    rows = [(1, 0, p, None if p % 11 == 0 else p % 5, p % 3, None if p % 7 == 0 else p / 8) for p in range(1, 91) if p % 13]
    sites = spark.createDataFrame(rows, "diploid long, block_id int, pos long, k int, state int, value double")
    blocks = spark.createDataFrame([(0, 1, 90, 5, 85)], "block_id int, start long, end long, lower_cut long, upper_cut long")
    want = bins.bins_in_time(*[value_runs(sites, c) for c in ("k", "state", "value")], blocks, (10, 30), 1, 3)
    got = bins.laid_bins_in_time(sites, blocks, (10, 30), 1, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_state_runs_are_made_once(spark, small, monkeypatch):
    """Whoever reads the runs twice writes them first, and a state is grouped by hash."""
    made = []
    plain = bindings.state_runs
    monkeypatch.setattr(bindings, "state_runs", lambda *a: made.append(settled(plain(*a))) or made[-1])
    stored = []
    monkeypatch.setattr(hmm, "settled", lambda df, name="table": stored.append(name) or settled(df, name))
    hmm.region_logliks(spark, small)
    assert len(made) == 1 and stored[0] == "state-runs"
    physical = bindings.calls(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in physical and "SortAggregate" not in physical


def test_transfers_of_a_batch_are_those_of_each_fragment():
    """Rows of several kinds, lengths and model batches in one Arrow batch, against one fragment at a time."""
    rng = np.random.default_rng(4)
    models = {n: (rng.dirichlet(np.ones(3), (n + 1, 3)), rng.uniform(0.1, 1, (n + 1, 3, 3))) for n in (0, 1)}
    rows = [(i, i % 3 + 1, int(i > 4), rng.integers(1, 40, 1 + i % 5), rng.integers(0, 3, 1 + i % 5)) for i in range(9)]
    columns = {
        "diploid": pa.array([r[0] for r in rows], pa.int64()),
        "block_id": pa.array([0] * len(rows), pa.int32()),
        "batch": pa.array([r[2] for r in rows], pa.int32()),
        "idx": pa.array([r[1] for r in rows], pa.int32()),
        "lengths": pa.array([r[3].tolist() for r in rows], pa.list_(pa.int32())),
        "symbols": pa.array([r[4].tolist() for r in rows], pa.list_(pa.int8())),
        "models": pa.array([r[2] + 1 for r in rows], pa.int32()),
        "trans": pa.array([models[r[2]][0].ravel().tolist() for r in rows]),
        "emis": pa.array([models[r[2]][1].ravel().tolist() for r in rows]),
    }
    for lead in (False, True):
        (got,) = scoring._transfers(lead)([pa.record_batch(columns)])
        assert got["diploid"].to_pylist() == list(range(len(rows)))
        for r, m, log in zip(rows, got["mats"].to_pylist(), got["logs"].to_pylist()):
            start = np.full(3, 1 / 3) if r[1] == 1 else None
            left, scale = RunPowers(*models[r[2]]).fragment(r[3], r[4], start, lead)
            assert np.allclose(np.array(m).reshape(left.shape) * np.exp(log)[:, None, None], left * np.exp(scale)[:, None, None])


def test_stream_filter_is_the_plain_forward_pass(spark, tmp_path):
    """Gaps, repeats and several sequences in one batch, against one site after the other."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for d in range(5):
        vector = None
        for pos in sorted(rng.choice(np.arange(1, 400), 30, replace=False).tolist()):
            symbol = int(rng.integers(0, 3))
            rows += [(d, 0, pos, symbol, 2 * pos), (d, 0, pos, (symbol + 1) % 3, 2 * pos + 1)]
            if vector is None:
                vector, loglik = hmm.EMIS[:, symbol] / 2, 0.0
            else:
                for _ in range(pos - last - 1):
                    vector = vector @ hmm.TRANS
                vector = (vector @ hmm.TRANS) * hmm.EMIS[:, symbol]
            loglik, vector, last = loglik + np.log(vector.sum()), vector / vector.sum(), pos
            want[d, pos] = (*vector, loglik)
    rng.shuffle(rows)
    schema = "diploid long, block_id int, pos long, state int, seq long"
    spark.createDataFrame([tuple(map(int, r)) for r in rows], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    sites = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = run_available(stream_filter(sites, hmm.TWO_STATES)).collect()
    assert {(r.diploid, r.pos) for r in found} == want.keys() and len(found) == len(want)
    for r in found:
        assert np.allclose([*r.dist, r.loglik], want[r.diploid, r.pos])


def test_symbols_of_haplotypes_have_no_work_of_their_own(spark, small):
    """Upper case and the number of a record are made before its symbols become rows."""
    above = plan(catalog.queries()["read_haplotypes"](spark, small)).split("Generate explode")[0].split("Generate posexplode")[0]
    assert "upper(" not in above and "cast(name" not in above


def test_blocks_of_near_copies_move_texts():
    """A block takes texts, a slice of a longer column here, and finds the links that their sets have."""
    base = " ".join(f"w{i}" for i in range(60))
    texts = ["unread", base, base + " more", "quite other words stand in here", base.upper()]
    members = pa.array([[{"node": i, "component": i, "text": t} for i, t in enumerate(texts)]] * 2)
    members = pa.ListArray.from_arrays(pa.array([1, 5], pa.int32()), members.values)
    (found,) = near_dedup._block_links([pa.record_batch({"members": members})])
    links = list(zip(found["a"].to_pylist(), found["b"].to_pylist()))
    assert len(links) == 2 and {n for pair in links for n in pair} == {1, 2, 4}
