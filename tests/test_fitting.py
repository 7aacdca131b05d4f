"""Searches for spline models: steps on a known surface, fits of sequences, intervals around them."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_hmm import forward

from locuswise.catalog import hmm
from locuswise.functions.lineage import settled
from locuswise.operators.scoring import Scorer
from locuswise.plans import fitting, optimise

N = 6
TARGET = [0.02, 1.4, 0.7, 1.2, 0.1, -0.05, 0.2]


@pytest.fixture(scope="module")
def starts(spark):
    return spark.createDataFrame([(0, 0.02, 0.01), (1, 0.02, 0.04)], "start long, theta double, rho double")


@pytest.fixture(scope="module")
def sequences(spark):
    """Sites of two diploids in which stretches of many and of few differences change."""
    r = np.random.default_rng(3)
    out = {}
    for d in (1, 2):
        rates = np.repeat(r.choice([0.01, 0.25], size=12), 25)
        out[d] = (r.random(300) < rates).astype(int)
    return out


@pytest.fixture(scope="module")
def scorer(spark, sequences):
    rows = [(d, 0, i + 1, i + 1, int(o)) for d, obs in sequences.items() for i, o in enumerate(obs)]
    runs = spark.createDataFrame(rows, "diploid long, block_id int, start_pos long, end_pos long, state int")
    blocks = spark.createDataFrame([(0, 1, 300)], "block_id int, start long, end long")
    return Scorer.over(runs, blocks, 100)


def test_steps_reach_the_top_of_a_surface(starts):
    state = settled(fitting.start_state(starts, 1, 1), "surface")
    off = F.zip_with("point", F.array(*[F.lit(t) for t in TARGET]), lambda a, b: (a - b) * (a - b))
    seen = []
    for _ in range(12):
        points = settled(fitting.moves(state), "surface-points")
        scores = points.select("candidate_id", (-F.aggregate(off, F.lit(0.0), lambda a, x: a + x)).alias("loglik"))
        state = settled(fitting.step(state, points, scores), "surface")
        seen.append({r.start: r.loglik for r in state.collect()})
    for row in state.collect():
        assert [p.value for p in row.params] == pytest.approx(TARGET, abs=1e-6)
        assert max(p.width for p in row.params) < 0.25
    for before, after in zip(seen, seen[1:]):
        assert all(after[start] >= before[start] for start in before)


def test_a_search_goes_on_until_every_fit_has_ended(starts, monkeypatch):
    """The top lies tens of widths away, on a ridge: four rounds don't reach it."""
    far = [0.5, 30.0, 0.7, 12.0, 0.1, -0.05, 0.2]

    def surface(points):
        off = F.zip_with("point", F.array(*[F.lit(t) for t in far]), lambda a, b: (a - b) * (a - b))
        ridge = F.pow(F.col("point")[1] - 30.0 + F.col("point")[3] - 12.0, 2)
        return points.select("candidate_id", (-F.aggregate(off, F.lit(0.0), lambda a, x: a + x) - 4 * ridge).alias("loglik"))

    monkeypatch.setattr(fitting, "point_models", lambda points, *_: points)
    first = settled(fitting.start_state(starts, 1, 1), "ridge")
    four = fitting.search(surface, first, 1, 1, N, rounds=4)
    assert four.filter(fitting.going(1e-3)).count() == 2 and all(r.loglik < -1 for r in four.collect())
    found = fitting.search(surface, four, 1, 1, N).collect()
    assert sorted(r.start for r in found) == [0, 1]
    for row in found:
        assert [p.value for p in row.params] == pytest.approx(far, abs=0.05)
        assert row.loglik > -0.01


def test_a_fit_that_has_ended_is_left_as_it_is(starts, monkeypatch):
    monkeypatch.setattr(fitting, "point_models", lambda points, *_: points)
    small = F.transform("params", lambda p: p.withField("width", F.when(F.col("start") == 0, 1e-9).otherwise(p["width"])))
    state = settled(fitting.start_state(starts, 1, 1).withColumns({"params": small, "loglik": F.lit(-7.0)}), "ended")
    seen = []

    def flat(points):
        seen.extend(r.start for r in points.select("start").distinct().collect())
        return points.select("candidate_id", F.when(F.col("move") == 1, float("nan")).otherwise(-3.0).alias("loglik"))

    got = {r.start: r for r in fitting.search(flat, state, 1, 1, N, rounds=1).collect()}
    assert seen == [1] and got[0].loglik == -7.0
    # where no step gains, the centre stays and widths are halved; a model without a log-likelihood doesn't win
    assert got[1].loglik == -3.0
    assert [(p.name, p.value, p.width) for p in got[1].params][:2] == [("rho", 0.04, 0.01), ("y0", 1.01, 0.125)]


def test_the_registered_search_has_no_number_of_rounds(starts, monkeypatch):
    seen, search = [], fitting.search
    monkeypatch.setattr(hmm, "inputs", lambda *_: (None, None))
    monkeypatch.setattr(hmm, "smc_candidates", lambda *_: starts.withColumnRenamed("start", "candidate_id"))
    monkeypatch.setattr(hmm.scoring.Scorer, "over", staticmethod(lambda *_: None))
    monkeypatch.setattr(hmm.fitting, "search", lambda *args, **limits: seen.append((len(args), limits)))
    hmm.spline_state(None, None)
    assert seen == [(5, {})]
    assert inspect.signature(search).parameters["rounds"].default is None


def test_models_of_all_knot_counts_in_one_pass(spark):
    rows = [(k, k, 0.02, [0.01 * k, *(1.0 + 0.1 * i for i in range(k + 2)), *(0.05 * i for i in range(k + 2))]) for k in (1, 2)]
    points = spark.createDataFrame(rows, "candidate_id long, knots int, theta double, point array<double>")
    got = {r.candidate_id: (r.trans, r.emis) for r in fitting.point_models(points, 1, 2, N).collect()}
    for k, _, theta, point in rows:
        knots = [(k, i, point[1 + i], point[k + 3 + i]) for i in range(k + 2)]
        own = optimise.smc_models(
            spark.createDataFrame([(k, theta, point[0])], "candidate_id long, theta double, rho double"),
            spark.createDataFrame(knots, "candidate_id long, i int, height double, slope double"),
            N,
            k,
        ).first()
        assert got[k] == (own.trans, own.emis)
    with pytest.raises(ValueError, match="do not fit"):
        fitting.point_models(points, 1, 4, N)


def test_moves_stay_inside_the_ranges(starts):
    state = fitting.start_state(starts, 1, 2)
    # a slope at the edge of its range cannot move further, and a centre is always there
    tight = F.transform("params", lambda p: p.withField("width", F.when(p["name"] == "y0_prime", 5.0).otherwise(p["width"])))
    found = fitting.moves(state.withColumn("params", tight)).groupBy("knots", "start").agg(F.collect_set("move").alias("m"))
    for row in found.collect():
        at = 1 + row.knots + 2
        size = 1 + 2 * (row.knots + 2)
        assert set(row.m) == set(range(2 * size + 1)) - {2 * at + 1, 2 * at + 2}
    ids = fitting.moves(state).select("candidate_id")
    assert ids.distinct().count() == ids.count()


def test_starting_heights(starts):
    row = fitting.start_state(starts, 2, 2).filter("start = 0").first()
    got = {p.name: p.value for p in row.params}
    assert got == {"rho": 0.01, "y0": 1.01, "y1": 0.99, "y2": 1.01, "y3": 1.0, **{f"y{i}_prime": 0.0 for i in range(4)}}


def test_fit_improves_and_can_be_resumed(spark, scorer, starts, sequences):
    first = settled(fitting.start_state(starts, 1, 2), "first")
    one = fitting.search(scorer, first, 1, 2, N, rounds=1)
    three = fitting.search(scorer, first, 1, 2, N, rounds=3)
    resumed = fitting.search(scorer, one, 1, 2, N, rounds=2)
    key = ["knots", "start"]
    assert [tuple(r) for r in three.orderBy(key).collect()] == [tuple(r) for r in resumed.orderBy(key).collect()]
    before = {(r.knots, r.start): r.loglik for r in one.collect()}
    assert len(before) == 4
    for r in three.collect():
        assert r.loglik > before[r.knots, r.start]
    best = fitting.best_fits(three).orderBy("knots").collect()
    assert [(r.knots, r.free) for r in best] == [(1, 7), (2, 9)]
    for r in best:
        assert r.aic == pytest.approx(2 * r.free - 2 * r.loglik)
        # the value is that of the model with these parameters
        point = spark.createDataFrame(
            [(5, r.knots, r.theta, [p.value for p in r.params])], "candidate_id long, knots int, theta double, point array<double>"
        )
        model = fitting.point_models(point, r.knots, r.knots, N).first()
        trans, emis = np.array(model.trans).reshape(N, N), np.array(model.emis).reshape(N, -1)
        assert r.loglik == pytest.approx(sum(forward(obs, trans, emis)[0] for obs in sequences.values()), abs=1e-8)


def test_intervals_of_a_fit(scorer, starts):
    state = fitting.search(scorer, fitting.start_state(starts.filter("start = 0"), 1, 1), 1, 1, N, rounds=2)
    # a height on its bound and a slope next to one are left out
    moved = F.transform(
        "params",
        lambda p: p.withField(
            "value", F.when(p["name"] == "y0", p["lower"]).when(p["name"] == "y1_prime", 0.99999).otherwise(p["value"])
        ),
    )
    fit = settled(fitting.best_fits(state.withColumn("params", moved)), "fit")
    limits = {p.name: p for p in fit.first().params}
    found = {r.name: r for r in fitting.curvature_at(scorer, fit, N).collect()}
    assert set(found) == {"rho", "y1", "y2", "y0_prime", "y2_prime"}
    assert any(r.lower is not None for r in found.values())
    for name, r in found.items():
        assert r.value == limits[name].value
        if r.lower is not None:
            assert limits[name].lower <= r.lower < r.value < r.upper <= limits[name].upper
    cov = {(r.name_i, r.name_j): r.value for r in fitting.curvature_at(scorer, fit, N, cov=True).collect()}
    assert len(cov) == 25 and all(cov[a, b] == pytest.approx(cov[b, a], rel=1e-6) for a, b in cov)


def test_interval_above_rounding():
    assert fitting.steady_interval(-1.0) == pytest.approx(2.0**-13)
    assert fitting.steady_interval(0.0) == 1e-4
    assert fitting.steady_interval(-1e8) > 0.01
