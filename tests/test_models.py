"""Grid, rates, categories and transition tables: published example values and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuswise import catalog
from locuswise.functions import gamma
from locuswise.operators import blocks, grid, model, params
from locuswise.plans import optimise

# fixed values: fitted example parameters and the rates that belong to them
HEIGHTS = [2.1271495753058627, 0.43002079208640398, 1.2154532288649020, 0.72157843313778747, 0.80684586464830721, 0.012903728229939538]
THETA, RHO, ALPHA, STAY = 0.0010132728301963357, 0.00019529157618770567, 0.475882173643515205, 0.99997730976048649
LEFT = [0, 1.07837e-05, 2.38627e-05, 3.97256e-05, 5.89649e-05, 8.22992e-05, 0.0001106, 0.000144925, 0.000186556, 0.000237048, 0.000298287, 0.000372561, 0.000462644]
RATES = [4198.57, 4041.11, 3517.02, 2610.58, 1503.94, 848.776, 890.116, 1034.14, 1305.11, 1700.86, 2146.49, 2399.06, 2373.07, 2282.51, 2112.12, 1863.28, 1583.07, 1424.25, 1428.74, 1444.38, 1473.79, 1516.76, 1565.13, 1592.55, 921.714]
N, KNOTS = 26, 4


@pytest.fixture(scope="module")
def example(spark):
    cand = spark.createDataFrame([(0, THETA, RHO, ALPHA, STAY)], "candidate_id long, theta double, rho double, alpha double, stay double")
    knots = spark.createDataFrame([(0, i, h, 0.0) for i, h in enumerate(HEIGHTS)], "candidate_id long, i int, height double, slope double")
    return cand, knots


def test_example_demography(example):
    cand, knots = example
    cells = grid.spline_rates(knots, grid.time_grid(cand, N), N, KNOTS)
    rows = grid.scale_demography(cells, F.col("theta")).orderBy("time_index").collect()
    assert [r.left_time_boundary for r in rows[: len(LEFT)]] == pytest.approx(LEFT, rel=1e-5)
    assert [r["lambda"] for r in rows[:25]] == pytest.approx(RATES, rel=1e-5)
    assert rows[0].right_time_boundary == pytest.approx(rows[1].left_time_boundary)


def test_example_windows(spark):
    limits = spark.createDataFrame([(0, "chr9", 10555, 138318560, 10555, 138318560)], "block_id int, chrom string, start long, end long, lower_cut long, upper_cut long")
    for size, count in ((25_000, 5533), (250_000, 554), (1_000_000, 139)):
        bins = spark.range(count).select(F.lit(0).alias("block_id"), F.lit(size).cast("long").alias("bin_size"), F.col("id").alias("bin"))
        rows = blocks.window_coords(bins, limits, compat=True).orderBy("bin").collect()
        assert rows[0].chrom_start == 10555 and rows[-1].chrom_end == 138318559
        assert rows[-1].chrom_start < rows[-1].chrom_end <= rows[-1].chrom_start + size


def test_transitions_and_emissions_of_the_example(example):
    cand, knots = example
    timed = optimise.smc_grids(cand, knots, N, KNOTS)
    for r in timed.collect():
        assert r.t_lo < r.t_mean and (r.t_hi is None or r.t_mean < r.t_hi)
    matrix = np.zeros((N, N))
    for r in model.time_transitions(timed).collect():
        matrix[r.k_from, r.k_to] = r.p
    np.testing.assert_allclose(matrix.sum(axis=1), 1, atol=1e-12)
    assert (matrix > 0).all() and 0.99 < matrix.diagonal().min()
    probs = {(r.k, r.obs): r.p for r in model.emissions(timed, F.col("theta")).collect()}
    for k in range(N):
        assert probs[k, 0] + probs[k, 1] == pytest.approx(1) and probs[k, 2] == 1
    assert 0.9 < probs[N - 1, 0] < probs[0, 0] < 1


def test_full_model_rows_sum_to_one(example):
    cand, knots = example
    cats = model.rate_categories(cand, "Gamma", 4)
    packed = optimise.smc_models(cand, knots, N, KNOTS, cats, F.col("stay"), 4).first()
    trans = np.array(packed.trans).reshape(104, 104)
    np.testing.assert_allclose(trans.sum(axis=1), 1, atol=1e-12)
    assert (trans > 0).all() and len(packed.emis) == 104 * 3


def test_large_hazard_does_not_overflow(spark):
    cand = spark.createDataFrame([(0, 1e-3, 5e-4)], "candidate_id long, theta double, rho double")
    cells = grid.mean_times(grid.time_grid(cand, 10).withColumn("lambda", F.lit(500.0)))
    rows = model.time_transitions(cells).collect()
    assert all(0 <= r.p <= 1 and math.isfinite(r.p) for r in rows)


def test_grid_methods(spark):
    cand = spark.createDataFrame([(0,)], "candidate_id long")
    quantiles = [r.t_lo for r in grid.time_grid(cand, 4, "quantiles").orderBy("k").collect()]
    assert quantiles == pytest.approx([-math.log(1 - i / 4) for i in range(4)])
    fine = [r.t_lo for r in grid.time_grid(cand, 4, "msmc2", tmax=15.0, pairs=2).orderBy("k").collect()]
    assert fine == pytest.approx([0.05 * (301 ** (i / 4) - 1) for i in range(4)])
    with pytest.raises(ValueError):
        grid.time_grid(cand, 4, "other")


def test_gamma_categories():
    x = np.linspace(0.01, 20, 50)
    np.testing.assert_allclose(gamma.lower_regularised(np.ones(50), x), 1 - np.exp(-x), atol=1e-14)
    np.testing.assert_allclose(gamma.lower_regularised(np.full(50, 2.0), x), 1 - np.exp(-x) * (1 + x), atol=1e-13)
    means, probs = gamma.gamma_category_means(np.array([0.05, 0.5, 1.0, 30.0]), 5)
    np.testing.assert_allclose((means * probs).sum(axis=1), 1, atol=1e-9)
    assert (np.diff(means, axis=1) > 0).all()
    # exponential case: class means follow from -ln(1 - p)
    edges = np.append(-np.log(1 - np.arange(5) / 5), np.inf)
    upper = np.append(np.exp(-edges[:-1]) * (edges[:-1] + 1), 0)
    np.testing.assert_allclose(means[2], 5 * (upper[:-1] - upper[1:]), atol=1e-10)


def test_log_gamma_and_quantiles():
    shapes = np.geomspace(1e-3, 1e5, 500)
    want = np.array([math.lgamma(v) for v in shapes])
    np.testing.assert_allclose(gamma.log_gamma(shapes), want, rtol=1e-13, atol=1e-13)
    a, p = np.geomspace(0.05, 200, 40)[:, None], np.array([1e-9, 0.01, 0.25, 0.5, 0.75, 0.99, 1 - 1e-9])[None]
    np.testing.assert_allclose(gamma.lower_regularised(a, gamma.quantile(a, p)), np.broadcast_to(p, (40, 7)), rtol=1e-11)
    np.testing.assert_allclose(gamma.quantile(np.ones(3), np.array([0.1, 0.5, 0.9])), -np.log1p([-0.1, -0.5, -0.9]), rtol=1e-14)
    # too small for a number: the smallest that is kept
    assert gamma.quantile(np.array([0.001]), np.array([0.25])) == pytest.approx(np.exp(gamma.LOWEST))


def test_category_models(spark):
    cand = spark.createDataFrame([(7, 0.5, 40.0, 0.1, 0.2, 0.3)], "candidate_id long, alpha double, heat double, leave_hot double, leave_background double, share_hot double")
    assert [(r.cat, r.scale) for r in model.rate_categories(cand, "Hotspot").orderBy("cat").collect()] == [(0, 1.0), (1, 40.0)]
    mixed = model.rate_categories(cand, "Gamma+Hotspot", 3).orderBy("cat").collect()
    assert len(mixed) == 4 and mixed[0].scale == 40.0 and mixed[0].prob is None
    bounded = model.rate_categories(cand, "Gamma", bounds=[0, 0.1, 1, 10]).collect()
    assert all(lo <= r.scale <= hi for r, lo, hi in zip(bounded, [0, 0.1, 1], [0.1, 1, 10]))
    even = model.rate_categories(cand, "Gamma", 4, maximum=8.0).collect()
    assert all(2 * r.cat <= r.scale <= 2 * r.cat + 2 for r in even)
    for kind, n in (("Gamma", 4), ("Hotspot", 2), ("Gamma+Hotspot", 4), ("Gamma", 1)):
        sums = model.category_transitions(cand, kind, n).groupBy("cat_from").agg(F.sum("p").alias("s")).collect()
        assert [r.s for r in sums] == pytest.approx([1.0] * n)


def test_symbol_emissions_with_missing(spark):
    cand = spark.createDataFrame([(0, 1e-2, 5e-3)], "candidate_id long, theta double, rho double")
    cells = grid.mean_times(grid.time_grid(cand, 3).withColumn("lambda", F.lit(1.0)))
    cats = spark.createDataFrame([(0, 0, 0.5), (0, 1, 2.0)], "candidate_id long, cat int, scale double")
    rows = model.symbol_emissions(cells, cats, "rho", 3, missing=True).collect()
    table = {(r.cat, r.symbol): r.p for r in rows}
    assert len(rows) == len(table) == 2 * 16
    for cat in (0, 1):
        for j in range(3):
            assert sum(table[cat, j * 4 + k] for k in range(3)) == pytest.approx(1)
            assert table[cat, j * 4 + 3] == table[cat, 12 + j] == 1.0


def test_selection_and_guard(spark):
    rows = [(0, n, v) for n, v in [("theta", 0.5), ("rho", 0.001), ("y0", 1.0), ("y0_prime", 0.0), ("l3", 2.0), ("r_ii", 0.999)]]
    table = spark.createDataFrame(rows, "candidate_id long, name string, value double")
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(params.select_parameters(table)) == ["r_ii", "rho", "theta", "y0", "y0_prime"]
    assert names(params.select_parameters(table, heights=False, slopes=False, ignore=["rho"])) == ["r_ii", "theta"]
    bounds = spark.createDataFrame([("theta", 0.0, 1.0), ("rho", 0.0, 1.0), ("r_ii", 0.0, 1.0)], "name string, lower double, upper double")
    guarded = {r.name: (r.kept, r.reason) for r in params.boundary_guard(table, bounds, 1e-3).collect()}
    assert guarded["theta"] == (True, None)
    assert guarded["rho"] == (False, "too close to lower") and guarded["r_ii"] == (False, "too close to upper")


def test_best_model_ties_take_fewest_knots(spark):
    fits = spark.createDataFrame([(4, 7, -100.0), (3, 6, -101.0), (5, 8, -99.5)], "knots int, free int, loglik double")
    best = params.best_model(fits).first()
    assert (best.knots, best.aic) == (3, 214.0)


def test_convergence_by_parameter_needs_all(spark):
    log = [(1, s, n, v) for s, n, v in [(1, "a", 1.0), (2, "a", 1.001), (3, "a", 9.0), (1, "b", 0.0), (2, "b", 1.0), (3, "b", 1.0)]]
    log += [(2, 1, "a", 1.0), (2, 2, "a", 5.0)]
    table = spark.createDataFrame(log, "run long, step long, name string, value double")
    got = {r.run: r.converged_at for r in params.convergence_by_parameter(table, 0.01).collect()}
    assert got == {1: 3, 2: None}


def test_matrix_distance(spark):
    cells = [(m, i, j, 0.1 * (m + 1) + 0.2 * i + 0.05 * j) for m in range(3) for i in range(2) for j in range(2)]
    mats = spark.createDataFrame(cells, "matrix_id int, i int, j int, p double")
    target = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.0), (1, 0, 0.2), (1, 1, 0.3)], "i int, j int, p double")
    goal = {(0, 0): 0.5, (1, 0): 0.2, (1, 1): 0.3}
    each = [sum((math.log(p) - math.log(goal[i, j])) ** 2 for m2, i, j, p in cells if m2 == m and (i, j) in goal) for m in range(3)]
    for how, want in (("sum", sum(each)), ("mean", sum(each) / 3), ("median", sorted(each)[1]), ("max", max(each)), ("min", min(each))):
        assert params.matrix_distance(mats, target, how).first().dist == pytest.approx(want)


def test_moves_of_many_parameters_have_names_of_their_own(spark):
    from locuswise.plans.optimise import perturbed

    best = spark.createDataFrame([(f"p{i:04d}", 1.0) for i in range(1200)], "name string, value double")
    moves = perturbed(best, 1e-4).select("candidate_id", "i", "di").distinct()
    assert moves.select("candidate_id").distinct().count() == moves.count() == 2401


def test_bins_of_sizes_without_a_common_step(spark):
    from locuswise.operators import bins

    table = spark.createDataFrame([(0, "chr1", 1, 100, 1, 100)], "block_id int, chrom string, start long, end long, lower_cut long, upper_cut long")
    states = spark.createDataFrame([(1, 0, 1, 40, 0), (1, 0, 41, 55, 2), (1, 0, 56, 100, 1)], "diploid long, block_id int, start_pos long, end_pos long, state int")
    together = bins.bin_states(states, table, [17, 31])
    apart = bins.bin_states(states, table, [17]).unionByName(bins.bin_states(states, table, [31]))
    assert sorted(map(str, together.collect())) == sorted(map(str, apart.collect())) and together.count() > 0


def test_tables_of_many_candidates_do_not_pass_the_driver(spark, small):
    """Before cells are exploded a table of candidates looks small enough to broadcast, however many rows it will have."""
    for name in ("state_transitions", "spline_rates", "scale_rates_by_ne", "symbol_emissions"):
        plan = catalog.queries()[name](spark, small)._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan, name
