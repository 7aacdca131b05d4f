"""Models with several modulated rates: against matrices put together state by state, and decoded end to end."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuswise.operators import decoding, grid, model, modulated, scoring
from locuswise.plans import decode, optimise

N = 4
VALUES = {
    "theta": 0.004, "rho": 0.002, "theta_heat": 30.0, "theta_to_hot": 0.01, "theta_to_background": 0.05,
    "rho_alpha": 1.0, "rho_heat": 12.0, "rho_leave_hot": 0.06, "rho_leave_background": 0.02, "rho_share_hot": 0.25,
    "ne_alpha": 1.0, "ne_stay": 0.99,
}
LOW, HIGH = 1 - math.log(2), 1 + math.log(2)  # mean classes of a gamma of shape one
SCALES = {"theta": [1.0, 30.0], "rho": [12.0, LOW, HIGH], "ne": [LOW, HIGH]}
MOVES = {
    "theta": [[0.99, 0.01], [0.05, 0.95]],
    "rho": [[0.94, 0.03, 0.03], [0.005, 0.98, 0.015], [0.005, 0.015, 0.98]],
    "ne": [[0.99, 0.01], [0.01, 0.99]],
}
LAMBDA = [1.0, 1.4, 0.7, 1.1]


@pytest.fixture(scope="module")
def parts(spark):
    names = ", ".join(f"{n} double" for n in VALUES)
    cand = spark.createDataFrame([(7, *VALUES.values())], f"candidate_id long, {names}")
    base = grid.time_grid(cand.select("candidate_id", "theta", "rho"), N)
    rate = F.element_at(F.array(*[F.lit(x) for x in LAMBDA]), F.col("k") + 1)
    timed = grid.mean_times(base.withColumn("lambda", rate))
    return (
        timed,
        modulated.modulation(cand, "theta", "Hotspot"),
        modulated.modulation(cand, "rho", "Gamma+Hotspot", 2),
        modulated.modulation(cand, "ne", "Gamma", 2),
    )


def time_matrix(lo, hi, lam, rho):
    """Moves between time cells as double integrals over old and new times, by sums over earlier cells."""
    n = len(lo)
    mean = [lo[k] + 1 / lam[k] if hi[k] is None else
            lo[k] + 1 / lam[k] - (hi[k] - lo[k]) / math.expm1(lam[k] * (hi[k] - lo[k])) for k in range(n)]

    def hazard(x, y):
        total = 0.0
        for k in range(n):
            a, b = max(x, lo[k]), min(y, math.inf if hi[k] is None else hi[k])
            total += lam[k] * (b - a) if b > a else 0.0
        return total

    out = np.zeros((n, n))
    for i, j in itertools.product(range(n), repeat=2):
        t = mean[i]
        hit = (1 - math.exp(-2 * rho * t)) / (2 * t)
        if j > i:
            # the old branch is cut before t and the new time lies in cell j
            parts = 0.0
            for k in range(i + 1):
                top = t if k == i else hi[k]
                parts += math.exp(-2 * hazard(top, t)) * (1 - math.exp(-2 * lam[k] * (top - lo[k]))) / lam[k]
            leaves = 1.0 if hi[j] is None else 1 - math.exp(-hazard(lo[j], hi[j]))
            out[i, j] = hit * parts * math.exp(-hazard(t, lo[j])) * leaves
        elif j < i:
            width = hi[j] - lo[j]
            own = (1 - math.exp(-2 * lam[j] * width)) / lam[j]
            before = sum(
                (1 - math.exp(-2 * lam[k] * (hi[k] - lo[k]))) / lam[k] * math.exp(-2 * hazard(hi[k], lo[j])) for k in range(j)
            )
            out[i, j] = hit * lam[j] * (before * own / 2 + (width - own / 2) / lam[j])
    np.fill_diagonal(out, 1 - out.sum(axis=1))
    return out


def edges(timed):
    rows = timed.orderBy("k").collect()
    return [r.t_lo for r in rows], [r.t_hi for r in rows], [r.t_mean for r in rows]


def test_matrices_put_together_state_by_state(parts):
    timed = parts[0]
    lo, hi, mean = edges(timed)
    states = list(itertools.product(range(N), range(2), range(3), range(2)))
    times = {
        (r, m): time_matrix(lo, hi, [x / SCALES["ne"][m] for x in LAMBDA], VALUES["rho"] * SCALES["rho"][r])
        for r in range(3)
        for m in range(2)
    }
    want = np.array([
        [times[r, m][k, k2] * MOVES["theta"][t][t2] * MOVES["rho"][r][r2] * MOVES["ne"][m][m2] for k2, t2, r2, m2 in states]
        for k, t, r, m in states
    ])
    upper = [2 * mean[k] if hi[k] is None else hi[k] for k in range(N)]
    zero = []
    for k, t, _, _ in states:
        theta = VALUES["theta"] * SCALES["theta"][t]
        zero.append((math.exp(-theta * lo[k]) - math.exp(-theta * upper[k])) / (theta * (upper[k] - lo[k])))
    got = modulated.modulated_models(*parts).first()
    trans, emis = np.array(got.trans).reshape(len(states), -1), np.array(got.emis).reshape(len(states), 3)
    assert got.candidate_id == 7
    np.testing.assert_allclose(trans, want, rtol=1e-9, atol=1e-14)
    np.testing.assert_allclose(trans.sum(axis=1), 1, atol=1e-12)
    np.testing.assert_allclose(emis, np.column_stack([zero, 1 - np.array(zero), np.ones(len(states))]), atol=1e-12)


def test_states_are_numbered_as_the_product(parts):
    timed, theta, rho, ne = parts
    space = modulated.state_space(N, theta, rho, ne)
    rows = model.state_product(timed.select("candidate_id").distinct(), N, theta.n, rho.n, ne.n).orderBy("s").collect()
    assert len(rows) == space.states == 48
    for rate in modulated.RATES:
        assert [r[f"c_{rate}"] for r in rows] == space.category_of(rate).tolist()
    assert [r.k for r in rows] == space.time_of().tolist()


def test_without_modulation_it_is_the_plain_model(spark):
    cand = spark.createDataFrame([(0, 1e-3, 5e-4, 0.8, 0.999)], "candidate_id long, theta double, rho double, rho_alpha double, rho_stay double")
    knots = optimise.default_knots(cand, 1)
    plain = optimise.smc_models(cand, knots, 3, 1).first()
    same = optimise.smc_modulated_models(cand, knots, 3, 1).first()
    np.testing.assert_allclose(same.trans, plain.trans, atol=1e-15)
    np.testing.assert_allclose(same.emis, plain.emis, atol=1e-15)
    cats = model.rate_categories(cand.withColumn("alpha", F.col("rho_alpha")), "Gamma", 3)
    plain = optimise.smc_models(cand, knots, 3, 1, cats, F.col("rho_stay"), 3).first()
    same = optimise.smc_modulated_models(cand, knots, 3, 1, rho=modulated.modulation(cand, "rho", "Gamma", 3)).first()
    np.testing.assert_allclose(same.trans, plain.trans, atol=1e-15)
    np.testing.assert_allclose(same.emis, plain.emis, atol=1e-15)


def test_bounds_set_the_number_of_categories(spark):
    cand = spark.createDataFrame([(0, 0.7)], "candidate_id long, theta_alpha double")
    found = modulated.modulation(cand, "theta", "Gamma", bounds=[0.0, 0.5, 1.0, 4.0])
    assert found.n == 3 == found.scales.count() and found.moves.count() == 9
    assert modulated.modulation(cand, "theta", "Gamma", 4, maximum=3.0).n == 4
    with pytest.raises(ValueError):
        modulated.modulation(cand, "mu")
    with pytest.raises(ValueError):
        modulated.modulation(cand, "theta", "Gamma+Hotspot", 1)
    with pytest.raises(ValueError):
        optimise.smc_modulated_models(cand.selectExpr("candidate_id", "1D theta", "1D rho"), cand, 3, 1, mu=found)


def test_hot_stretch_is_found_by_likelihood_and_decoding(spark, parts):
    """A dense stretch of heterozygous sites scores better, and has more theta, under hotspots of theta."""
    timed, theta, rho, ne = parts
    block = spark.createDataFrame([(0, "chr1", 1, 600, 1, 600)], "block_id int, chrom string, start long, end long, lower_cut long, upper_cut long")
    states = [1 if 300 <= p < 340 and p % 2 else 0 for p in range(1, 601)]
    rows, start = [], 1
    for state, group in itertools.groupby(states):
        length = len(list(group))
        rows.append((1, 0, start, start + length - 1, state))
        start += length
    runs = spark.createDataFrame(rows, "diploid long, block_id int, start_pos long, end_pos long, state int")
    full = modulated.modulated_models(timed, theta, rho, ne)
    cand = timed.select("candidate_id").distinct()
    flat = modulated.modulated_models(timed, modulated.constant(cand, "theta"), rho, ne)
    score = lambda models: scoring.forward_loglik(runs, block, models, 90).first().loglik
    packed = scoring.collect_model(full)
    a, want = np.full(packed.states, 1 / packed.states), 0.0
    for i, s in enumerate(states):
        a = (a @ packed.trans if i else a) * packed.emis[:, s]
        want, a = want + math.log(a.sum()), a / a.sum()
    assert score(full) == pytest.approx(want, abs=1e-8) and score(full) > score(flat) + 5
    space = modulated.state_space(N, theta, rho, ne)
    scales = {r: SCALES[r] for r in ("theta", "rho")}
    wide = decode.decode_diploids(runs, block, packed, space, scales, {r: VALUES[r] for r in scales}, edges(timed)[2], 600)
    found = {r.pos: r for r in wide.collect()}
    inside = np.mean([found[p].theta for p in range(305, 335)])
    outside = np.mean([found[p].theta for p in [*range(1, 200), *range(450, 600)]])
    assert len(found) == 600 and inside > 3 * outside
    assert all(VALUES["rho"] * LOW <= found[p].rho <= VALUES["rho"] * 12 for p in found)
