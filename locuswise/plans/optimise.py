"""Parameter sweeps: candidate tables scored on all data, refined, compared and given intervals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuswise.functions.lineage import cut_lineage, settled
from locuswise.operators import grid, model, modulated
from locuswise.operators.params import best_model, resume_sweep
from locuswise.operators.scoring import FRAGMENT, Scorer, pack_models

Score = Callable[[DataFrame], DataFrame]


def smc_grids(candidates: DataFrame, knots: DataFrame, n: int, n_knots: int | Column) -> DataFrame:
    """Timed grid with spline rates for ``candidates(candidate_id, theta, rho)``."""
    cells = grid.time_grid(candidates, n)
    return grid.mean_times(grid.spline_rates(knots, cells, n, n_knots))


def smc_models(
    candidates: DataFrame,
    knots: DataFrame,
    n: int,
    n_knots: int | Column,
    rho_categories: DataFrame | None = None,
    stay: Column | None = None,
    n_rho: int = 1,
) -> DataFrame:
    """Packed models of the sequentially Markovian coalescent, with modulated rho if given; ``n_knots`` can be a column of the candidates."""
    timed = smc_grids(candidates, knots, n, n_knots)
    ids = candidates.select("candidate_id")
    if stay is not None:
        ids = candidates.select("candidate_id", stay.alias("stay"))
    if rho_categories is None:
        scaled = timed.withColumn("c_rho", F.lit(0))
    else:
        scaled = model.scaled_grids(timed, rho_categories, "rho")
    single = model.category_transitions(ids, "Gamma", 1)
    trans = model.state_transitions(
        model.time_transitions(scaled, ["candidate_id", "c_rho"]),
        model.category_transitions(ids, "Gamma", n_rho),
        single,
        single,
        1,
        n_rho,
        1,
    )
    per_time = model.emissions(timed, F.col("theta"))
    emis = per_time.withColumn("c_rho", F.explode(F.sequence(F.lit(0), F.lit(n_rho - 1)))).select(
        "candidate_id", (F.col("k") * n_rho + F.col("c_rho")).alias("s"), "obs", "p"
    )
    return pack_models(trans, emis)


def smc_modulated_models(
    candidates: DataFrame, knots: DataFrame, n: int, n_knots: int, **rates: modulated.Modulation
) -> DataFrame:
    """Packed models in which each of ``theta``, ``rho`` and ``ne`` that is given changes along the sequence."""
    parts = {rate: modulated.constant(candidates, rate) for rate in modulated.RATES}
    unknown = set(rates) - set(parts)
    if unknown:
        raise ValueError(f"unknown rates {sorted(unknown)}")
    timed = smc_grids(candidates.select("candidate_id", "theta", "rho"), knots, n, n_knots)
    return modulated.modulated_models(timed, **(parts | rates))


def default_knots(candidates: DataFrame, n_knots: int) -> DataFrame:
    """Starting heights: one, nudged up and down in turn, flat ends."""
    nudged = F.when(F.col("i") % 2 == 0, 1.01).otherwise(0.99)
    return candidates.select(
        "candidate_id", F.explode(F.sequence(F.lit(0), F.lit(n_knots + 1))).alias("i")
    ).select("candidate_id", "i", nudged.alias("height"), F.lit(0.0).alias("slope"))


def knot_sweep(
    runs: DataFrame,
    blocks: DataFrame,
    candidates: DataFrame,
    k_min: int,
    k_max: int,
    n: int,
    knots_for: Callable[[DataFrame, int], DataFrame] = default_knots,
    size: int = FRAGMENT,
) -> DataFrame:
    """Best candidate per knot count: (knots, candidate_id, loglik, free, reason).

    A knot count whose positions do not fit the grid has no candidate, and the reason says so.
    """
    score = Scorer.over(runs, blocks, size)
    candidates = settled(candidates, "candidates")
    fits, unfit = [], []
    for k in range(k_min, k_max + 1):
        span = (n + k) // (k + 1)
        if (n - 1) // span != k:
            unfit.append((k, f"{k} knots do not divide {n} times evenly"))
            continue
        scored = score(smc_models(candidates, knots_for(candidates, k), n, k))
        fits.append(scored.withColumn("knots", F.lit(k)).withColumn("free", F.lit(k + 3)))
    if not fits:
        raise ValueError("no knot count fits the grid")
    every = reduce(lambda a, b: a.unionByName(b), fits)
    best = (
        every.groupBy("knots")
        .agg(F.max_by(F.struct("candidate_id", "loglik", "free"), "loglik").alias("b"))
        .select("knots", "b.*", F.lit(None).cast("string").alias("reason"))
    )
    if not unfit:
        return best
    rest = candidates.sparkSession.createDataFrame(unfit, "knots int, reason string")
    return best.unionByName(rest, allowMissingColumns=True)


def fit_knots(*args, **kwargs) -> DataFrame:
    return best_model(knot_sweep(*args, **kwargs).filter("reason IS NULL").drop("reason"))


def grid_around(
    centre: Mapping[str, float], widths: Mapping[str, float], points: int, spark
) -> DataFrame:
    """Candidate table (candidate_id, one column per parameter): a grid around a centre."""
    names = list(centre)
    frame = spark.range(points ** len(names)).withColumnRenamed("id", "candidate_id")
    for i, name in enumerate(names):
        step = F.floor(F.col("candidate_id") / F.lit(points**i)) % points - (points - 1) // 2
        frame = frame.withColumn(name, F.lit(centre[name]) + step * F.lit(widths[name]))
    return frame


def refine(
    score: Score,
    centre: Mapping[str, float],
    widths: Mapping[str, float],
    spark,
    points: int = 3,
    rounds: int = 10,
    tolerance: float = 1e-4,
) -> tuple[dict[str, float], float]:
    """Move a small grid to its best point and halve it when the centre wins.

    Each round is one job over all data; one row comes back to the driver.
    """
    centre, widths = dict(centre), dict(widths)
    before = None
    for _ in range(rounds):
        candidates = grid_around(centre, widths, points, spark)
        best = (
            score(candidates)
            .join(candidates, "candidate_id")
            .orderBy(F.desc("loglik"), "candidate_id")
            .first()
        )
        moved = any(best[name] != centre[name] for name in centre)
        centre = {name: best[name] for name in centre}
        if not moved:
            if before is not None and abs((best["loglik"] - before) / before) < tolerance:
                break
            before = best["loglik"]
            widths = {name: width / 2 for name, width in widths.items()}
    return centre, best["loglik"]


def resume(score: Score, candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Scores of all candidates, computing only those not in ``done(candidate_id, loglik)``."""
    fresh = cut_lineage(score(resume_sweep(candidates, done)))
    return done.select("candidate_id", "loglik").unionByName(fresh.select("candidate_id", "loglik"))


def _as_row(best: DataFrame) -> DataFrame:
    # a model has tens of parameters, so they fit one row
    return best.agg(F.sort_array(F.collect_list(F.struct("name", "value"))).alias("params"))


def _step(value: Column, interval: float) -> Column:
    return (F.lit(1.0) + F.abs(value)) * F.lit(interval)


def perturbed(best: DataFrame, interval: float, pairs: bool = False) -> DataFrame:
    """Long candidates (candidate_id, name, value, i, j, di, dj): the centre, each parameter moved
    both ways, and with ``pairs`` each two parameters moved together."""
    row = _as_row(best).withColumn("n", F.size("params"))
    index = F.sequence(F.lit(0), F.col("n") - 1)
    sides = F.array(F.lit(-1), F.lit(1))
    zero = F.lit(0)
    centre = row.select("params", F.lit(-1).alias("i"), F.lit(-1).alias("j"), zero.alias("di"), zero.alias("dj"))
    single = (
        row.withColumn("i", F.explode(index))
        .withColumn("di", F.explode(sides))
        .select("params", "i", F.lit(-1).alias("j"), "di", zero.alias("dj"))
    )
    moves = centre.unionByName(single)
    if pairs:
        both = (
            row.withColumn("i", F.explode(index))
            .withColumn("j", F.explode(F.filter(index, lambda x: x > F.col("i"))))
            .withColumn("di", F.explode(sides))
            .withColumn("dj", F.explode(sides))
            .select("params", "i", "j", "di", "dj")
        )
        moves = moves.unionByName(both)
    # i and j run from -1, so the pair of them is below (parameters + 1) squared
    pair = (F.col("i") + 1).cast("long") * (F.size("params") + 1) + F.col("j") + 1
    code = pair * 9 + (F.col("di") + 1) * 3 + F.col("dj") + 1
    each = moves.withColumn("candidate_id", code.cast("long")).select(
        "candidate_id", "i", "j", "di", "dj", F.posexplode("params").alias("at", "p")
    )
    moved = (
        F.when(F.col("at") == F.col("i"), F.col("di")).when(F.col("at") == F.col("j"), F.col("dj")).otherwise(0)
    )
    value = F.col("p.value") + moved * _step(F.col("p.value"), interval)
    return each.select("candidate_id", "i", "j", "di", "dj", F.col("p.name").alias("name"), value.alias("value"))


def curvature_ci(best: DataFrame, score: Score, interval: float = 1e-4) -> DataFrame:
    """95 % interval per parameter from the second difference of the log-likelihood.

    ``best(name, value)``; ``score`` takes long candidates and returns (candidate_id, loglik). A
    parameter where the likelihood is not concave has no interval.
    """
    moves = cut_lineage(perturbed(best, interval))
    scored = score(moves.select("candidate_id", "name", "value"))
    heads = moves.select("candidate_id", "i", "di").distinct().join(scored, "candidate_id")
    # one row per moved parameter; the centre travels along as a one-row aggregate of the same table
    folded = heads.agg(
        F.max(F.when(F.col("i") == -1, F.col("loglik"))).alias("f0"),
        F.collect_list(F.when(F.col("i") >= 0, F.struct("i", "di", "loglik"))).alias("sides"),
    )
    second = (
        folded.select("f0", F.explode("sides").alias("s"))
        .groupBy("f0", F.col("s.i").alias("i"))
        .agg(F.sum("s.loglik").alias("around"))
    )
    names = _as_row(best).select(F.posexplode("params").alias("i", "p"))
    h = _step(F.col("p.value"), interval)
    curve = -(F.col("around") - 2 * F.col("f0")) / (h * h)
    half = F.when(curve > 0, F.lit(1.96) / F.sqrt(curve))
    return names.join(second, "i").select(
        F.col("p.name").alias("name"),
        F.col("p.value").alias("value"),
        (F.col("p.value") - half).alias("lower"),
        (F.col("p.value") + half).alias("upper"),
    )


def curvature_cov(best: DataFrame, score: Score, interval: float = 1e-4) -> DataFrame:
    """Covariance of the estimates as (name_i, name_j, value): inverse of the curvature matrix.

    Scoring runs in Spark; the (p x p) differences are inverted on the driver.
    """
    moves = cut_lineage(perturbed(best, interval, pairs=True))
    scored = score(moves.select("candidate_id", "name", "value"))
    heads = moves.select("candidate_id", "i", "j", "di", "dj").distinct().join(scored, "candidate_id")
    f = {(r["i"], r["j"], r["di"], r["dj"]): r["loglik"] for r in heads.collect()}
    params = sorted((r["name"], r["value"]) for r in best.collect())
    h = [(1 + abs(value)) * interval for _, value in params]
    size = len(params)
    hessian = np.zeros((size, size))
    for i in range(size):
        hessian[i, i] = -(f[i, -1, 1, 0] - 2 * f[-1, -1, 0, 0] + f[i, -1, -1, 0]) / h[i] ** 2
        for j in range(i + 1, size):
            cross = f[i, j, 1, 1] - f[i, j, 1, -1] - f[i, j, -1, 1] + f[i, j, -1, -1]
            hessian[i, j] = hessian[j, i] = -cross / (4 * h[i] * h[j])
    cov = np.linalg.inv(hessian)
    rows = [
        (params[i][0], params[j][0], float(cov[i, j])) for i in range(size) for j in range(size)
    ]
    return best.sparkSession.createDataFrame(rows, "name_i string, name_j string, value double")


def pivot_params(candidates: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long candidates to one column per parameter."""
    return candidates.groupBy("candidate_id").pivot("name", list(names)).agg(F.first("value"))
