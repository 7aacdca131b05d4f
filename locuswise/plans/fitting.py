"""Fits of spline models: one per knot count and start, all moved together, one job over the data a round.

The state of the search is a table with one row per (knots, start): the parameters, their step widths, the leaps to
try next and the best log-likelihood so far. It is written every round, so a search can be taken up where it stopped.
A fit ends when no step of any width worth taking gains more than ``GAIN``; the others go on without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuswise.functions.lineage import settled
from locuswise.operators.grid import RATE_FLOOR, knot_span
from locuswise.operators.params import aic, boundary_guard
from locuswise.operators.scoring import FRAGMENT, Scorer
from locuswise.plans.optimise import curvature_ci, curvature_cov, smc_models

#: Smallest number next to one, above it.
EPSILON = 2.0**-52
#: Rows of one round are told apart by it: more parameters than a model can have.
MOVES = 1_000
#: Log-likelihood a step has to gain, as the original's tolerance of function values.
GAIN = 1e-4
#: Widths of heights and slopes at the start.
HEIGHT_WIDTH, SLOPE_WIDTH = 0.25, 0.1


def start_state(starts: DataFrame, k_min: int, k_max: int) -> DataFrame:
    """State (knots, start, theta, params, leaps, loglik) of ``starts(start, theta, rho)`` for every knot count.

    Theta stays as it is. Heights begin at one, inner ones nudged up and down in turn, slopes at zero.
    """
    k, i = F.col("knots"), F.sequence(F.lit(0), F.col("knots") + 1)

    def param(name, value, width, lower, upper) -> Column:
        fields = {"name": name, "value": value, "width": width, "lower": lower, "upper": upper}
        return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in fields.items()])

    inf = float("inf")
    nudged = lambda at: F.when(at > k, 1.0).when(at % 2 == 0, 1.01).otherwise(0.99)
    heights = F.transform(i, lambda at: param(F.concat(F.lit("y"), at.cast("string")), nudged(at), HEIGHT_WIDTH, RATE_FLOOR, inf))
    slopes = F.transform(
        i, lambda at: param(F.concat(F.lit("y"), at.cast("string"), F.lit("_prime")), 0.0, SLOPE_WIDTH, -1.0, 1.0)
    )
    rho = F.array(param("rho", F.col("rho"), F.col("rho") / 2, 0.0, inf))
    counts = F.explode(F.sequence(F.lit(k_min), F.lit(k_max))).alias("knots")
    return starts.select(counts, F.col("start").cast("long").alias("start"), "theta", "rho").select(
        "knots",
        "start",
        "theta",
        F.concat(rho, heights, slopes).alias("params"),
        F.lit(None).cast("array<array<double>>").alias("leaps"),
        F.lit(None).cast("double").alias("loglik"),
    )


def _values() -> Column:
    return F.col("params.value")


def moves(state: DataFrame) -> DataFrame:
    """Points to look at: the centre (move 0), each parameter one width down and up, and the leaps (last).

    A point outside a parameter's open range is left out.
    """
    size = F.size("params")

    def moved(move: Column) -> Column:
        at, side = F.floor((move - 1) / 2), F.when(move % 2 == 1, -1.0).otherwise(1.0)
        each = lambda p, i: p["value"] + F.when(i == at, side * p["width"]).otherwise(0.0)
        return F.when(move > 2 * size, F.get("leaps", (move - 2 * size - 1).cast("int"))).when(move == 0, _values()).otherwise(F.transform("params", each))

    points = state.withColumn("move", F.explode(F.sequence(F.lit(0), 2 * size + F.coalesce(F.size("leaps"), F.lit(0))))).withColumn("point", moved(F.col("move")))
    inside = F.forall(
        F.arrays_zip("point", "params"), lambda z: (z["point"] > z["params"]["lower"]) & (z["point"] < z["params"]["upper"])
    )
    code = (F.col("knots").cast("long") * 2**20 + F.col("start")) * MOVES + F.col("move")
    return points.filter(F.col("point").isNotNull() & inside).withColumn("candidate_id", code)


def point_models(points: DataFrame, k_min: int, k_max: int, n: int) -> DataFrame:
    """Packed models of points (candidate_id, knots, theta, params, point), all knot counts in one pass."""
    for k in range(k_min, k_max + 1):
        knot_span(n, k)
    k = F.col("knots")
    # rho first, then the heights, then the slopes
    at = F.posexplode(F.slice("point", F.lit(2), k + 2)).alias("i", "height")
    knots = points.select("candidate_id", "point", "knots", at).select(
        "candidate_id", "i", "height", F.element_at("point", F.col("i") + k + 4).alias("slope")
    )
    candidates = points.select("candidate_id", "theta", F.col("point")[0].alias("rho"), k.cast("int").alias("knots"))
    return smc_models(candidates, knots, n, k)


def _inside(there: Column, own: Column, p: Column) -> Column:
    """``there``, or half the way from ``own`` to a bound that lies before it."""
    there = F.when(there <= p["lower"], (own + p["lower"]) / 2).otherwise(there)
    return F.when(there >= p["upper"], (own + p["upper"]) / 2).otherwise(there)


def _leap(clip: float = 2.0) -> Column:
    """The top of the parabola through the three values of every parameter, at most ``clip`` widths away."""

    def shifted(p: Column, i: Column) -> Column:
        down, up = F.col("sides")[2 * i + 1], F.col("sides")[2 * i + 2]
        bend = 2 * F.col("centre") - down - up
        top = F.when(bend > 0, (up - down) / (2 * bend)).otherwise(clip * F.signum(up - down))
        there = p["value"] + p["width"] * F.greatest(F.lit(-clip), F.least(F.lit(clip), F.coalesce(top, F.lit(0.0))))
        return _inside(there, p["value"], p)

    return F.transform("params", shifted)


def _onward(times: float) -> Column:
    """The step just taken, gone on with ``times`` as far."""

    def shifted(z: Column) -> Column:
        return _inside(z["to"] + times * (z["to"] - z["params"]["value"]), z["to"], z["params"])

    return F.transform(F.arrays_zip("params", "to"), shifted)


def step(state: DataFrame, points: DataFrame, scores: DataFrame, gain: float = GAIN) -> DataFrame:
    """Next state: the best point becomes the centre; where none gains more than ``gain``, all widths are halved.

    Widths follow the steps: a parameter that moved by its width or more has it doubled, up to a quarter of its range, and
    one that a leap moved by less than a quarter of it has it halved. The leaps for the next round are the tops of the
    parabolas around the old centre, and the step just taken, as far again and four times as far.
    """
    # a model without a log-likelihood would be the greatest of all
    found = points.select("knots", "start", "move", "point", "candidate_id").join(
        scores.filter(~F.isnan("loglik")), "candidate_id"
    )
    # a model has tens of parameters, so the points of one start fit a row
    best = found.groupBy("knots", "start").agg(
        F.max_by(F.struct("move", "point", "loglik"), F.struct("loglik", -F.col("move"))).alias("best"),
        F.max(F.when(F.col("move") == 0, F.col("loglik"))).alias("centre"),
        F.map_from_entries(F.collect_list(F.struct("move", "loglik"))).alias("sides"),
    )
    won = F.col("best.loglik") > F.col("centre") + F.lit(gain)
    leapt = F.col("best.move") > 2 * F.size("params")
    joined = (
        state.drop("leaps", "loglik")
        .join(best, ["knots", "start"])
        .withColumn("won", won)
        .withColumn("to", F.when(won, F.col("best.point")).otherwise(_values()))
    )

    def width(p: Column, to: Column) -> Column:
        # the sum that made a step of one width rounds
        far = F.abs(to - p["value"]) / p["width"]
        grown = F.greatest(p["width"], F.least(2 * p["width"], (p["upper"] - p["lower"]) / 4))
        return (
            F.when(~F.col("won"), p["width"] / 2)
            .when(far > 0.99, grown)
            .when(leapt & (far < 0.25), p["width"] / 2)
            .otherwise(p["width"])
        )

    fresh = F.transform(
        F.arrays_zip("params", "to"),
        lambda z: F.struct(
            z["params"]["name"].alias("name"),
            z["to"].alias("value"),
            width(z["params"], z["to"]).alias("width"),
            z["params"]["lower"].alias("lower"),
            z["params"]["upper"].alias("upper"),
        ),
    )
    leaps = F.when(F.col("won"), F.array(_leap(), _onward(1.0), _onward(4.0))).otherwise(F.array(_leap()))
    value = F.when(F.col("won"), F.col("best.loglik")).otherwise(F.col("centre"))
    return joined.select("knots", "start", "theta", fresh.alias("params"), leaps.alias("leaps"), value.alias("loglik"))


def going(tolerance: float) -> Column:
    """Whether a width is left above ``tolerance`` of where it began, for a value above one of its share of the value."""

    def wide(p: Column) -> Column:
        scale = F.when(p["name"] == "rho", p["value"] / 2).otherwise(HEIGHT_WIDTH * F.greatest(F.lit(1.0), F.abs(p["value"])))
        return p["width"] > tolerance * scale

    return F.exists("params", wide)


def search(
    score: Scorer,
    state: DataFrame,
    k_min: int,
    k_max: int,
    n: int,
    rounds: int | None = None,
    tolerance: float = 1e-3,
    gain: float = GAIN,
) -> DataFrame:
    """State when every fit has ended (:func:`going`), or after ``rounds`` rounds where a number is given.

    It ends by itself: a round without halving gains at least ``gain``, and a log-likelihood has a top.
    """
    state = settled(state, "fit-state")
    left = state.filter(going(tolerance))
    while (rounds is None or rounds > 0) and not left.isEmpty():
        points = settled(moves(left), "fit-points")
        fresh = step(left, points, score(point_models(points, k_min, k_max, n)), gain)
        state = settled(fresh.unionByName(state.filter(~going(tolerance))), "fit-state")
        left = state.filter(going(tolerance))
        rounds = None if rounds is None else rounds - 1
    return state


def fit_splines(
    runs: DataFrame, blocks: DataFrame, starts: DataFrame, k_min: int, k_max: int, n: int, size: int = FRAGMENT, **limits
) -> DataFrame:
    """State of one fit per knot count and start of ``starts(start, theta, rho)``; ``limits`` as in :func:`search`.

    A knot count whose positions do not fit the grid raises.
    """
    return search(Scorer.over(runs, blocks, size), start_state(starts, k_min, k_max), k_min, k_max, n, **limits)


def best_fits(state: DataFrame) -> DataFrame:
    """Best start per knot count: (knots, start, theta, loglik, free, aic, params). All parameters that vary are counted."""
    row = F.struct("start", "theta", "loglik", "params")
    best = state.groupBy("knots").agg(F.max_by(row, F.struct("loglik", -F.col("start"))).alias("b")).select("knots", "b.*")
    free = F.size("params")
    return best.withColumn("free", free).withColumn("aic", aic(free.cast("double"), F.col("loglik")))


def steady_interval(loglik: float, least: float = 1e-4) -> float:
    """Interval of differences that does not drown in the rounding of ``loglik``."""
    return max(least, (EPSILON * abs(loglik)) ** 0.25)


def curvature_at(score: Scorer, fit: DataFrame, n: int, cov: bool = False, interval: float | None = None) -> DataFrame:
    """Intervals (or covariances) around one row of :func:`best_fits`.

    Parameters too close to a bound are left out first and stay at their value, as do those that others are
    differentiated beside. Bounds of an interval are inside the parameter's range.
    """
    row = fit.select("knots", "theta", "loglik").first()
    width = steady_interval(row.loglik) if interval is None else interval
    # tens of rows: the parameters of one model
    params = settled(fit.select(F.posexplode("params").alias("place", "p")).select("place", "p.*"), "fit-params")
    checked = boundary_guard(params.select("name", "value"), params.select("name", "lower", "upper"), width)
    kept = settled(checked.filter("kept").select("name", "value"), "fit-kept")
    own = F.array(
        *[
            F.struct(F.lit(r["place"]).alias("place"), F.lit(r["name"]).alias("name"), F.lit(r["value"]).alias("own"))
            for r in params.orderBy("place").collect()
        ]
    )

    def scored(long: DataFrame) -> DataFrame:
        every = long.select("candidate_id").distinct().select("candidate_id", F.explode(own).alias("p")).select("candidate_id", "p.*")
        filled = every.join(long.select("candidate_id", "name", "value"), ["candidate_id", "name"], "left")
        points = (
            filled.groupBy("candidate_id")
            .agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("value", "own").alias("v")))).alias("s"))
            .select("candidate_id", F.lit(row.knots).alias("knots"), F.lit(row.theta).alias("theta"), F.col("s.v").alias("point"))
        )
        return score(point_models(settled(points, "curvature-points"), row.knots, row.knots, n))

    if cov:
        return curvature_cov(kept, scored, width)
    found = curvature_ci(kept, scored, width).join(params.select("name", F.col("lower").alias("_lo"), F.col("upper").alias("_hi")), "name")
    inside = {"lower": F.when(F.col("lower").isNotNull(), F.greatest("lower", "_lo")), "upper": F.when(F.col("upper").isNotNull(), F.least("upper", "_hi"))}
    return found.withColumns(inside).drop("_lo", "_hi")
