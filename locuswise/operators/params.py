"""Named parameters, model choice and optimiser bookkeeping as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuswise.functions.tiling import TILE, neighbours

# fixed values: parameter name patterns
HEIGHT = r"^y[0-9]+$"
SLOPE = r"^y[0-9]+_prime$"
LAMBDA = r"^l[0-9]+$"


def select_parameters(
    params: DataFrame,
    heights: bool = True,
    slopes: bool = True,
    lambdas: bool = False,
    ignore: Sequence[str] = (),
) -> DataFrame:
    """Parameters that vary: drop spline heights, slopes, rates or listed names."""
    name = F.col("name")
    kept = params.filter(~name.isin(list(ignore))) if ignore else params
    for wanted, pattern in ((heights, HEIGHT), (slopes, SLOPE), (lambdas, LAMBDA)):
        if not wanted:
            kept = kept.filter(~name.rlike(pattern))
    return kept


def boundary_guard(params: DataFrame, bounds: DataFrame, interval: float) -> DataFrame:
    """Whether the differentiation interval around each value stays inside its bounds.

    The step grows with the value, ``h = (1 + |value|) * interval``, with half an interval of slack.
    """
    reach = (F.lit(1.0) + F.abs("value")) * F.lit(interval) + F.lit(interval / 2)
    low = F.col("value") - reach < F.col("lower")
    high = F.col("value") + reach > F.col("upper")
    return (
        params.join(bounds, "name")
        .withColumn("kept", ~(low | high))
        .withColumn("reason", F.when(low, F.lit("too close to lower")).when(high, F.lit("too close to upper")))
    )


def update_params(old: DataFrame, new: DataFrame) -> DataFrame:
    """Values of matching names are overwritten, the rest kept."""
    keys = [c for c in ("candidate_id", "name") if c in old.columns and c in new.columns]
    fresh = new.select(*keys, F.col("value").alias("_new"))
    return (
        old.join(fresh, keys, "left")
        .withColumn("value", F.coalesce("_new", "value"))
        .drop("_new")
    )


def leave_one_out(ll: DataFrame, test_ids: DataFrame) -> DataFrame:
    """Log-likelihoods of every diploid except the tested ones."""
    return ll.join(test_ids.select("diploid").distinct(), "diploid", "left_anti")


def leave_one_out_totals(ll: DataFrame) -> DataFrame:
    """For each diploid in turn, the total over all others: grand total minus its own share."""
    keys = [c for c in ("candidate_id",) if c in ll.columns]
    own = ll.groupBy(*keys, "diploid").agg(F.sum("loglik").alias("own"))
    if keys:
        total = own.groupBy(*keys).agg(F.sum("own").alias("total"))
        joined = own.join(total, keys)
    else:
        joined = own.withColumn("total", own.agg(F.sum("own").alias("t")).scalar())
    return joined.select(*keys, "diploid", (F.col("total") - F.col("own")).alias("training_loglik"))


def resume_sweep(candidates: DataFrame, done: DataFrame) -> DataFrame:
    return candidates.join(done.select("candidate_id").distinct(), "candidate_id", "left_anti")


def aic(free: Column, loglik: Column) -> Column:
    return F.lit(2.0) * free - F.lit(2.0) * loglik


def best_model(fits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest AIC; among equals the fit with fewest knots (the first one made)."""
    scored = fits.withColumn("aic", aic(F.col("free"), F.col("loglik")))
    rest = [c for c in scored.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct("aic", "knots")).alias("best")
    grouped = scored.groupBy(*keys).agg(best) if keys else scored.agg(best)
    return grouped.select(*keys, "best.*")


def publish_best(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored estimates are replaced only where the AIC improved; ``replaced`` tells which."""
    cols = [c for c in old.columns if c not in keys]
    tagged = old.select(*keys, *cols, F.lit(0).alias("_new")).unionByName(
        new.select(*keys, *cols, F.lit(1).alias("_new"))
    )
    best = tagged.groupBy(*keys).agg(
        F.min_by(F.struct(*cols, "_new"), F.struct("aic", "_new")).alias("best")
    )
    return best.select(
        *keys, *[f"best.{c}" for c in cols], (F.col("best._new") == 1).alias("replaced")
    )


def _relative_change(value: Column, before: Column) -> Column:
    return F.abs((value - before) / before)


def convergence_step(log: DataFrame, tolerance: float, burn_in: int = 0, tile: int = TILE) -> DataFrame:
    """First step after the burn-in whose relative change of the objective is below tolerance."""
    linked = neighbours(log, ["run"], "step", previous="prev", tile=tile)
    # a zero objective gives an infinite change in the ratio test, so it never counts
    before = F.nullif(F.col("prev.value"), F.lit(0.0))
    reached = (F.col("step") > burn_in) & (_relative_change(F.col("value"), before) < tolerance)
    return linked.groupBy("run").agg(F.min(F.when(reached, F.col("step"))).alias("converged_at"))


def convergence_by_parameter(log: DataFrame, tolerance: float, tile: int = TILE) -> DataFrame:
    """First step by which every parameter of the run has had a small enough relative change."""
    linked = neighbours(log, ["run", "name"], "step", previous="prev", tile=tile)
    before = F.when(F.col("prev.value") == 0, F.lit(1e-6)).otherwise(F.col("prev.value"))
    reached = _relative_change(F.col("value"), before) < tolerance
    each = linked.groupBy("run", "name").agg(F.min(F.when(reached, F.col("step"))).alias("first"))
    return each.groupBy("run").agg(
        F.when(F.count("first") == F.count(F.lit(1)), F.max("first")).alias("converged_at")
    )


def span_weighted_mean(steps: DataFrame, position: str = "at", tile: int = TILE) -> DataFrame:
    """Mean of a step landscape; each value counts for the span up to the next change point."""
    linked = neighbours(steps, ["sequence"], position, following="next", tile=tile)
    span = F.col(f"next.{position}") - F.col(position)
    return linked.groupBy("sequence").agg(
        (F.sum(F.col("value") * span) / F.nullif(F.sum(span), F.lit(0))).alias("mean_value")
    )


def time_weighted_size(
    epochs: DataFrame, horizon: int, start: str = "at", tile: int = TILE
) -> DataFrame:
    """Harmonic mean size over epochs weighted by their length; the last one ends at the horizon."""
    linked = neighbours(epochs, ["sequence"], start, following="next", tile=tile)
    span = F.coalesce(F.col(f"next.{start}"), F.lit(horizon)) - F.col(start)
    return linked.groupBy("sequence").agg(
        (F.sum(span) / F.sum(span / F.col("size"))).alias("harmonic_size"),
        (F.sum(span / F.col("size")) / F.sum(span)).alias("scale_to_mean"),
    )


def matrix_cell_distance(mats_a: DataFrame, mat_b: DataFrame) -> DataFrame:
    """Per matrix: sum of squared log differences over cells where the target is not zero."""
    target = mat_b.filter(F.col("p") != 0).select("i", "j", F.col("p").alias("_target"))
    gap = F.log("p") - F.log("_target")
    return (
        mats_a.join(target, ["i", "j"]).groupBy("matrix_id").agg(F.sum(gap * gap).alias("dist"))
    )


def matrix_distance(mats_a: DataFrame, mat_b: DataFrame, how: str = "sum") -> DataFrame:
    """Summary over matrices of their distance to the target."""
    how_to = {
        "sum": F.sum("dist"),
        "mean": F.avg("dist"),
        "median": F.percentile("dist", 0.5),
        "max": F.max("dist"),
        "min": F.min("dist"),
    }
    return matrix_cell_distance(mats_a, mat_b).agg(how_to[how].alias("dist"))
