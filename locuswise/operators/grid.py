"""Time grids, coalescence rates and demography for tables of candidate models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: first-cell width of the log-even grid, oldest time, rate floors
LOG_EVEN_OFFSET = 0.1
DEFAULT_TMAX = 15.0
FLAT_RATE = 0.001
RATE_FLOOR = 0.01


def _boundary(index: Column, n: int, method: str, tmax: float, pairs: int) -> Column:
    share = index.cast("double") / F.lit(float(n))
    if method == "quantiles":
        return -F.log(F.lit(1.0) - share)
    if method in ("log_even", "msmc2"):
        offset = LOG_EVEN_OFFSET / (pairs if method == "msmc2" else 1)
        return F.lit(offset) * F.pow(F.lit(1.0 + tmax / offset), share) - F.lit(offset)
    raise ValueError(f"unknown time grid method {method!r}")


def time_grid(
    candidates: DataFrame,
    n: int,
    method: str = "log_even",
    tmax: float = DEFAULT_TMAX,
    pairs: int = 1,
) -> DataFrame:
    """n time cells per candidate; the last has no upper bound."""
    cells = candidates.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    upper = _boundary(F.least(F.col("k") + 1, F.lit(n - 1)), n, method, tmax, pairs)
    return cells.withColumn("t_lo", _boundary(F.col("k"), n, method, tmax, pairs)).withColumn(
        "t_hi", F.when(F.col("k") < n - 1, upper)
    )


def mean_times(grid: DataFrame) -> DataFrame:
    """Mean coalescence time inside each cell, given its rate ``lambda``."""
    rate, lo, hi = F.col("lambda"), F.col("t_lo"), F.col("t_hi")
    decay = F.exp(-rate * (hi - lo))
    inner = (F.lit(1.0) + rate * lo - decay * (F.lit(1.0) + rate * hi)) / (rate * (F.lit(1.0) - decay))
    return grid.withColumn(
        "t_mean",
        F.when(hi.isNull(), lo + F.lit(1.0) / rate)
        .when(rate < FLAT_RATE, (lo + hi) / 2)
        .otherwise(inner),
    )


def knot_span(n: int, n_knots: int) -> int:
    """Cells between two knots; a knot count whose positions do not fit the grid raises."""
    span = (n + n_knots) // (n_knots + 1)
    if (n - 1) // span != n_knots:
        raise ValueError(f"{n_knots} knots do not fit a grid of {n} cells")
    return span


def spline_rates(knots: DataFrame, grid: DataFrame, n: int, n_knots: int | Column) -> DataFrame:
    """Rate per cell from cubic Hermite segments through knot heights with given slopes.

    ``knots(candidate_id, i, height, slope)`` has ``n_knots + 2`` rows per candidate: both ends and
    the inner knots, which sit on every ``span``-th cell boundary. A column of the grid can name the
    knot count of each candidate; the caller checks these with :func:`knot_span`.
    """
    if isinstance(n_knots, Column):
        span = F.floor((F.lit(n) + n_knots) / (n_knots + 1)).cast("int")
    else:
        span, n_knots = F.lit(knot_span(n, n_knots)), F.lit(n_knots)
    # by hash and not through the driver: a table of many candidates looks smaller than it is before its cells are exploded
    heights = (
        knots.groupBy("candidate_id")
        .agg(F.array_sort(F.collect_list(F.struct("i", "height", "slope"))).alias("_knots"))
        .hint("shuffle_hash")
    )
    # a candidate has n cells, so its boundaries fit one array
    times = F.array_sort(
        F.collect_list(F.struct("k", "t_lo")).over(Window.partitionBy("candidate_id"))
    )
    segment = F.least(F.floor((F.col("k") + 1) / span), n_knots).cast("int")
    left_index = F.when(F.col("_seg") == 0, F.lit(0)).otherwise(F.col("_seg") * span - 1)
    right_index = F.when(F.col("_seg") == n_knots, F.lit(n - 1)).otherwise((F.col("_seg") + 1) * span - 1)
    y0, y1 = F.col("_knots")[F.col("_seg")], F.col("_knots")[F.col("_seg") + 1]
    x = (F.col("t_lo") - F.col("_x0")) / F.col("_width")
    x2, x3 = x * x, x * x * x
    value = (
        (2 * x3 - 3 * x2 + 1) * y0["height"]
        + (x3 - 2 * x2 + x) * F.col("_width") * y0["slope"]
        + (3 * x2 - 2 * x3) * y1["height"]
        + (x3 - x2) * F.col("_width") * y1["slope"]
    )
    return (
        grid.withColumn("_times", times)
        .withColumn("_seg", segment)
        .withColumn("_x0", F.col("_times")[left_index]["t_lo"])
        .withColumn("_width", F.col("_times")[right_index]["t_lo"] - F.col("_x0"))
        .join(heights, "candidate_id")
        .withColumn("lambda", F.greatest(value, F.lit(RATE_FLOOR)))
        .drop("_times", "_seg", "_x0", "_width", "_knots")
    )


def scale_demography(
    grid: DataFrame, theta: Column, generation: float = 20.0, mutation: float = 1.25e-8
) -> DataFrame:
    """Times and rates in units of theta, and as years and diploid sizes for plotting."""
    left, right = F.col("t_lo") * theta / 2, F.col("t_hi") * theta / 2
    rate = F.col("lambda") * 2 / theta
    return grid.select(
        "candidate_id",
        F.col("k").alias("time_index"),
        left.alias("left_time_boundary"),
        right.alias("right_time_boundary"),
        rate.alias("lambda"),
        (left * F.lit(generation) / F.lit(mutation)).alias("years"),
        (F.lit(1.0) / rate / F.lit(2 * mutation)).alias("size"),
    )


def scale_rates_by_ne(grid: DataFrame, categories: DataFrame) -> DataFrame:
    """One grid per population-size category: rate divided by the category's scale."""
    sizes = categories.select("candidate_id", F.col("cat").alias("c_ne"), "scale")
    return (
        grid.join(sizes.hint("shuffle_hash"), "candidate_id")
        .withColumn("lambda", F.col("lambda") / F.col("scale"))
        .drop("scale")
    )
