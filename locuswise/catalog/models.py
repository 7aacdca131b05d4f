"""Queries over parameters, time grids and model tables; candidates come from part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from locuswise import bindings as b
from locuswise.catalog import sql as q
from locuswise.catalog.maps import rounded
from locuswise.operators import grid, intervals, model, params

N = 8
N_KNOTS = 2
TMAX = 15
DIGITS = 10
NE_SCALES = (0.5, 1.0, 2.0)
RHO_SCALES = (0.5, 1.0, 2.0)
CLASSES = 4
CLASS_BOUNDS = (0.0, 0.2, 0.6, 1.5, 6.0)
CLASS_MAXIMUM = 5.0


def cells(spark, sf):
    """Grid of every candidate with its rates."""
    made = grid.time_grid(b.candidates(spark, sf), N, tmax=float(TMAX))
    rate = F.lit(1.0) + F.lit(0.1) * ((F.col("candidate_id") + F.col("k")) % 5)
    return made.withColumn("lambda", rate)


def timed(spark, sf):
    return grid.mean_times(cells(spark, sf))


def knots(spark, sf):
    """Heights and slopes per candidate from size and price."""
    part = b.table(spark, sf, "part")
    rows = part.select(
        F.col("p_partkey").alias("candidate_id"),
        F.explode(F.sequence(F.lit(0), F.lit(N_KNOTS + 1))).alias("i"),
        "p_size",
        "p_retailprice",
    )
    return rows.select(
        "candidate_id",
        "i",
        (F.lit(0.1) + ((F.col("p_size") + F.col("i") * 3) % 7) / F.lit(2.0)).alias("height"),
        (F.lit(0.01) * ((F.col("p_size") + F.col("i")) % 3)).alias("slope"),
    )


def scales(spark, sf, values):
    options = F.array(
        *[F.struct(F.lit(i).alias("cat"), F.lit(v).alias("scale")) for i, v in enumerate(values)]
    )
    return (
        b.candidates(spark, sf)
        .select("candidate_id", F.explode(options).alias("c"))
        .select("candidate_id", "c.*")
    )


def model_sizes(spark, sf):
    return b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("candidate_id"), (F.col("p_size") % 8 + 1).alias("n")
    )


def gamma_models(spark, sf):
    return b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("candidate_id"),
        (F.col("p_size") / F.lit(20.0)).alias("alpha"),
        (F.col("p_retailprice") / F.lit(10.0)).alias("heat"),
        (F.lit(1.0) - F.col("p_size") * F.lit(0.0001)).alias("stay"),
    )


def param_list(spark, sf):
    part = b.table(spark, sf, "part")
    value = {
        "theta": "(p_size + 1) * 0.001D",
        "rho": "(p_size + 1) * 0.0005D",
        "rho.alpha": "p_size / 20.0D",
        "r_ii": "1.0D - p_size * 0.0001D",
        "y0": "p_retailprice / 1000.0D",
        "y0_prime": "p_size / 100.0D",
        "y1": "p_retailprice / 2000.0D",
        "y1_prime": "p_size / 200.0D",
        "l0": "1.0D + p_size / 10.0D",
    }
    pairs = ", ".join(f"'{name}', {expr}" for name, expr in value.items())
    return part.select(
        F.col("p_partkey").alias("candidate_id"), F.expr(f"stack({len(value)}, {pairs}) AS (name, value)")
    )


def refreshed(spark, sf):
    """New theta values where the part was sold."""
    return (
        b.table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("candidate_id"))
        .agg(F.avg("l_discount").alias("value"))
        .withColumn("name", F.lit("theta"))
    )


def bounds(spark, sf):
    return param_list(spark, sf).groupBy("name").agg(
        F.min("value").alias("lower"), F.max("value").alias("upper")
    )


def fits(spark, sf, status=None):
    """One fit per order: customer is the run, the priority gives the knot count."""
    orders = b.table(spark, sf, "orders")
    if status:
        orders = orders.filter(F.col("o_orderstatus") == status)
    # several orders of a customer may share a knot count: keep the best of them
    return (
        orders.select(
            F.col("o_custkey").alias("run"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("knots"),
            (-F.col("o_totalprice") / 1000.0).alias("loglik"),
        )
        .groupBy("run", "knots")
        .agg(F.max("loglik").alias("loglik"))
        .withColumn("free", F.col("knots") + 3)
    )


def published(spark, sf):
    def best(status):
        return params.best_model(fits(spark, sf, status), ["run"]).select(
            "run", "knots", "loglik", "aic"
        )

    return rounded(params.publish_best(best("O"), best("F"), ["run"]), "loglik", "aic", digits=6)


def looked_up(spark, sf):
    """Cell of each lineitem quantity (as a time) in the grid of its part."""
    values = b.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("candidate_id"),
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") / F.lit(2.5)).alias("value"),
    )
    grids = cells(spark, sf).select("candidate_id", "k", "t_lo", "t_hi")
    found = intervals.interval_lookup(values, grids, ["candidate_id"])
    upper = F.when(F.col("t_hi") == F.lit(float("inf")), F.lit(-1.0)).otherwise(F.col("t_hi"))
    return rounded(found.withColumn("t_hi", upper), "t_lo", "t_hi", "value")


def matrices(spark, sf):
    """One matrix per supplier, cells by line number and quantity."""
    lines = b.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("matrix_id"),
        F.col("l_linenumber").cast("int").alias("i"),
        F.col("l_quantity").cast("int").alias("j"),
        "l_extendedprice",
    )
    return lines.groupBy("matrix_id", "i", "j").agg(F.avg("l_extendedprice").alias("p"))


def distances(spark, sf):
    mats = matrices(spark, sf)
    target = mats.groupBy("i", "j").agg(F.avg("p").alias("p"))
    each = params.matrix_cell_distance(mats, target)
    return rounded(each, "dist", digits=6)


def optimiser_parameters(spark, sf):
    """Per user and event type: value of the newest step, as a per-parameter log."""
    return b.optimiser_log(spark, sf).withColumn("name", F.lit("value"))


def weighted_sizes(spark, sf):
    epochs = b.step_landscapes(spark, sf).withColumn("size", F.col("value") + 1.0)
    return rounded(
        params.time_weighted_size(epochs, horizon=30 * 86_400_000_000, tile=86_400_000_000),
        "harmonic_size",
        "scale_to_mean",
        digits=8,
    )


def rho_grid_transitions(spark, sf):
    scaled = model.scaled_grids(timed(spark, sf), scales(spark, sf, RHO_SCALES), "rho")
    return model.time_transitions(scaled, ["candidate_id", "c_rho"])


def full_transitions(spark, sf):
    cand = gamma_models(spark, sf)
    one = model.category_transitions(cand, "Gamma", 1)
    return model.state_transitions(
        rho_grid_transitions(spark, sf),
        model.category_transitions(cand, "Gamma", len(RHO_SCALES)),
        one,
        one,
        1,
        len(RHO_SCALES),
        1,
    )


def categories_by_form(spark, sf):
    """Classes of every form of rate model but the equally probable one."""
    cand = gamma_models(spark, sf)
    forms = {
        "bounds": model.rate_categories(cand, "Gamma", CLASSES, bounds=CLASS_BOUNDS),
        "maximum": model.rate_categories(cand, "Gamma", CLASSES, maximum=CLASS_MAXIMUM),
        "hotspot": model.rate_categories(cand, "Hotspot"),
        "mixed": model.rate_categories(cand, "Gamma+Hotspot", CLASSES),
    }
    named = [rows.withColumn("form", F.lit(form)) for form, rows in forms.items()]
    return rounded(reduce(lambda a, b: a.unionByName(b), named), "scale", "prob", digits=8)


def joint_symbols(spark, sf):
    return rounded(
        model.symbol_emissions(timed(spark, sf), scales(spark, sf, RHO_SCALES), "theta", N, missing=True),
        "p",
    )


QUERIES = {
    "time_grid": lambda s, d: rounded(
        cells(s, d).select("candidate_id", "k", "t_lo", "t_hi"), "t_lo", "t_hi"
    ),
    "mean_times": lambda s, d: rounded(timed(s, d).select("candidate_id", "k", "t_mean"), "t_mean"),
    "interval_lookup": looked_up,
    "spline_rates": lambda s, d: rounded(
        grid.spline_rates(knots(s, d), cells(s, d), N, N_KNOTS).select("candidate_id", "k", "lambda"),
        "lambda",
    ),
    "scale_demography": lambda s, d: rounded(
        grid.scale_demography(cells(s, d), F.col("theta")).drop("years", "size"),
        "left_time_boundary",
        "right_time_boundary",
        "lambda",
        digits=8,
    ),
    "scale_rates_by_ne": lambda s, d: rounded(
        grid.scale_rates_by_ne(cells(s, d), scales(s, d, NE_SCALES)).select(
            "candidate_id", "c_ne", "k", "lambda"
        ),
        "lambda",
    ),
    "category_transitions": lambda s, d: rounded(
        model.category_transitions(gamma_models(s, d), "Gamma", 4), "p"
    ),
    "rate_categories": lambda s, d: rounded(
        model.rate_categories(gamma_models(s, d), "Gamma", CLASSES), "scale", "prob", digits=8
    ),
    "rate_categories_by_form": categories_by_form,
    "state_product": lambda s, d: model.state_product(b.candidates(s, d), N, 2, 3, 2),
    "transition_codes": lambda s, d: model.transition_codes(model_sizes(s, d), missing=True),
    "emission_codes": lambda s, d: model.emission_codes(model_sizes(s, d)),
    "time_transitions": lambda s, d: rounded(model.time_transitions(timed(s, d)), "p"),
    "state_transitions": lambda s, d: rounded(full_transitions(s, d), "p"),
    "emissions": lambda s, d: rounded(model.emissions(timed(s, d), F.col("theta")), "p"),
    "symbol_emissions": joint_symbols,
    "select_parameters": lambda s, d: rounded(
        params.select_parameters(param_list(s, d), slopes=False, ignore=["r_ii"]), "value"
    ),
    "update_params": lambda s, d: rounded(
        params.update_params(param_list(s, d), refreshed(s, d)), "value", digits=9
    ),
    "boundary_guard": lambda s, d: rounded(
        params.boundary_guard(param_list(s, d), bounds(s, d), 0.001), "value", "lower", "upper"
    ),
    "resume_sweep": lambda s, d: params.resume_sweep(
        b.candidates(s, d).select("candidate_id"),
        b.table(s, d, "lineitem")
        .filter("l_returnflag = 'R' AND l_linestatus = 'O'")
        .select(F.col("l_partkey").alias("candidate_id")),
    ),
    "best_model": lambda s, d: rounded(
        params.best_model(fits(s, d), ["run"]), "loglik", "aic", digits=6
    ),
    "publish_best": published,
    "matrix_distance": distances,
    "convergence_step": lambda s, d: params.convergence_step(b.optimiser_log(s, d), 0.05, 3),
    "convergence_by_parameter": lambda s, d: params.convergence_by_parameter(
        optimiser_parameters(s, d), 0.05
    ),
    "span_weighted_mean": lambda s, d: rounded(
        params.span_weighted_mean(b.step_landscapes(s, d), tile=86_400_000_000), "mean_value", digits=8
    ),
    "time_weighted_size": weighted_sizes,
}



def lower_gamma_sql(a: str, x: str) -> str:
    """Share of a gamma of shape ``a`` below ``x``: 200 terms of its series, all of them positive."""
    return f"""(CASE WHEN {x} <= 0 THEN 0 ELSE
        list_sum(list_transform(range(0, 200), lambda j: exp(({a} + j) * ln({x}) - ({x}) - lgamma({a} + j + 1)))) END)"""


def classes_sql(name: str, edges: str) -> str:
    """Classes between successive ``edges(size, a, i, x)``; the last edge is open where x is null."""
    return f""",
{name}_below AS (
  SELECT size, i, CASE WHEN x IS NULL THEN 1 ELSE {lower_gamma_sql("a", "x")} END AS p0,
         CASE WHEN x IS NULL THEN 1 ELSE {lower_gamma_sql("(a + 1)", "x")} END AS p1
  FROM {edges}),
{name} AS (
  SELECT hi.size, CAST(lo.i AS INTEGER) AS cat, (hi.p1 - lo.p1) / (hi.p0 - lo.p0) AS scale,
         (hi.p0 - lo.p0) / sum(hi.p0 - lo.p0) OVER (PARTITION BY hi.size) AS prob
  FROM {name}_below lo JOIN {name}_below hi ON hi.size = lo.size AND hi.i = lo.i + 1)"""


# quantiles by halving a bracket of log x, for each size once
EQUAL_CLASSES = f"""
alphas AS (SELECT DISTINCT p_size AS size, p_size / CAST(20 AS DOUBLE) AS a FROM part),
halved AS (
  SELECT size, a, i, 0 AS step, CAST(-200 AS DOUBLE) AS lo, CAST(5 AS DOUBLE) AS hi FROM alphas, range(1, {CLASSES}) r(i)
  UNION ALL
  SELECT size, a, i, step + 1, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END FROM (
    SELECT *, (lo + hi) / 2 AS mid, {lower_gamma_sql("a", "exp((lo + hi) / 2)")} < i / CAST({CLASSES} AS DOUBLE) AS below
    FROM halved WHERE step < 60)),
edges AS (
  SELECT size, a, i, exp((lo + hi) / 2) AS x FROM halved WHERE step = 60
  UNION ALL SELECT size, a, 0, 0 FROM alphas
  UNION ALL SELECT size, a, {CLASSES}, NULL FROM alphas)""" + classes_sql("equal", "edges")

FIXED_CLASSES = f""",
bound_edges AS (
  SELECT size, a, i, a * [{", ".join(f"CAST({x} AS DOUBLE)" for x in CLASS_BOUNDS)}][i + 1] AS x
  FROM alphas, range(0, {CLASSES + 1}) r(i)),
even_edges AS (SELECT size, a, i, a * CAST({CLASS_MAXIMUM} AS DOUBLE) * i / {CLASSES} AS x FROM alphas, range(0, {CLASSES + 1}) r(i))
""" + classes_sql("bounded", "bound_edges") + classes_sql("even", "even_edges")


def cells_sql(n: int) -> str:
    return f""",
cells AS (
  SELECT *, 0.1 * pow(1 + {TMAX} / CAST(0.1 AS DOUBLE), k / CAST({n} AS DOUBLE)) - 0.1 AS t_lo,
         CASE WHEN k < {n - 1} THEN 0.1 * pow(1 + {TMAX} / CAST(0.1 AS DOUBLE), (k + 1) / CAST({n} AS DOUBLE)) - 0.1 END
           AS t_hi,
         1 + CAST(0.1 AS DOUBLE) * ((candidate_id + k) % 5) AS "lambda"
  FROM (SELECT *, CAST(unnest(range(0, {n})) AS INTEGER) AS k FROM candidates)
)"""


def timed_sql(source: str = "cells", name: str = "timed") -> str:
    return f""",
{name} AS (
  SELECT *, CASE WHEN t_hi IS NULL THEN t_lo + 1 / "lambda"
       ELSE (1 + "lambda" * t_lo - exp(-"lambda" * (t_hi - t_lo)) * (1 + "lambda" * t_hi))
            / ("lambda" * (1 - exp(-"lambda" * (t_hi - t_lo)))) END AS t_mean
  FROM {source}
)"""


GRID = q.CANDIDATES + cells_sql(N)
TIMED = GRID + timed_sql()


def transitions_sql(source: str, keys: str, rho: str) -> str:
    """Pairwise sums over earlier cells, written out without the fold used in Spark."""
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    own = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f""",
haz AS (
  SELECT *, {rho} AS r, coalesce(sum("lambda" * (t_hi - t_lo)) OVER (PARTITION BY {keys} ORDER BY k
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h,
         CASE WHEN t_hi IS NULL THEN 1 / "lambda" ELSE (1 - exp(-2 * "lambda" * (t_hi - t_lo))) / "lambda" END AS w,
         t_hi - t_lo AS width
  FROM {source}
),
origin AS (
  SELECT {own}, x.k, any_value(x.h + x."lambda" * (x.t_mean - x.t_lo)) AS hm,
         any_value((1 - exp(-2 * x.r * x.t_mean)) / (2 * x.t_mean)) AS base,
         coalesce(sum(y.w * exp(-2 * (x.h + x."lambda" * (x.t_mean - x.t_lo) - (y.h + y."lambda" * y.width)))), 0)
           + any_value((1 - exp(-2 * x."lambda" * (x.t_mean - x.t_lo))) / x."lambda") AS above
  FROM haz x LEFT JOIN haz y ON {on} AND y.k < x.k GROUP BY {own}, x.k
),
target AS (
  SELECT {own}, x.k, any_value(x.h) AS h, any_value(x."lambda") AS "lambda",
         any_value(CASE WHEN x.t_hi IS NULL THEN 1 ELSE 1 - exp(-x."lambda" * x.width) END) AS leaves,
         any_value(x."lambda") * (coalesce(sum(y.w * exp(-2 * (x.h - (y.h + y."lambda" * y.width)))), 0)
           * any_value(x.w) / 2 + any_value(CASE WHEN (x.width - x.w / 2) / x."lambda" < 0
             THEN x.width * x.width ELSE (x.width - x.w / 2) / x."lambda" END)) AS down
  FROM haz x LEFT JOIN haz y ON {on} AND y.k < x.k GROUP BY {own}, x.k
),
off AS (
  SELECT {own}, x.k AS k_from, y.k AS k_to,
         CASE WHEN y.k > x.k THEN x.base * exp(-(y.h - x.hm)) * y.leaves * x.above
              WHEN y.k < x.k THEN x.base * y.down ELSE 0 END AS p
  FROM origin x JOIN target y ON {on}
),
time_trans AS (
  SELECT {keys}, k_from, k_to, CASE WHEN k_from = k_to
         THEN 1 - sum(p) OVER (PARTITION BY {keys}, k_from) ELSE p END AS p FROM off
)"""


def _scales(name: str, column: str, values) -> str:
    rows = ", ".join(f"({i}, CAST({v} AS DOUBLE))" for i, v in enumerate(values))
    return f""",
{name} AS (SELECT * FROM (VALUES {rows}) AS t({column}, scale))"""


PARAMS = """
params AS (
  SELECT p_partkey AS candidate_id, unnest(['theta', 'rho', 'rho.alpha', 'r_ii', 'y0', 'y0_prime', 'y1',
         'y1_prime', 'l0']) AS name,
         unnest([(p_size + 1) * CAST(0.001 AS DOUBLE), (p_size + 1) * CAST(0.0005 AS DOUBLE),
         p_size / 20, 1 - p_size * CAST(0.0001 AS DOUBLE), p_retailprice / 1000, p_size / 100,
         p_retailprice / 2000, p_size / 200, 1 + p_size / 10]) AS value FROM part
)"""

FITS = """
fits AS (
  SELECT run, knots, status, loglik, knots + 3 AS free, 2 * (knots + 3) - 2 * loglik AS aic FROM (
    SELECT o_custkey AS run, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS knots,
           {status} AS status, max(-o_totalprice / 1000) AS loglik
    FROM orders GROUP BY 1, 2, 3)
)"""

SIZES = """
sizes AS (SELECT p_partkey AS candidate_id, CAST(p_size % 8 + 1 AS INTEGER) AS n FROM part)"""

SPAN = (N + N_KNOTS) // (N_KNOTS + 1)

ORACLES = {
    "time_grid": q.query(GRID, f"""
        SELECT candidate_id, k, round(t_lo, {DIGITS}) AS t_lo, round(t_hi, {DIGITS}) AS t_hi FROM cells"""),
    "mean_times": q.query(TIMED, f"SELECT candidate_id, k, round(t_mean, {DIGITS}) AS t_mean FROM timed"),
    "interval_lookup": q.query(GRID, f"""
        SELECT l.l_partkey AS candidate_id, l.l_orderkey, l.l_linenumber,
               round(l.l_quantity / 2.5, {DIGITS}) AS value, c.k, round(c.t_lo, {DIGITS}) AS t_lo,
               round(coalesce(c.t_hi, -1), {DIGITS}) AS t_hi
        FROM lineitem l JOIN cells c ON c.candidate_id = l.l_partkey
             AND c.t_lo <= l.l_quantity / 2.5 AND l.l_quantity / 2.5 < coalesce(c.t_hi, 1e300)"""),
    "spline_rates": q.query(GRID, f""",
        knots AS (
          SELECT p_partkey AS candidate_id, i, CAST(0.1 AS DOUBLE) + ((p_size + i * 3) % 7) / 2 AS height,
                 CAST(0.01 AS DOUBLE) * ((p_size + i) % 3) AS slope,
                 CASE i WHEN 0 THEN 0 WHEN {N_KNOTS + 1} THEN {N - 1} ELSE i * {SPAN} - 1 END AS knot_at
          FROM part, range(0, {N_KNOTS + 2}) r(i)),
        segs AS (
          SELECT a.candidate_id, a.knot_at AS k0, b.knot_at AS k1, a.height AS y0, b.height AS y1, a.slope AS m0,
                 b.slope AS m1, x0.t_lo AS x0, x1.t_lo - x0.t_lo AS w
          FROM knots a JOIN knots b ON a.candidate_id = b.candidate_id AND b.i = a.i + 1
          JOIN cells x0 ON x0.candidate_id = a.candidate_id AND x0.k = a.knot_at
          JOIN cells x1 ON x1.candidate_id = a.candidate_id AND x1.k = b.knot_at)
        SELECT candidate_id, k, round(greatest(0.01, y0 * (1 + 2 * x) * (1 - x) * (1 - x)
               + w * m0 * x * (1 - x) * (1 - x) + y1 * x * x * (3 - 2 * x) + w * m1 * x * x * (x - 1)),
               {DIGITS}) AS "lambda"
        FROM (SELECT c.candidate_id, c.k, s.*, (c.t_lo - s.x0) / s.w AS x FROM cells c JOIN segs s
              ON s.candidate_id = c.candidate_id AND c.k >= s.k0 AND (c.k < s.k1 OR c.k = {N - 1} AND s.k1 = c.k))"""),
    "scale_demography": q.query(GRID, """
        SELECT candidate_id, k AS time_index, round(t_lo * theta / 2, 8) AS left_time_boundary,
               round(t_hi * theta / 2, 8) AS right_time_boundary, round("lambda" * 2 / theta, 8) AS "lambda"
        FROM cells"""),
    "scale_rates_by_ne": q.query(GRID + _scales("cats", "c_ne", NE_SCALES), f"""
        SELECT candidate_id, CAST(c_ne AS INTEGER) AS c_ne, k, round("lambda" / scale, {DIGITS}) AS "lambda"
        FROM cells, cats"""),
    "rate_categories": q.query(EQUAL_CLASSES, """
        SELECT p_partkey AS candidate_id, cat, round(scale, 8) AS scale, round(prob, 8) AS prob
        FROM part JOIN equal ON size = p_size""", recursive=True),
    "rate_categories_by_form": q.query(EQUAL_CLASSES + FIXED_CLASSES + """,
        forms AS (
          SELECT 'bounds' AS form, p_partkey AS candidate_id, cat, scale, prob FROM part JOIN bounded ON size = p_size
          UNION ALL SELECT 'maximum', p_partkey, cat, scale, prob FROM part JOIN even ON size = p_size
          UNION ALL SELECT 'hotspot', p_partkey, 0, 1, 0.5 FROM part
          UNION ALL SELECT 'hotspot', p_partkey, 1, p_retailprice / 10, 0.5 FROM part
          UNION ALL SELECT 'mixed', p_partkey, 0, p_retailprice / 10, NULL FROM part
          UNION ALL SELECT 'mixed', p_partkey, cat + 1, scale, prob FROM part JOIN equal ON size = p_size)""", """
        SELECT form, candidate_id, cat, round(scale, 8) AS scale, round(prob, 8) AS prob FROM forms""", recursive=True),
    "category_transitions": q.query("""
        cats AS (SELECT p_partkey AS candidate_id, 1 - p_size * CAST(0.0001 AS DOUBLE) AS stay FROM part)""", f"""
        SELECT candidate_id, CAST(a AS INTEGER) AS cat_from, CAST(b AS INTEGER) AS cat_to,
               round(CASE WHEN a = b THEN stay ELSE (1 - stay) / 3 END, {DIGITS}) AS p
        FROM cats, range(0, 4) x(a), range(0, 4) y(b)"""),
    "state_product": q.query(q.CANDIDATES, f"""
        SELECT candidate_id, CAST(s AS INTEGER) AS s, CAST(s // 12 AS INTEGER) AS k,
               CAST(s // 6 % 2 AS INTEGER) AS c_theta, CAST(s // 2 % 3 AS INTEGER) AS c_rho,
               CAST(s % 2 AS INTEGER) AS c_ne
        FROM candidates, range(0, {N * 12}) r(s)"""),
    "transition_codes": q.query(SIZES, """
        SELECT candidate_id, CAST(a * (n + 1) + b AS INTEGER) AS code, CAST(a AS INTEGER) AS k_from,
               CAST(b AS INTEGER) AS k_to
        FROM (SELECT *, unnest(range(0, n + 1)) AS b FROM (SELECT *, unnest(range(0, n + 1)) AS a FROM sizes))"""),
    "emission_codes": q.query(SIZES, """
        SELECT candidate_id, CAST(a * 3 + b AS INTEGER) AS code, CAST(a AS INTEGER) AS k,
               CAST(b AS INTEGER) AS obs
        FROM (SELECT *, unnest(range(0, 3)) AS b FROM (SELECT *, unnest(range(0, n)) AS a FROM sizes))"""),
    "time_transitions": q.query(TIMED + transitions_sql("timed", "candidate_id", "rho"), f"""
        SELECT candidate_id, k_from, k_to, round(p, {DIGITS}) AS p FROM time_trans"""),
    "state_transitions": q.query(
        TIMED + _scales("cats", "c", RHO_SCALES) + """,
        scaled AS (SELECT timed.*, c, rho * scale AS scaled_rho FROM timed, cats)"""
        + transitions_sql("scaled", "candidate_id, c", "scaled_rho"), f"""
        SELECT t.candidate_id, CAST(k_from * 3 + t.c AS INTEGER) AS s_from,
               CAST(k_to * 3 + x.c AS INTEGER) AS s_to,
               round(p * CASE WHEN t.c = x.c THEN 1 - p_size * CAST(0.0001 AS DOUBLE)
                     ELSE p_size * CAST(0.0001 AS DOUBLE) / 2 END, {DIGITS}) AS p
        FROM time_trans t JOIN part ON p_partkey = t.candidate_id, cats x"""),
    "emissions": q.query(TIMED, f""",
        same AS (SELECT candidate_id, k, (exp(-theta * t_lo) - exp(-theta * coalesce(t_hi, 2 * t_mean)))
                 / (theta * (coalesce(t_hi, 2 * t_mean) - t_lo)) AS s FROM timed)
        SELECT candidate_id, k, CAST(o AS INTEGER) AS obs,
               round(CASE o WHEN 0 THEN s WHEN 1 THEN 1 - s ELSE 1 END, {DIGITS}) AS p
        FROM same, range(0, 3) r(o)"""),
    "symbol_emissions": q.query(TIMED + _scales("cats", "cat", RHO_SCALES), f""",
        same AS (SELECT candidate_id, cat, k,
                 (exp(-theta * scale * t_lo) - exp(-theta * scale * coalesce(t_hi, 2 * t_mean)))
                 / (theta * scale * (coalesce(t_hi, 2 * t_mean) - t_lo)) AS s FROM timed, cats)
        SELECT candidate_id, CAST(cat AS INTEGER) AS cat, CAST(k * 3 + o AS INTEGER) AS symbol,
               round(CASE o WHEN 0 THEN s WHEN 1 THEN 1 - s ELSE 1 END, {DIGITS}) AS p
        FROM same, range(0, 3) r(o)
        UNION ALL
        SELECT candidate_id, CAST(cat AS INTEGER), CAST({N} * 3 + o AS INTEGER), 1.0
        FROM candidates, cats, range(0, 3) r(o)"""),
    "select_parameters": q.query(PARAMS, f"""
        SELECT candidate_id, name, round(value, {DIGITS}) AS value FROM params
        WHERE name IN ('theta', 'rho', 'rho.alpha', 'y0', 'y1')"""),
    "update_params": q.query(PARAMS, """
        SELECT p.candidate_id, p.name, round(coalesce(n.value, p.value), 9) AS value FROM params p
        LEFT JOIN (SELECT l_partkey, avg(l_discount) AS value FROM lineitem GROUP BY 1) n
        ON n.l_partkey = p.candidate_id AND p.name = 'theta'"""),
    "boundary_guard": q.query(PARAMS, f""",
        reached AS (
          SELECT *, min(value) OVER (PARTITION BY name) AS lower, max(value) OVER (PARTITION BY name) AS upper,
                 (1 + abs(value)) * 0.001 + 0.0005 AS reach FROM params)
        SELECT candidate_id, name, round(value, {DIGITS}) AS value, round(lower, {DIGITS}) AS lower,
               round(upper, {DIGITS}) AS upper, value - reach >= lower AND value + reach <= upper AS kept,
               CASE WHEN value - reach < lower THEN 'too close to lower'
                    WHEN value + reach > upper THEN 'too close to upper' END AS reason FROM reached"""),
    "resume_sweep": q.query(q.CANDIDATES, """
        SELECT candidate_id FROM candidates WHERE candidate_id NOT IN (
          SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O')"""),
    "best_model": q.query(FITS.format(status="1"), """
        SELECT run, knots, round(loglik, 6) AS loglik, free, round(aic, 6) AS aic FROM (
          SELECT *, row_number() OVER (PARTITION BY run ORDER BY aic, knots) AS rn FROM fits) WHERE rn = 1"""),
    "publish_best": q.query(FITS.format(status="o_orderstatus"), """,
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, status ORDER BY aic, knots)
                 AS rn FROM fits WHERE status IN ('O', 'F')) WHERE rn = 1)
        SELECT run, knots, round(loglik, 6) AS loglik, round(aic, 6) AS aic, status = 'O' AS replaced
        FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY aic, status) AS pick FROM best)
        WHERE pick = 1"""),
    "matrix_distance": q.query("""
        mats AS (SELECT l_suppkey AS matrix_id, l_linenumber AS i, CAST(l_quantity AS INTEGER) AS j,
                 avg(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2, 3)""", """
        SELECT matrix_id, round(sum(pow(ln(p) - ln(t), 2)), 6) AS dist
        FROM (SELECT *, avg(p) OVER (PARTITION BY i, j) AS t FROM mats) GROUP BY 1"""),
    "convergence_step": q.query(q.STEPS, """
        SELECT run, min(step) FILTER (step > 3 AND abs((value - prev) / nullif(prev, 0)) < 0.05) AS converged_at
        FROM (SELECT *, lag(value) OVER (PARTITION BY run ORDER BY step) AS prev FROM optimiser_log)
        GROUP BY run"""),
    "convergence_by_parameter": q.query(q.STEPS, """
        SELECT run, min(step) FILTER (abs((value - prev) / CASE WHEN prev = 0 THEN 1e-6 ELSE prev END) < 0.05)
               AS converged_at
        FROM (SELECT *, lag(value) OVER (PARTITION BY run ORDER BY step) AS prev FROM optimiser_log)
        GROUP BY run"""),
    "span_weighted_mean": q.query(q.STEPS, """
        SELECT user_id AS sequence, round(sum(value * span) / sum(span), 8) AS mean_value
        FROM (SELECT *, lead(micro) OVER (PARTITION BY user_id ORDER BY micro) - micro AS span FROM micros)
        WHERE span IS NOT NULL GROUP BY user_id"""),
    "time_weighted_size": q.query(q.STEPS, """
        SELECT user_id AS sequence, round(sum(span) / sum(span / (value + 1)), 8) AS harmonic_size,
               round(sum(span / (value + 1)) / sum(span), 8) AS scale_to_mean
        FROM (SELECT *, coalesce(lead(micro) OVER (PARTITION BY user_id ORDER BY micro), 2592000000000) - micro AS span
              FROM micros) GROUP BY user_id"""),
}
