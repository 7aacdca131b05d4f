"""Queries over models with several modulated rates; candidates come from supplier and nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from locuswise import bindings as b
from locuswise.catalog import hmm
from locuswise.catalog import sql as q
from locuswise.catalog.maps import rounded
from locuswise.catalog.models import DIGITS, TMAX, cells_sql, timed_sql, transitions_sql
from locuswise.operators import grid, modulated, scoring

CELLS = 4
SCORED_CELLS = 3


def timed(candidates, n):
    """Grid of every candidate with rates that differ by cell."""
    rate = F.lit(1.0) + F.lit(0.1) * ((F.col("candidate_id") + F.col("k")) % 5)
    return grid.mean_times(grid.time_grid(candidates, n, tmax=float(TMAX)).withColumn("lambda", rate))


def suppliers(spark, sf):
    """Parameters of all three rates per supplier."""
    nation, key = F.col("s_nationkey"), F.col("s_suppkey")
    theta = (nation + 1) * F.lit(0.001)
    return b.table(spark, sf, "supplier").select(
        key.alias("candidate_id"),
        theta.alias("theta"),
        (theta / 2).alias("rho"),
        (F.lit(5.0) + key % 7).alias("theta_heat"),
        F.lit(0.001).alias("theta_to_hot"),
        F.lit(0.05).alias("theta_to_background"),
        F.lit(1.0).alias("rho_alpha"),
        (F.lit(10.0) + key % 5).alias("rho_heat"),
        F.lit(0.05).alias("rho_leave_hot"),
        (F.lit(0.001) * (nation % 3 + 1)).alias("rho_leave_background"),
        F.lit(0.2).alias("rho_share_hot"),
        F.lit(1.0).alias("ne_alpha"),
        F.lit(0.999).alias("ne_stay"),
    )


def supplier_rates(spark, sf):
    """Theta with hotspots, rho with a hot and two gamma categories, two population sizes."""
    found = suppliers(spark, sf)
    return (
        timed(found.select("candidate_id", "theta", "rho"), CELLS),
        modulated.modulation(found, "theta", "Hotspot"),
        modulated.modulation(found, "rho", "Gamma+Hotspot", 2),
        modulated.modulation(found, "ne", "Gamma", 2),
    )


def nations(spark, sf):
    """Two modulated rates per nation."""
    key = F.col("n_nationkey")
    theta = (key + 1) * F.lit(0.005)
    return b.table(spark, sf, "nation").select(
        key.cast("long").alias("candidate_id"),
        theta.alias("theta"),
        (theta / 2).alias("rho"),
        (F.lit(5.0) + key % 7).alias("theta_heat"),
        F.lit(0.01).alias("theta_to_hot"),
        F.lit(0.05).alias("theta_to_background"),
        (F.lit(10.0) + key % 5).alias("rho_heat"),
        F.lit(0.02).alias("rho_to_hot"),
        F.lit(0.1).alias("rho_to_background"),
    )


def scored_models(spark, sf):
    """Every event sequence scored with models in which theta and rho have hotspots."""
    found = nations(spark, sf)
    models = modulated.modulated_models(
        timed(found.select("candidate_id", "theta", "rho"), SCORED_CELLS),
        modulated.modulation(found, "theta", "Hotspot"),
        modulated.modulation(found, "rho", "Hotspot"),
        modulated.constant(found, "ne"),
    )
    runs, blocks = hmm.inputs(spark, sf)
    return scoring.forward_loglik(runs, blocks, models, hmm.FRAGMENT)


QUERIES = {
    "modulated_transitions": lambda s, d: rounded(modulated.modulated_transitions(*supplier_rates(s, d)), "p"),
    "modulated_emissions": lambda s, d: rounded(modulated.modulated_emissions(*supplier_rates(s, d)), "p"),
    "modulated_loglik": lambda s, d: rounded(scored_models(s, d), "loglik", digits=6),
}

# the classes of a gamma of shape one have closed means: 1 - ln 2 and 1 + ln 2
SUPPLIERS = """
candidates AS (
  SELECT s_suppkey AS candidate_id, (s_nationkey + 1) * CAST(0.001 AS DOUBLE) AS theta,
         (s_nationkey + 1) * CAST(0.001 AS DOUBLE) / 2 AS rho, 5 + s_suppkey % 7 AS theta_heat,
         10 + s_suppkey % 5 AS rho_heat, CAST(0.001 AS DOUBLE) * (s_nationkey % 3 + 1) AS cools
  FROM supplier
)""" + cells_sql(CELLS) + timed_sql() + """,
sized AS (
  SELECT * REPLACE ("lambda" / (CASE c_ne WHEN 0 THEN 1 - ln(2) ELSE 1 + ln(2) END) AS "lambda")
  FROM cells, (VALUES (0), (1)) t(c_ne)
)""" + timed_sql("sized", "timed_sizes") + """,
scaled AS (
  SELECT *, rho * CASE c_rho WHEN 0 THEN rho_heat WHEN 1 THEN 1 - ln(2) ELSE 1 + ln(2) END AS scaled_rho
  FROM timed_sizes, (VALUES (0), (1), (2)) t(c_rho)
)"""

NATIONS = """
candidates AS (
  SELECT CAST(n_nationkey AS BIGINT) AS candidate_id, (n_nationkey + 1) * CAST(0.005 AS DOUBLE) AS theta,
         (n_nationkey + 1) * CAST(0.005 AS DOUBLE) / 2 AS rho, 5 + n_nationkey % 7 AS theta_heat,
         10 + n_nationkey % 5 AS rho_heat
  FROM nation
)""" + cells_sql(SCORED_CELLS) + timed_sql() + """,
scaled AS (
  SELECT *, rho * CASE c_rho WHEN 0 THEN 1 ELSE rho_heat END AS scaled_rho
  FROM timed, (VALUES (0), (1)) t(c_rho)
)"""


def _hotspots(name: str, to_hot: float, to_background: float) -> str:
    a, z = (f"CAST({p} AS DOUBLE)" for p in (to_hot, to_background))
    return f""",
{name}(a, b, p) AS (VALUES (0, 0, 1 - {a}), (0, 1, {a}), (1, 0, {z}), (1, 1, 1 - {z}))"""


def _theta_emissions(rest: int) -> str:
    return f""",
same AS (
  SELECT candidate_id, k, c, (exp(-th * t_lo) - exp(-th * coalesce(t_hi, 2 * t_mean)))
         / (th * (coalesce(t_hi, 2 * t_mean) - t_lo)) AS same
  FROM (SELECT *, theta * CASE c WHEN 0 THEN 1 ELSE theta_heat END AS th FROM timed, (VALUES (0), (1)) t(c))),
emis AS (
  SELECT candidate_id, CAST((k * 2 + c) * {rest} + r AS INTEGER) AS s, CAST(o AS INTEGER) AS obs,
         CASE o WHEN 0 THEN same WHEN 1 THEN 1 - same ELSE 1 END AS p
  FROM same, range(0, {rest}) x(r), range(0, 3) y(o))"""


STATES = SCORED_CELLS * 4

ORACLES = {
    "modulated_transitions": q.query(
        SUPPLIERS + transitions_sql("scaled", "candidate_id, c_rho, c_ne", "scaled_rho")
        + _hotspots("theta_moves", 0.001, 0.05), f"""
        SELECT t.candidate_id, CAST(((k_from * 2 + m.a) * 3 + t.c_rho) * 2 + t.c_ne AS INTEGER) AS s_from,
               CAST(((k_to * 2 + m.b) * 3 + r.c) * 2 + n.c AS INTEGER) AS s_to,
               round(t.p * m.p * CASE WHEN t.c_ne = n.c THEN CAST(0.999 AS DOUBLE) ELSE 1 - CAST(0.999 AS DOUBLE) END
               * CASE WHEN t.c_rho = 0 AND r.c = 0 THEN CAST(0.95 AS DOUBLE) WHEN t.c_rho = 0 THEN CAST(0.025 AS DOUBLE)
                      WHEN r.c = 0 THEN CAST(0.2 AS DOUBLE) * cools WHEN t.c_rho = r.c THEN 1 - cools
                      ELSE CAST(0.8 AS DOUBLE) * cools END, {DIGITS}) AS p
        FROM time_trans t JOIN candidates USING (candidate_id), theta_moves m,
             (VALUES (0), (1), (2)) r(c), (VALUES (0), (1)) n(c)"""),
    "modulated_emissions": q.query(SUPPLIERS + _theta_emissions(6), f"""
        SELECT candidate_id, s, obs, round(p, {DIGITS}) AS p FROM emis"""),
    "modulated_loglik": q.query(
        # the grid's names go before those of the event sequences
        NATIONS + transitions_sql("scaled", "candidate_id, c_rho", "scaled_rho") + _theta_emissions(2)
        + _hotspots("theta_moves", 0.01, 0.05) + _hotspots("rho_moves", 0.02, 0.1) + f""",
        trans AS (
          SELECT t.candidate_id, (k_from * 2 + m.a) * 2 + c_rho AS s_from, (k_to * 2 + m.b) * 2 + r.b AS s_to,
                 t.p * m.p * r.p AS p
          FROM time_trans t, theta_moves m, rho_moves r WHERE r.a = t.c_rho),
        matrix AS (
          SELECT candidate_id, list(into_state ORDER BY s_to) AS columns FROM (
            SELECT candidate_id, s_to, list(p ORDER BY s_from) AS into_state FROM trans GROUP BY 1, 2) GROUP BY 1),
        seen AS (SELECT candidate_id, obs AS state, list(p ORDER BY s) AS e FROM emis GROUP BY 1, 2),
        """ + q.DENSE.strip() + f""",
        fwd AS (
          SELECT candidate_id, diploid, block_id, pos, list_transform(e, lambda x: x / list_sum(e)) AS a,
                 ln(list_sum(e) / {STATES}) AS ll
          FROM dense JOIN seen USING (state) WHERE pos = 1
          UNION ALL
          SELECT candidate_id, diploid, block_id, pos, list_transform(v, lambda x: x / list_sum(v)), ll + ln(list_sum(v)) FROM (
            SELECT f.candidate_id, f.diploid, f.block_id, d.pos, f.ll,
                   list_transform(m.columns, lambda col, i: list_dot_product(f.a, col) * s.e[i]) AS v
            FROM fwd f JOIN dense d ON d.diploid = f.diploid AND d.block_id = f.block_id AND d.pos = f.pos + 1
            JOIN seen s ON s.candidate_id = f.candidate_id AND s.state = d.state
            JOIN matrix m ON m.candidate_id = f.candidate_id))""", """
        SELECT candidate_id, diploid, block_id, round(ll, 6) AS loglik FROM fwd WHERE pos = 240""", recursive=True),
}
