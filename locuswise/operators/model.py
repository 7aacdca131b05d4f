"""Hidden-state tables, transition and emission probabilities per candidate model.

Every table is keyed by ``candidate_id``; a model's size (cells x categories) does not grow with
the data, so expanding its cells inside a row is bounded by the model.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuswise.functions.gamma import gamma_category_means

# fixed values: default category transition probabilities
GAMMA_STAY = 1 - 1e-5
BACKGROUND_TO_HOT = 2e-6
HOT_TO_BACKGROUND = 5e-4

CATEGORY_SCHEMA = "candidate_id long, cat int, scale double, prob double"


def rate_categories(
    candidates: DataFrame,
    model: str,
    n: int = 1,
    bounds: Sequence[float] | None = None,
    maximum: float | None = None,
) -> DataFrame:
    """Scale and prior share of each rate category.

    ``Gamma`` reads ``alpha`` (mean one), ``Hotspot`` reads ``heat``, ``Gamma+Hotspot`` both, with
    the hot category first. Gamma classes are equally probable unless ``bounds`` or ``maximum`` is set.
    """
    ids = F.col("candidate_id").cast("long")
    if model == "Hotspot":
        pair = F.array(
            F.struct(F.lit(0).alias("cat"), F.lit(1.0).alias("scale"), F.lit(0.5).alias("prob")),
            F.struct(F.lit(1).alias("cat"), F.col("heat").alias("scale"), F.lit(0.5).alias("prob")),
        )
        return candidates.select(ids.alias("candidate_id"), F.explode(pair).alias("c")).select(
            "candidate_id", "c.*"
        )
    if model not in ("Gamma", "Gamma+Hotspot"):
        raise ValueError(f"unknown rate model {model!r}")
    if maximum is not None:
        bounds = [maximum * i / n for i in range(n + 1)]
    hot = model == "Gamma+Hotspot"

    def discretise(batches):
        for batch in batches:
            means, probs = gamma_category_means(batch["alpha"].to_numpy(float), n, bounds)
            if hot:
                means = np.column_stack([batch["heat"].to_numpy(float), means])
                probs = np.column_stack([np.full(len(batch), np.nan), probs])
            width = means.shape[1]
            yield pd.DataFrame(
                {
                    "candidate_id": np.repeat(batch["candidate_id"].to_numpy(), width),
                    "cat": np.tile(np.arange(width, dtype=np.int32), len(batch)),
                    "scale": means.ravel(),
                    "prob": probs.ravel(),
                }
            )

    needed = ["alpha", "heat"] if hot else ["alpha"]
    out = candidates.select(ids.alias("candidate_id"), *needed).mapInPandas(discretise, CATEGORY_SCHEMA)
    return out.withColumn("prob", F.nanvl("prob", F.lit(None).cast("double")))


def category_transitions(candidates: DataFrame, model: str, n: int) -> DataFrame:
    """(candidate_id, cat_from, cat_to, p). Missing parameter columns take the defaults.

    Gamma: ``stay``. Hotspot: ``to_hot``, ``to_background``. Gamma+Hotspot (category 0 hot):
    ``leave_hot``, ``leave_background``, ``share_hot``.
    """

    def param(name: str, default: float | None) -> Column:
        if name in candidates.columns:
            return F.col(name)
        if default is None:
            raise ValueError(f"{model} needs column {name}")
        return F.lit(default)

    a, b = F.col("cat_from"), F.col("cat_to")
    if model == "Gamma":
        stay = param("stay", GAMMA_STAY)
        p = F.when(a == b, stay if n > 1 else F.lit(1.0)).otherwise(
            (F.lit(1.0) - stay) / F.lit(max(n - 1, 1))
        )
    elif model == "Hotspot":
        n = 2
        to_hot = param("to_hot", BACKGROUND_TO_HOT)
        to_background = param("to_background", HOT_TO_BACKGROUND)
        p = (
            F.when((a == 0) & (b == 0), F.lit(1.0) - to_hot)
            .when(a == 0, to_hot)
            .when(b == 0, to_background)
            .otherwise(F.lit(1.0) - to_background)
        )
    elif model == "Gamma+Hotspot":
        leave_hot = param("leave_hot", None)
        leave = param("leave_background", None)
        share = param("share_hot", None)
        p = (
            F.when((a == 0) & (b == 0), F.lit(1.0) - leave_hot)
            .when(a == 0, leave_hot / F.lit(n - 1))
            .when(b == 0, share * leave)
            .when(a == b, F.lit(1.0) - leave)
            .otherwise((F.lit(1.0) - share) * leave / F.lit(max(n - 2, 1)))
        )
    else:
        raise ValueError(f"unknown rate model {model!r}")
    index = F.sequence(F.lit(0), F.lit(n - 1))
    return (
        candidates.withColumn("cat_from", F.explode(index))
        .withColumn("cat_to", F.explode(index))
        .select("candidate_id", "cat_from", "cat_to", p.cast("double").alias("p"))
    )


def state_product(
    candidates: DataFrame, n_time: int, n_theta: int = 1, n_rho: int = 1, n_ne: int = 1
) -> DataFrame:
    """All (time, theta, rho, Ne) combinations; the last category varies fastest."""
    total = n_time * n_theta * n_rho * n_ne
    s = F.col("s")
    return (
        candidates.select("candidate_id", F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("s"))
        .withColumn("k", F.floor(s / (n_theta * n_rho * n_ne)).cast("int"))
        .withColumn("c_theta", (F.floor(s / (n_rho * n_ne)) % n_theta).cast("int"))
        .withColumn("c_rho", (F.floor(s / n_ne) % n_rho).cast("int"))
        .withColumn("c_ne", (s % n_ne).cast("int"))
    )


def modulated_rates(n_theta: int, n_rho: int, n_ne: int) -> int:
    return sum(size > 1 for size in (n_theta, n_rho, n_ne))


def transition_codes(sizes: DataFrame, missing: bool = False) -> DataFrame:
    """(candidate_id, code, k_from, k_to) with code = k_from * n + k_to for models of ``n`` cells."""
    n = F.col("n") + (1 if missing else 0)
    index = F.sequence(F.lit(0), n - 1)
    return (
        sizes.withColumn("k_from", F.explode(index))
        .withColumn("k_to", F.explode(index))
        .select("candidate_id", (F.col("k_from") * n + F.col("k_to")).alias("code"), "k_from", "k_to")
    )


def emission_codes(sizes: DataFrame, n_obs: int = 3, missing: bool = False) -> DataFrame:
    """(candidate_id, code, k, obs) with code = k * n_obs + obs."""
    n = F.col("n") + (1 if missing else 0)
    return (
        sizes.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("obs", F.explode(F.sequence(F.lit(0), F.lit(n_obs - 1))))
        .select("candidate_id", (F.col("k") * n_obs + F.col("obs")).alias("code"), "k", "obs")
    )


def time_transitions(grid: DataFrame, keys: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """Probability of moving between time cells, for the ``rho`` carried on each grid row.

    Expects ``k, t_lo, t_hi, lambda, t_mean, rho``. The hazard up to each cell and the discounted
    sum over earlier cells are folded along the cell array once per model; the discounted form
    cannot overflow however large the hazard gets.
    """
    keys = list(keys)
    cell = F.struct(
        F.col("k"),
        F.col("t_lo").alias("lo"),
        F.col("t_hi").alias("hi"),
        F.col("lambda").alias("rate"),
        F.col("t_mean").alias("mean"),
    )
    models = grid.groupBy(*keys).agg(
        F.array_sort(F.collect_list(cell)).alias("cells"), F.first("rho").alias("rho")
    )
    one, zero = F.lit(1.0), F.lit(0.0)

    def hazard(c):
        return F.coalesce(c["rate"] * (c["hi"] - c["lo"]), F.lit(float("inf")))

    def weight(c):
        return (one - F.exp(-2.0 * hazard(c))) / c["rate"]

    profile = "array<struct<h:double,d:double>>"
    start = F.struct(
        zero.alias("h"), zero.alias("d"), F.expr(f"cast(array() as {profile})").alias("seen")
    )

    def step(acc, c):
        here = F.struct(acc["h"].alias("h"), acc["d"].alias("d"))
        return F.struct(
            (acc["h"] + hazard(c)).alias("h"),
            (acc["d"] * F.exp(-2.0 * hazard(c)) + weight(c)).alias("d"),
            F.concat(acc["seen"], F.array(here)).alias("seen"),
        )

    folded = models.withColumn("seen", F.aggregate("cells", start, step, lambda acc: acc["seen"]))
    origins = folded.select(
        *keys, "rho", "cells", "seen", F.posexplode("cells").alias("k_from", "o")
    )
    mean, rate, low = F.col("o.mean"), F.col("o.rate"), F.col("o.lo")
    since = rate * (mean - low)
    h_mean = F.col("seen")[F.col("k_from")]["h"] + since
    base = (one - F.exp(-2.0 * F.col("rho") * mean)) / (2.0 * mean)
    above = F.exp(-2.0 * since) * F.col("seen")[F.col("k_from")]["d"] + (one - F.exp(-2.0 * since)) / rate
    prepared = origins.withColumn("h_mean", h_mean).withColumn("base", base).withColumn("above", above)

    def probability(c, i):
        seen = F.col("seen")[i]
        up = (
            F.col("base")
            * F.exp(-(seen["h"] - F.col("h_mean")))
            * (one - F.exp(-hazard(c)))
            * F.col("above")
        )
        width = c["hi"] - c["lo"]
        own = (width - weight(c) / 2.0) / c["rate"]
        own = F.when(own < 0, width * width).otherwise(own)
        down = F.col("base") * c["rate"] * (seen["d"] * weight(c) / 2.0 + own)
        return F.when(i > F.col("k_from"), up).when(i < F.col("k_from"), down).otherwise(zero)

    off = prepared.withColumn("row", F.transform("cells", probability))
    stay = one - F.aggregate("row", zero, lambda acc, x: acc + x)
    return (
        off.withColumn("stay", stay)
        .select(*keys, "k_from", "stay", F.posexplode("row").alias("k_to", "p"))
        .withColumn("p", F.when(F.col("k_to") == F.col("k_from"), F.col("stay")).otherwise(F.col("p")))
        .drop("stay")
    )


def emissions(grid: DataFrame, theta: Column, keys: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """P(symbol | time cell) for symbols 0, 1 and 2; missing is always certain."""
    upper = F.coalesce(F.col("t_hi"), 2.0 * F.col("t_mean"))
    same = (F.exp(-theta * F.col("t_lo")) - F.exp(-theta * upper)) / (theta * (upper - F.col("t_lo")))
    per_symbol = F.array(F.col("_same"), F.lit(1.0) - F.col("_same"), F.lit(1.0))
    return grid.withColumn("_same", same).select(
        *keys, "k", F.posexplode(per_symbol).alias("obs", "p")
    )


def state_transitions(
    time_trans: DataFrame,
    rho_trans: DataFrame,
    theta_trans: DataFrame,
    ne_trans: DataFrame,
    n_theta: int,
    n_rho: int,
    n_ne: int,
) -> DataFrame:
    """(candidate_id, s_from, s_to, p) over the product states.

    ``time_trans`` is keyed by the rho category of the origin, ``c_rho``. Rows of each factor sum
    to one, hence so do the products.

    The factors meet as arrays in one row per candidate, a few cells each, and that row meets the
    time cells in a hash join by candidate: their sizes before cells are exploded would have them
    taken for small and sent through the driver.
    """
    factors = {"rho": rho_trans, "theta": theta_trans, "ne": ne_trans}
    cells = reduce(
        lambda a, b: a.unionByName(b),
        [
            table.select(
                "candidate_id",
                F.lit(name).alias("_of"),
                F.struct(F.col("cat_from").alias("from"), F.col("cat_to").alias("to"), "p").alias("_cell"),
            )
            for name, table in factors.items()
        ],
    )
    packed = cells.groupBy("candidate_id").agg(
        *[F.collect_list(F.when(F.col("_of") == name, F.col("_cell"))).alias(f"_{name}") for name in factors]
    )

    def pairs(rho, theta, ne):
        sides = {f"{name}_{side}": c[side] for name, c in (("rho", rho), ("theta", theta), ("ne", ne)) for side in ("from", "to", "p")}
        return F.struct(*[c.alias(name) for name, c in sides.items()])

    every = F.flatten(
        F.transform(
            "_rho",
            lambda r: F.flatten(F.transform("_theta", lambda t: F.transform("_ne", lambda n: pairs(r, t, n)))),
        )
    )
    rows = packed.select("candidate_id", every.alias("_cells"))
    here = F.filter("_cells", lambda c: c["rho_from"] == F.col("c_rho"))
    joined = time_trans.join(rows.hint("shuffle_hash"), "candidate_id").withColumn("c", F.explode(here))

    def index(side):
        k = F.col(f"k_{side}")
        return (
            ((k * n_theta + F.col(f"c.theta_{side}")) * n_rho + F.col(f"c.rho_{side}")) * n_ne
            + F.col(f"c.ne_{side}")
        ).cast("int")

    p = F.col("p") * F.col("c.rho_p") * F.col("c.theta_p") * F.col("c.ne_p")
    return joined.select(
        "candidate_id", index("from").alias("s_from"), index("to").alias("s_to"), p.alias("p")
    )


def scaled_grids(grid: DataFrame, categories: DataFrame, rate: str) -> DataFrame:
    """One grid per category of ``rate``, with that rate multiplied by the category scale.

    Neither side goes through the driver, however small the tables look before cells are exploded. Work per byte
    is high in what follows, so the partitions are stated and not merged by their size.
    """
    count = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cats = categories.select("candidate_id", F.col("cat").alias(f"c_{rate}"), F.col("scale").alias("_s"))
    return grid.repartition(count, "candidate_id").join(cats.hint("shuffle_hash"), "candidate_id").withColumn(rate, F.col(rate) * F.col("_s")).drop("_s")


def symbol_emissions(
    grid: DataFrame, categories: DataFrame, rate: str, n: int, n_obs: int = 3, missing: bool = False
) -> DataFrame:
    """(candidate_id, cat, symbol, p) of decoded symbols for the second-level model.

    For ``rho`` the symbol is a pair of successive time cells, for ``theta`` a time cell with the
    observed state. ``missing`` adds a time index n whose symbols have probability one.
    """
    cat = f"c_{rate}"
    scaled = scaled_grids(grid, categories, rate)
    width = n + 1 if missing else n
    if rate == "rho":
        table = time_transitions(scaled, ["candidate_id", cat])
        first, second = F.col("k_from"), F.col("k_to")
        inner, outer = width, width
    else:
        table = emissions(scaled, F.col(rate), ["candidate_id", cat])
        first, second = F.col("k"), F.col("obs")
        inner, outer = n_obs, width
    known = table.select(
        "candidate_id",
        F.col(cat).alias("cat"),
        (first * inner + second).cast("int").alias("symbol"),
        "p",
    )
    if not missing:
        return known
    pairs = [(i, j) for i in range(outer) for j in range(inner)]
    unknown = [i * inner + j for i, j in pairs if i == n or (rate == "rho" and j == n)]
    ones = categories.select(
        "candidate_id",
        "cat",
        F.explode(F.array(*[F.lit(code) for code in unknown])).alias("symbol"),
        F.lit(1.0).alias("p"),
    )
    return known.unionByName(ones)
