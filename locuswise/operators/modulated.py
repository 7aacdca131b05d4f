"""Models whose theta, rho and population size each change between categories along the sequence.

A hidden state is (time cell, theta category, rho category, size category), numbered as in
:func:`locuswise.operators.model.state_product`. What leaves a state depends on the categories it
has: rho and the coalescence rates of the origin move time, theta of the state emits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.operators import grid, model
from locuswise.operators.decoding import StateSpace
from locuswise.operators.scoring import pack_models

RATES = ("theta", "rho", "ne")


@dataclass(frozen=True)
class Modulation:
    """Categories of one rate: ``scales(candidate_id, cat, scale)``, ``moves(candidate_id, cat_from, cat_to, p)``."""

    rate: str
    n: int
    scales: DataFrame
    moves: DataFrame


def _own_parameters(candidates: DataFrame, rate: str) -> DataFrame:
    """Columns ``<rate>_<parameter>`` under the names that the category tables read."""
    start = f"{rate}_"
    own = [F.col(c).alias(c[len(start) :]) for c in candidates.columns if c.startswith(start)]
    return candidates.select("candidate_id", *own)


def modulation(
    candidates: DataFrame,
    rate: str,
    form: str = "Gamma",
    n: int = 1,
    bounds: Sequence[float] | None = None,
    maximum: float | None = None,
) -> Modulation:
    """Scales and moves of ``rate``, from the candidates' columns ``<rate>_<parameter>``.

    ``Gamma`` has ``n`` classes (one: the rate does not change) and reads ``alpha`` and ``stay``;
    ``Hotspot`` has background and hot sites and reads ``heat``, ``to_hot`` and ``to_background``;
    ``Gamma+Hotspot`` puts a hot category before ``n`` classes, at least two, and reads ``alpha``,
    ``heat``, ``leave_hot``, ``leave_background`` and ``share_hot``. ``bounds`` or ``maximum`` set
    the classes as in :func:`locuswise.operators.model.rate_categories`.
    """
    if rate not in RATES:
        raise ValueError(f"unknown rate {rate!r}")
    own = _own_parameters(candidates, rate)
    classes = n if bounds is None else len(bounds) - 1
    if form == "Gamma" and classes == 1:
        scales = own.select("candidate_id", F.lit(0).alias("cat"), F.lit(1.0).alias("scale"))
    else:
        if form == "Gamma+Hotspot" and classes < 2:
            raise ValueError("Gamma+Hotspot needs two or more gamma classes")
        scales = model.rate_categories(own, form, n, bounds, maximum).select("candidate_id", "cat", "scale")
    size = {"Gamma": classes, "Hotspot": 2, "Gamma+Hotspot": classes + 1}[form]
    return Modulation(rate, size, scales, model.category_transitions(own, form, size))


def constant(candidates: DataFrame, rate: str) -> Modulation:
    """A rate that does not change."""
    return modulation(candidates.select("candidate_id"), rate)


def state_space(n_time: int, theta: Modulation, rho: Modulation, ne: Modulation) -> StateSpace:
    return StateSpace(n_time, theta.n, rho.n, ne.n)


def modulated_transitions(timed: DataFrame, theta: Modulation, rho: Modulation, ne: Modulation) -> DataFrame:
    """(candidate_id, s_from, s_to, p). Every row of a model sums to one.

    ``timed(candidate_id, k, t_lo, t_hi, lambda, rho, ...)`` is the grid of the unscaled rates. Each
    (rho, size) category has a grid of its own: rates divided by the size's scale, with the mean
    times that follow from them, and the scaled rho. Its moves in time are joined to the moves of
    the categories on the origin's category.
    """
    sized = grid.mean_times(grid.scale_rates_by_ne(timed, ne.scales))
    moves = model.time_transitions(
        model.scaled_grids(sized, rho.scales, "rho"), ["candidate_id", "c_rho", "c_ne"]
    )
    moves = moves.select(
        "candidate_id", F.col("c_rho").alias("rho_from"), F.col("c_ne").alias("ne_from"), "k_from", "k_to", "p"
    )
    for part in (rho, ne, theta):
        table = part.moves.select(
            "candidate_id",
            F.col("cat_from").alias(f"{part.rate}_from"),
            F.col("cat_to").alias(f"{part.rate}_to"),
            F.col("p").alias("_p"),
        )
        shared = [c for c in ("candidate_id", f"{part.rate}_from") if c in moves.columns]
        moves = moves.join(table, shared).withColumn("p", F.col("p") * F.col("_p")).drop("_p")

    def state(side):
        s = F.col(f"k_{side}")
        for part in (theta, rho, ne):
            s = s * part.n + F.col(f"{part.rate}_{side}")
        return s.cast("int").alias(f"s_{side}")

    return moves.select("candidate_id", state("from"), state("to"), "p")


def modulated_emissions(timed: DataFrame, theta: Modulation, rho: Modulation, ne: Modulation) -> DataFrame:
    """(candidate_id, s, obs, p): the theta category of a state emits, over the grid of the unscaled rates."""
    scaled = model.scaled_grids(timed, theta.scales, "theta")
    table = model.emissions(scaled, F.col("theta"), ["candidate_id", "c_theta"])
    rest = rho.n * ne.n
    first = (F.col("k") * theta.n + F.col("c_theta")) * rest
    return table.withColumn("s", F.explode(F.sequence(first, first + (rest - 1)))).select(
        "candidate_id", F.col("s").cast("int").alias("s"), "obs", "p"
    )


def modulated_models(timed: DataFrame, theta: Modulation, rho: Modulation, ne: Modulation) -> DataFrame:
    """Packed models (candidate_id, trans, emis), ready for scoring and decoding."""
    return pack_models(
        modulated_transitions(timed, theta, rho, ne), modulated_emissions(timed, theta, rho, ne)
    )
