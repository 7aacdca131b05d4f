"""From runs and a fixed model to per-site landscapes: per diploid, joint and averaged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.functions.lineage import settled
from locuswise.operators import joint
from locuswise.operators.bins import average_landscape
from locuswise.operators.decoding import StateSpace, decode_landscape
from locuswise.operators.scoring import FRAGMENT, Model


def decode_diploids(
    runs: DataFrame,
    blocks: DataFrame,
    model: Model,
    space: StateSpace,
    scales: Mapping[str, Sequence[float]],
    bases: Mapping[str, float],
    mean_times: Sequence[float],
    size: int = FRAGMENT,
) -> DataFrame:
    """Posterior mean of every modulated rate and of the coalescence time, plus decoded time."""
    values = {
        rate: np.asarray(scales[rate], float)[space.category_of(rate)] * bases.get(rate, 1.0)
        for rate in scales
    }
    values["tmrca"] = np.asarray(mean_times, float)[space.time_of()]
    return decode_landscape(runs, blocks, model, values, space.time_of(), size)


def long_landscape(wide: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(diploid, block_id, pos, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return wide.select("diploid", "block_id", "pos", F.explode(pairs).alias("m")).select(
        "diploid", "block_id", "pos", "m.*"
    )


def decode_dataset(
    runs: DataFrame,
    blocks: DataFrame,
    model: Model,
    space: StateSpace,
    scales: Mapping[str, Sequence[float]],
    bases: Mapping[str, float],
    mean_times: Sequence[float],
    symbol_emission: DataFrame,
    category_trans: np.ndarray,
    rate: str = "rho",
    size: int = FRAGMENT,
    decoded: DataFrame | None = None,
) -> DataFrame:
    """All landscapes of a sample: each diploid's, ``sample_mean`` and ``joint_decode``.

    (source, diploid, block_id, pos, metric, value). The three outputs share one decoding: ``decoded`` as
    read back from :func:`locuswise.sources.landscapes.write_landscape`, or else one that is written here.
    ``rate`` theta is seen through the observed states, so its symbols pair decoded time and state; any other
    rate through the changes of decoded time.
    """
    wide = decoded
    if wide is None:
        wide = settled(decode_diploids(runs, blocks, model, space, scales, bases, mean_times, size), "decoded")
    metrics = [*scales, "tmrca"]
    each = long_landscape(wide, metrics)
    mean = average_landscape(long_landscape(wide, list(scales)))
    if rate == "theta":
        sites = runs.select("diploid", "block_id", F.explode(F.sequence("start_pos", "end_pos")).alias("pos"), "state")
        symbols = joint.emission_symbols(wide, sites)
    else:
        symbols = joint.transition_symbols(wide, space.n_time)
    factors = joint.site_factors(symbols, symbol_emission, space.size(rate))
    packed = joint.pack_factors(factors, blocks, size)
    together = joint.joint_decode(packed, category_trans, scales[rate], bases.get(rate, 1.0))
    nobody = F.lit(None).cast("long")
    order = ["source", "diploid", "block_id", "pos", "metric", "value"]
    return (
        each.withColumn("source", F.lit("diploid"))
        .select(order)
        .unionByName(
            mean.withColumn("source", F.lit("sample_mean"))
            .withColumn("diploid", nobody)
            .withColumnRenamed("sample_mean", "value")
            .select(order)
        )
        .unionByName(
            together.withColumn("source", F.lit("joint_decode"))
            .withColumn("diploid", nobody)
            .withColumn("metric", F.lit(rate))
            .select(order)
        )
    )
