"""Posterior decoding of fragments and the per-site summaries taken from it.

``posterior(diploid, block_id, pos, p)`` holds the state probabilities as an array in state order,
so every summary below is a projection inside the row: no shuffle, no explode. Large models should
use :func:`decode_landscape`, which summarises inside the task and never ships the posterior.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuswise.functions.kernels import Pieces, RunPowers, run_pieces, smooth
from locuswise.operators.scoring import (
    FRAGMENT,
    Model,
    _lists,
    carry_table,
    join_nulls,
    most_fragments,
    pack_fragments,
)

BATCH_SITES = 4_000_000
BATCH_ROWS = 512


@dataclass(frozen=True)
class StateSpace:
    """Sizes of the four state components; the last varies fastest."""

    n_time: int
    n_theta: int = 1
    n_rho: int = 1
    n_ne: int = 1

    @property
    def per_time(self) -> int:
        return self.n_theta * self.n_rho * self.n_ne

    @property
    def states(self) -> int:
        return self.n_time * self.per_time

    def size(self, rate: str) -> int:
        return {"theta": self.n_theta, "rho": self.n_rho, "ne": self.n_ne}[rate]

    def stride(self, rate: str) -> int:
        return {"theta": self.n_rho * self.n_ne, "rho": self.n_ne, "ne": 1}[rate]

    def time_of(self) -> np.ndarray:
        return np.arange(self.states) // self.per_time

    def category_of(self, rate: str) -> np.ndarray:
        return np.arange(self.states) // self.stride(rate) % self.size(rate)


def _grouped_rows(batch: pa.RecordBatch):
    """Row slices of a record batch whose padded site count stays bounded."""
    sites = batch.column(batch.schema.get_field_index("sites")).to_numpy(zero_copy_only=False)
    first, longest = 0, 0
    for i, n in enumerate(sites):
        longest = max(longest, n)
        if i > first and (longest * (i - first + 1) > BATCH_SITES or i - first >= BATCH_ROWS):
            yield first, i
            first, longest = i, n
    if len(sites):
        yield first, len(sites)


def _symbol_matrix(lengths, symbols, pieces: Pieces) -> np.ndarray:
    """Symbols of the sites, a row per piece."""
    padded = np.zeros((len(pieces.sites), int(pieces.sites.max())), dtype=np.int8)
    known = -1
    for out, row, offset, n in zip(padded, pieces.row, pieces.offset, pieces.sites):
        if row != known:
            known, sites = row, np.repeat(symbols[row], lengths[row])
        out[:n] = sites[offset : offset + n]
    return padded


def _decoder(model: Model, summarise, schema_names):
    trans, by_symbol = model.trans, np.ascontiguousarray(model.emis.T)

    def run(batches):
        powers = RunPowers(trans[None], model.emis[None])
        for batch in batches:
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for lo, hi in _grouped_rows(batch):
                part = {name: col.slice(lo, hi - lo) for name, col in cols.items()}
                lengths, symbols, starts = (_lists(part[name]) for name in ("lengths", "symbols", "start"))
                pieces = Pieces.joined([run_pieces(powers, i, *x) for i, x in enumerate(zip(lengths, symbols, starts))])
                codes = _symbol_matrix(lengths, symbols, pieces)
                keys = [part[k].to_numpy(zero_copy_only=False) for k in ("block_id", "frag_start")]
                diploids = part["diploid"].cast(pa.int64())
                emit = lambda t0, t1: by_symbol[codes[:, t0:t1]]
                for t0, posterior, _ in smooth(emit, pieces.sites, trans, pieces.start, pieces.end):
                    at = t0 + np.arange(posterior.shape[1])
                    inside = at[None, :] < pieces.sites[:, None]
                    piece, col = np.nonzero(inside)
                    row = pieces.row[piece]
                    arrays = [
                        diploids.take(pa.array(row)),
                        pa.array(keys[0][row].astype(np.int32)),
                        pa.array((keys[1][row] + pieces.offset[piece] + t0 + col).astype(np.int64)),
                        *summarise(posterior[inside]),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema_names)

    return run


def _decode(runs, blocks, model, size, summarise, columns):
    fragments = pack_fragments(runs, blocks, size)
    starts = carry_table(fragments, model, most_fragments(blocks, size))
    joined = join_nulls(fragments, starts, ["diploid", "block_id", "file_index"])
    names = ["diploid", "block_id", "pos", *columns]
    schema = ", ".join(
        ["diploid long", "block_id int", "pos long", *[f"{n} {t}" for n, t in columns.items()]]
    )
    return joined.mapInArrow(_decoder(model, summarise, names), schema)


def _as_lists(p: np.ndarray) -> pa.Array:
    offsets = np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(p).ravel()))


def posterior_decode(
    runs: DataFrame, blocks: DataFrame, model: Model, size: int = FRAGMENT
) -> DataFrame:
    """State probabilities of every site. A fragment starts from the state distribution its
    predecessor ends with; later fragments do not reach back."""
    return _decode(runs, blocks, model, size, lambda p: [_as_lists(p)], {"p": "array<double>"})


def decode_landscape(
    runs: DataFrame,
    blocks: DataFrame,
    model: Model,
    values: Mapping[str, Sequence[float]],
    time_of: Sequence[int],
    size: int = FRAGMENT,
) -> DataFrame:
    """Posterior means of per-state ``values`` and the decoded time index, one row per site.

    Adds ``<name>_in_time`` per value: its mean conditional on the decoded time index.
    """
    names = list(values)
    weights = np.array([values[n] for n in names], float).T
    times = np.asarray(time_of)
    cells = np.eye(times.max() + 1)[times]

    def summarise(p):
        means = p @ weights
        marginal = p @ cells
        k = marginal.argmax(axis=1)
        mass = np.take_along_axis(marginal, k[:, None], 1)[:, 0]
        inside = [
            np.take_along_axis((p * weights[:, i]) @ cells, k[:, None], 1)[:, 0] / mass
            for i in range(len(names))
        ]
        return [
            pa.array(k.astype(np.int32)),
            *[pa.array(np.ascontiguousarray(means[:, i])) for i in range(len(names))],
            *[pa.array(x) for x in inside],
        ]

    columns = {"k": "int", **{n: "double" for n in names}, **{f"{n}_in_time": "double" for n in names}}
    return _decode(runs, blocks, model, size, summarise, columns)


def decode_genome(
    runs: DataFrame, blocks: DataFrame, model: Model, time_of: Sequence[int], size: int = FRAGMENT
) -> DataFrame:
    """Decoded time index of every site of every diploid."""
    times = np.asarray(time_of)
    cells = np.eye(times.max() + 1)[times]
    summarise = lambda p: [pa.array((p @ cells).argmax(axis=1).astype(np.int32))]
    return _decode(runs, blocks, model, size, summarise, {"k": "int"})


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _time_array(space: StateSpace, p: Column) -> Column:
    # written out per time index: a lambda over the indices would redo ``p`` for each of them when
    # the optimizer merges the projection that made it
    width = space.per_time
    return F.array(*[_total(F.slice(p, k * width + 1, width)) for k in range(space.n_time)])


def _rate_array(space: StateSpace, rate: str, p: Column) -> Column:
    stride, size = space.stride(rate), space.size(rate)

    def share(j):
        return _total(F.filter(p, lambda x, i: F.floor(i / stride) % size == j))

    return F.array(*[share(F.lit(j)) for j in range(size)])


def _argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _dot(values: Column, weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [values[i] * F.lit(float(w)) for i, w in enumerate(weights)])


def decode_state(posterior: DataFrame, space: StateSpace | None = None) -> DataFrame:
    """Most probable state per site, lowest index on ties, with its components."""
    out = posterior.withColumn("s", _argmax(F.col("p")))
    if space:
        out = out.withColumn("k", F.floor(F.col("s") / space.per_time).cast("int"))
        for rate in ("theta", "rho", "ne"):
            cat = F.floor(F.col("s") / space.stride(rate)) % space.size(rate)
            out = out.withColumn(f"c_{rate}", cat.cast("int"))
    return out.drop("p")


def time_marginal(posterior: DataFrame, space: StateSpace) -> DataFrame:
    return posterior.withColumn("p_time", _time_array(space, F.col("p"))).drop("p")


def rate_marginal(posterior: DataFrame, space: StateSpace, rate: str) -> DataFrame:
    return posterior.withColumn("p_cat", _rate_array(space, rate, F.col("p"))).drop("p")


def decode_time(
    posterior: DataFrame, space: StateSpace, lower_bounds: Sequence[float] | None = None
) -> DataFrame:
    """Most probable time index with its probability, and its lower boundary if given."""
    marked = time_marginal(posterior, space)
    out = marked.withColumn("k", _argmax(F.col("p_time"))).withColumn("prob", F.array_max("p_time"))
    if lower_bounds is not None:
        bounds = F.array(*[F.lit(float(t)) for t in lower_bounds])
        out = out.withColumn("t_lo", F.element_at(bounds, F.col("k") + 1))
    return out.drop("p_time")


def decode_rate(
    posterior: DataFrame, space: StateSpace, rate: str, base: float, scales: Sequence[float]
) -> DataFrame:
    """Rate of the most probable category; population size takes the scale alone."""
    options = F.array(*[F.lit(float(x) * (1.0 if rate == "ne" else base)) for x in scales])
    return (
        rate_marginal(posterior, space, rate)
        .withColumn("cat", _argmax(F.col("p_cat")))
        .withColumn("value", F.element_at(options, F.col("cat") + 1))
        .drop("p_cat")
    )


def mean_rate(
    posterior: DataFrame, space: StateSpace, rate: str, base: float, scales: Sequence[float]
) -> DataFrame:
    """Posterior mean of base x scale."""
    return (
        rate_marginal(posterior, space, rate)
        .withColumn("value", _dot(F.col("p_cat"), scales) * F.lit(base))
        .drop("p_cat")
    )


def mean_tmrca(posterior: DataFrame, space: StateSpace, mean_times: Sequence[float]) -> DataFrame:
    return (
        time_marginal(posterior, space)
        .withColumn("tmrca", _dot(F.col("p_time"), mean_times))
        .drop("p_time")
    )


def _conditional(space: StateSpace, rate: str, base: float, scales: Sequence[float], p: Column) -> Column:
    """Array over time indices of the mean rate given that time."""
    width = space.per_time
    factors = F.array(*[F.lit(float(scales[c]) * base) for c in space.category_of(rate)[:width]])

    def at(k):
        inside = F.slice(p, k * width + 1, width)
        weighted = F.zip_with(inside, factors, lambda x, w: x * w)
        return _total(weighted) / F.nullif(_total(inside), F.lit(0.0))

    return F.array(*[at(k) for k in range(space.n_time)])


def rate_per_time(
    posterior: DataFrame, space: StateSpace, rate: str, base: float, scales: Sequence[float]
) -> DataFrame:
    """One row per site and time index: mean rate given that time (NULL where it has no mass)."""
    keys = [c for c in posterior.columns if c != "p"]
    each = _conditional(space, rate, base, scales, F.col("p"))
    return posterior.select(*keys, F.posexplode(each).alias("k", "value"))


def rate_in_decoded_time(
    posterior: DataFrame, space: StateSpace, rate: str, base: float, scales: Sequence[float]
) -> DataFrame:
    """Decoded time index and the mean rate given that time."""
    return (
        posterior.withColumn("k", _argmax(_time_array(space, F.col("p"))))
        .withColumn("rate", F.element_at(_conditional(space, rate, base, scales, F.col("p")), F.col("k") + 1))
        .drop("p")
    )


def time_posterior_wide(posterior: DataFrame, space: StateSpace) -> DataFrame:
    """One column per time index."""
    keys = [c for c in posterior.columns if c != "p"]
    marked = time_marginal(posterior, space)
    return marked.select(*keys, *[F.col("p_time")[k].alias(f"p_{k}") for k in range(space.n_time)])


def shannon_evenness(posterior: DataFrame) -> DataFrame:
    """Entropy of the state distribution over its maximum."""
    term = F.transform("p", lambda x: F.when(x > 0, -x * F.log(x)).otherwise(F.lit(0.0)))
    return posterior.withColumn("evenness", _total(term) / F.log(F.size("p"))).drop("p")
