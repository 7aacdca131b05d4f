"""Second-level model over rate categories, shared by all diploids, and its training."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.functions.kernels import Pieces, RunPowers, dense_transfer, factor_pieces, run_pieces, smooth
from locuswise.functions.lineage import settled
from locuswise.functions.tiling import TILE, neighbours
from locuswise.operators.decoding import _grouped_rows, _symbol_matrix
from locuswise.operators import scoring
from locuswise.operators.overlay import covering_sums, overlay, value_runs
from locuswise.operators.runs import KEYS
from locuswise.operators.scoring import (
    FRAGMENT,
    TRANSFER_SCHEMA,
    Model,
    _carry_columns,
    _emit_transfer,
    _list_array,
    _lists,
    _single,
    by_fragment,
    fragment_transfers,
    join_nulls,
    most_fragments,
    multiply_up,
    pack_fragments,
    push_down,
)

EM_ROUNDS = 20
#: Logarithms are summed over diploids as whole numbers of this many to one.
LOG_UNIT = 1 << 40


def transition_symbols(decoded: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """Code of (time here, time at the next site); the last site repeats the code before it."""
    linked = neighbours(decoded.select(*KEYS, "pos", "k"), KEYS, "pos", "prev", "next", tile, ["k"])
    k = F.col("k")
    code = F.coalesce(k * n + F.col("next.k"), F.col("prev.k") * n + k, k * n + k)
    return linked.select(*KEYS, "pos", code.cast("int").alias("symbol"))


def emission_symbols(decoded: DataFrame, sites: DataFrame, n_obs: int = 3) -> DataFrame:
    """Code of (decoded time, observed state)."""
    joined = join_nulls(decoded.select(*KEYS, "pos", "k"), sites.select(*KEYS, "pos", "state"), [*KEYS, "pos"])
    return joined.select(*KEYS, "pos", (F.col("k") * n_obs + F.col("state")).cast("int").alias("symbol"))


def mask_decoded(decoded: DataFrame, sites: DataFrame, n: int) -> DataFrame:
    """Decoded time index at missing sites becomes the extra index ``n``."""
    joined = join_nulls(decoded.select(*KEYS, "pos", "k"), sites.select(*KEYS, "pos", "state"), [*KEYS, "pos"])
    return joined.select(
        *KEYS, "pos", F.when(F.col("state") == 2, F.lit(n)).otherwise(F.col("k")).cast("int").alias("k")
    )


def site_factors(symbols: DataFrame, emission: DataFrame, categories: int) -> DataFrame:
    """Per site, log of the product over diploids of P(symbol | category), as an array.

    Most sites carry the same few symbols, so the emission table is written first: its size is then
    known and it is broadcast when small, which is the rule for any usual number of categories.
    """
    logs = emission.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("cat", F.log(F.greatest("p", F.lit(1e-300))).alias("lp")))).alias("c")
    )
    lookup = settled(logs.select("symbol", F.col("c.lp").alias("lp")), "emission")
    joined = symbols.join(lookup, "symbol")
    sums = [F.sum(F.col("lp")[j]) for j in range(categories)]
    return joined.groupBy("block_id", "pos").agg(F.array(*sums).alias("logs"))


def pack_factors(factors: DataFrame, blocks: DataFrame, size: int = FRAGMENT) -> DataFrame:
    """One row per (block, fragment) with the site factors in order, scaled to a maximum of one."""
    limits = blocks.select("block_id", F.col("start").alias("_lo"))
    index = (F.floor((F.col("pos") - F.col("_lo")) / F.lit(size)) + 1).cast("int")
    scaled = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
    placed = by_fragment(
        factors.join(limits, "block_id").withColumn("file_index", index), ["block_id"]
    )
    return (
        placed.groupBy("block_id", "file_index")
        .agg(F.sort_array(F.collect_list(F.struct("pos", scaled.alias("f")))).alias("s"))
        .select(
            F.lit(0).cast("long").alias("diploid"),
            "block_id",
            "file_index",
            F.size("s").cast("long").alias("sites"),
            F.col("s.pos").alias("positions"),
            F.flatten("s.f").alias("factors"),
        )
    )


def time_runs(decoded: DataFrame, tile: int = TILE) -> DataFrame:
    """Maximal runs of decoded time. Sites and runs are written once: what made them is not done again by each reader."""
    sites = settled(decoded.select(*KEYS, "pos", "k"), "decoded-sites")
    return settled(value_runs(sites, "k", tile=tile), "time-runs")


def transition_symbol_runs(times: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """:func:`transition_symbols` from runs (keys, start_pos, end_pos, k) to maximal runs of equal symbol.

    Inside a run the time stays; its last site leads to the next run, and the sequence's last site repeats the code before.
    """
    merged = settled(value_runs(times, "k", tile=tile), "merged-times")
    linked = neighbours(merged, KEYS, "start_pos", "prev", "next", tile, ["k"])
    k, stays = F.col("k"), F.col("k") * n + F.col("k")
    alone = F.col("start_pos") == F.col("end_pos")
    last = F.coalesce(k * n + F.col("next.k"), F.when(alone, F.col("prev.k") * n + k), stays)
    run = lambda a, b, code: F.struct(a.alias("start_pos"), b.alias("end_pos"), code.cast("int").alias("symbol"))
    inner = F.when(~alone, run(F.col("start_pos"), F.col("end_pos") - 1, stays))
    both = F.filter(F.array(inner, run(F.col("end_pos"), F.col("end_pos"), last)), lambda r: r.isNotNull())
    coded = settled(linked.select(*KEYS, F.explode(both).alias("r")).select(*KEYS, "r.*"), "coded-runs")
    return settled(value_runs(coded, "symbol", tile=tile), "symbol-runs")


def emission_symbol_runs(times: DataFrame, states: DataFrame, n_obs: int = 3, tile: int = TILE) -> DataFrame:
    """:func:`emission_symbols` from runs of decoded time and runs of observed state."""
    laid = overlay({"k": times, "state": states}, KEYS, tile).filter("k IS NOT NULL AND state IS NOT NULL")
    coded = settled(laid.withColumn("symbol", (F.col("k") * n_obs + F.col("state")).cast("int")), "coded-runs")
    return value_runs(coded, "symbol", tile=tile)


def mask_decoded_runs(times: DataFrame, states: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """:func:`mask_decoded` from runs of decoded time and runs of observed state."""
    laid = overlay({"k": times, "state": states}, KEYS, tile).filter("k IS NOT NULL AND state IS NOT NULL")
    masked = laid.withColumn("k", F.when(F.col("state") == 2, F.lit(n)).otherwise(F.col("k")).cast("int"))
    return value_runs(settled(masked, "masked-runs"), "k", tile=tile)


def factor_runs(symbols: DataFrame, emission: DataFrame, categories: int, tile: int = TILE) -> DataFrame:
    """Stretches (block_id, start_pos, end_pos, logs) of equal factors: the runs of all diploids swept together.

    ``logs`` is the log of the product over the diploids there of P(symbol | category). A probability of zero gives
    minus infinity, however many diploids say otherwise; a stretch where that holds for every category, and a symbol
    without a probability in each category, raise an error. Logs are summed in units of 2^-40, so that taking a run away
    behind its end leaves no trace.
    """
    logs = emission.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("cat", "p"))).alias("c"))
    lookup = settled(logs.select("symbol", F.col("c.p").alias("p")), "emission")
    known = symbols.join(lookup, "symbol", "left")
    complete = F.when(F.size(F.coalesce("p", F.array().cast("array<double>"))) == categories, F.col("p")).otherwise(
        F.raise_error(F.concat(F.lit("no emission of symbol "), F.coalesce(F.col("symbol").cast("string"), F.lit("null")))).cast("array<double>")
    )
    known = known.withColumn("p", complete)
    units = lambda p: F.when(p > 0, F.round(F.log(p) * LOG_UNIT)).otherwise(0)
    sums = {f"l{j}": units(F.col("p")[j]) for j in range(categories)} | {f"z{j}": (F.col("p")[j] <= 0).cast("int") for j in range(categories)}
    swept = covering_sums(known, ["block_id"], sums, tile)
    each = [F.when(F.col(f"z{j}") > 0, F.lit(float("-inf"))).otherwise(F.col(f"l{j}") / LOG_UNIT) for j in range(categories)]
    possible = F.when(F.greatest(*each) > float("-inf"), F.array(*each)) if categories > 1 else F.when(each[0] > float("-inf"), F.array(*each))
    nothing = F.raise_error(F.concat(F.lit("no category is possible at site "), F.col("start_pos").cast("string"))).cast("array<double>")
    return swept.select("block_id", "start_pos", "end_pos", F.coalesce(possible, nothing).alias("logs"))


def pack_factor_runs(factors: DataFrame, blocks: DataFrame, size: int = FRAGMENT) -> DataFrame:
    """One row per (block, fragment) with the factors of its stretches in order, scaled to a maximum of one.

    The sites of a stretch are told apart in the tasks that smooth them only.
    """
    limits = blocks.select("block_id", F.col("start").alias("_lo"))
    number = lambda c: F.floor((F.col(c) - F.col("_lo")) / F.lit(size)).cast("int")
    pieces = (
        factors.join(limits, "block_id")
        .withColumn("_i", F.explode(F.sequence(number("start_pos"), number("end_pos"))))
        .withColumn("start_pos", F.greatest(F.col("start_pos"), F.col("_lo") + F.col("_i") * F.lit(int(size))))
        .withColumn("end_pos", F.least(F.col("end_pos"), F.col("_lo") + (F.col("_i") + 1) * F.lit(int(size)) - 1))
    )
    scaled = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
    run = F.struct("start_pos", (F.col("end_pos") - F.col("start_pos") + 1).alias("n"), scaled.alias("f"))
    placed = by_fragment(pieces.withColumn("file_index", F.col("_i") + 1), ["block_id"])
    packed = placed.groupBy("block_id", "file_index").agg(F.sort_array(F.collect_list(run)).alias("s"))
    return packed.select(
        F.lit(0).cast("long").alias("diploid"),
        "block_id",
        "file_index",
        F.aggregate("s.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("sites"),
        F.col("s.start_pos").alias("run_starts"),
        F.col("s.n").alias("run_lengths"),
        F.flatten("s.f").alias("factors"),
    )


def _site_rows(part, states: int) -> list[np.ndarray]:
    """Factors (sites, states) of each packed row, from sites or from stretches."""
    flats = [flat.reshape(-1, states) for flat in _lists(part["factors"])]
    if "run_lengths" not in part:
        return flats
    return [np.repeat(f, n, axis=0) for f, n in zip(flats, _lists(part["run_lengths"]))]


def _site_positions(part) -> list[np.ndarray]:
    if "positions" in part:
        return _lists(part["positions"])
    rows = zip(_lists(part["run_starts"]), _lists(part["run_lengths"]))
    return [np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum()) for starts, n in rows]


def _pad_factors(factors: Sequence[np.ndarray], pieces: Pieces) -> np.ndarray:
    """Emission factors of the sites, a row per piece."""
    padded = np.ones((len(pieces.sites), int(pieces.sites.max()), factors[0].shape[1]))
    for out, row, offset, n in zip(padded, pieces.row, pieces.offset, pieces.sites):
        out[:n] = factors[row][offset : offset + n]
    return padded


def joint_decode(
    fragments: DataFrame,
    trans: np.ndarray,
    scales: Sequence[float],
    base: float,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Posterior mean rate per site of packed factors.

    Every fragment starts from the uniform distribution, unless ``carried`` supplies what precedes
    and follows each fragment; the result is then that of the whole block.
    """
    weights = np.asarray(scales, float) * base
    states = len(weights)
    rows = fragments if carried is None else join_nulls(fragments, carried, [*KEYS, "file_index"])

    def run(batches):
        for batch in batches:
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for lo, hi in _grouped_rows(batch):
                part = {name: col.slice(lo, hi - lo) for name, col in cols.items()}
                factors = _site_rows(part, states)
                positions = _site_positions(part)
                begins = np.cumsum([0, *map(len, positions)])[:-1]
                positions = np.concatenate(positions).astype(np.int64)
                blocks = part["block_id"].to_numpy(zero_copy_only=False)
                start, end = np.full((len(factors), states), 1.0 / states), [None] * len(factors)
                if "start" in part:
                    before, end = np.stack(_lists(part["start"])), _lists(part["end"])
                    first = part["file_index"].to_numpy(zero_copy_only=False) == 1
                    start = np.where(first[:, None], before, before @ trans)
                pieces = Pieces.joined([factor_pieces(i, f, trans, start[i], end[i]) for i, f in enumerate(factors)])
                padded = _pad_factors(factors, pieces)
                emit = lambda t0, t1: padded[:, t0:t1]
                for t0, posterior, _ in smooth(emit, pieces.sites, trans, pieces.start, pieces.end):
                    inside = (t0 + np.arange(posterior.shape[1]))[None, :] < pieces.sites[:, None]
                    piece, col = np.nonzero(inside)
                    row = pieces.row[piece]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(blocks[row].astype(np.int32)),
                            pa.array(positions[begins[row] + pieces.offset[piece] + t0 + col]),
                            pa.array((posterior @ weights)[inside]),
                        ],
                        names=["block_id", "pos", "value"],
                    )

    return rows.mapInArrow(run, "block_id int, pos long, value double")


def _factor_transfers(trans: np.ndarray):
    states = len(trans)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            keys = _carry_columns(batch, ["diploid", "block_id"])
            keys["idx"] = cols["file_index"]
            keys["batch"] = pa.array(np.zeros(batch.num_rows, np.int32))
            mats, logs = [], []
            for factors, idx in zip(_site_rows(cols, states), cols["file_index"].to_pylist()):
                start = np.full(states, 1.0 / states) if idx == 1 else None
                m, log = dense_transfer(factors, trans, start)
                mats.append(m)
                logs.append(log)
            yield _emit_transfer(keys, mats, logs)

    return run


def both_carries(items: DataFrame, depth: int, states: int) -> DataFrame:
    """What precedes (``start``) and follows (``end``) each fragment of a block."""
    levels = multiply_up(items, depth, scoring.FAN_IN)
    keys = ["diploid", "block_id", F.col("idx").alias("file_index")]
    forward = push_down(levels, states).select(*keys, "start")
    backward = push_down(levels, states, backward=True).select(*keys, F.col("start").alias("end"))
    return join_nulls(forward, backward, [*KEYS, "file_index"])


def _count_schema():
    return "trans_counts array<double>, emis_counts array<double>"


def _counter(trans: np.ndarray, emis: np.ndarray | None):
    """Expected transition (and, for coded sequences, emission) counts per batch of fragments."""
    states = len(trans)
    by_symbol = None if emis is None else np.ascontiguousarray(emis.T)

    def run(batches):
        powers = None if emis is None else RunPowers(trans[None], emis[None])
        for batch in batches:
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for lo, hi in _grouped_rows(batch):
                part = {name: col.slice(lo, hi - lo) for name, col in cols.items()}
                before, end = np.stack(_lists(part["start"])), np.stack(_lists(part["end"]))
                linked = part["file_index"].to_numpy(zero_copy_only=False) > 1
                start = np.where(linked[:, None], before @ trans, before)
                reaching = list(zip(start, end, before, linked))
                if emis is None:
                    factors = _site_rows(part, states)
                    pieces = Pieces.joined([factor_pieces(i, factors[i], trans, *x) for i, x in enumerate(reaching)])
                    padded = _pad_factors(factors, pieces)
                    emit = lambda t0, t1: padded[:, t0:t1]
                else:
                    lengths, symbols = _lists(part["lengths"]), _lists(part["symbols"])
                    pieces = Pieces.joined([run_pieces(powers, i, lengths[i], symbols[i], *x) for i, x in enumerate(reaching)])
                    codes = _symbol_matrix(lengths, symbols, pieces)
                    emit = lambda t0, t1: by_symbol[codes[:, t0:t1]]
                sites = pieces.sites
                total = np.zeros((states, states))
                seen = np.zeros((states, 0 if emis is None else emis.shape[1]))
                smoothed = smooth(emit, sites, trans, pieces.start, pieces.end, pieces.before, pieces.linked, True)
                for t0, posterior, counts in smoothed:
                    total += counts.sum(axis=0)
                    if emis is not None:
                        inside = (t0 + np.arange(posterior.shape[1]))[None, :] < sites[:, None]
                        here = codes[:, t0 : t0 + posterior.shape[1]]
                        for o in range(emis.shape[1]):
                            seen[:, o] += posterior[inside & (here == o)].sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [_list_array([total.ravel()]), _list_array([seen.ravel()])],
                    names=["trans_counts", "emis_counts"],
                )

    return run


def expected_counts(runs: DataFrame, blocks: DataFrame, model: Model, size: int = FRAGMENT) -> DataFrame:
    """Expected counts per task batch over all diploids, exact across fragment borders."""
    fragments = pack_fragments(runs, blocks, size)
    items = fragment_transfers(fragments, _single(model, runs.sparkSession), 1, lead=True)
    carried = both_carries(items, most_fragments(blocks, size), model.states)
    joined = join_nulls(fragments, carried, [*KEYS, "file_index"])
    return joined.mapInArrow(_counter(model.trans, model.emis), _count_schema())


def _summed(counts: DataFrame, column: str, width: int) -> DataFrame:
    return (
        counts.select(F.posexplode(column).alias("i", "n"))
        .groupBy("i")
        .agg(F.sum("n").alias("n"))
        .select(
            F.floor(F.col("i") / width).cast("int").alias("j"), (F.col("i") % width).cast("int").alias("k"), "n"
        )
    )


def baum_welch_trans(runs: DataFrame, blocks: DataFrame, model: Model, size: int = FRAGMENT) -> DataFrame:
    """(j, k, p): transition matrix proposed from expected counts over all sequences."""
    cells = _summed(expected_counts(runs, blocks, model, size), "trans_counts", model.states)
    rows = cells.groupBy("j").agg(F.sum("n").alias("_row"))
    return cells.join(rows, "j").select("j", "k", (F.col("n") / F.col("_row")).alias("p"))


def baum_welch_emis(
    runs: DataFrame, blocks: DataFrame, model: Model, size: int = FRAGMENT, keep_missing: bool = True
) -> DataFrame:
    """(j, obs, p): emission matrix proposed from expected counts.

    With ``keep_missing`` the missing symbol keeps probability one and takes no part in the rows.
    """
    cells = _summed(expected_counts(runs, blocks, model, size), "emis_counts", model.emis.shape[1])
    used = cells.filter(F.col("k") < 2) if keep_missing else cells
    rows = used.groupBy("j").agg(F.sum("n").alias("_row"))
    p = F.col("n") / F.col("_row")
    if keep_missing:
        p = F.when(F.col("k") == 2, F.lit(1.0)).otherwise(p)
    return cells.join(rows, "j").select("j", F.col("k").alias("obs"), p.alias("p"))


def train_joint(
    fragments: DataFrame, trans: np.ndarray, depth: int, rounds: int = EM_ROUNDS
) -> tuple[np.ndarray, DataFrame]:
    """Transition matrix after ``rounds`` updates, and the carries under it.

    One job per round; only the (categories x categories) counts come back to the driver. The
    packed input is written once to the checkpoint folder so that rounds do not redo it.
    """
    states = len(trans)

    def carries(matrix):
        items = fragments.mapInArrow(_factor_transfers(matrix), TRANSFER_SCHEMA)
        return both_carries(items, depth, states)

    for _ in range(rounds):
        joined = join_nulls(fragments, carries(trans), [*KEYS, "file_index"])
        counts = joined.mapInArrow(_counter(trans, None), _count_schema())
        summed = {(r["j"], r["k"]): r["n"] for r in _summed(counts, "trans_counts", states).collect()}
        matrix = np.array([[summed.get((j, k), 0.0) for k in range(states)] for j in range(states)])
        trans = matrix / matrix.sum(axis=1, keepdims=True)
    return trans, carries(trans)


def em_loop(
    symbols: DataFrame,
    emission: DataFrame,
    blocks: DataFrame,
    trans: np.ndarray,
    scales: Sequence[float],
    base: float,
    size: int = FRAGMENT,
    rounds: int = EM_ROUNDS,
) -> DataFrame:
    """Train the category transitions, then the posterior mean rate of every site.

    ``symbols`` are sites or, which is cheaper, runs (:func:`transition_symbol_runs`, :func:`emission_symbol_runs`); both give the same rates.
    """
    if "pos" in symbols.columns:
        packed = pack_factors(site_factors(symbols, emission, len(scales)), blocks, size)
    else:
        packed = pack_factor_runs(factor_runs(symbols, emission, len(scales)), blocks, size)
    fragments = settled(packed, "factors")
    trans, carried = train_joint(fragments, trans, most_fragments(blocks, size), rounds)
    return joint_decode(fragments, trans, scales, base, carried)


@dataclass(frozen=True)
class Chain:
    """Second-level model of one rate: ``emission(cat, symbol, p)``, moves between categories, their scales and the base rate."""

    emission: DataFrame
    trans: np.ndarray
    scales: Sequence[float]
    base: float = 1.0


def joint_landscapes(
    times: DataFrame,
    states: DataFrame,
    blocks: DataFrame,
    chains: Mapping[str, Chain],
    n: int,
    size: int = FRAGMENT,
    rounds: int = 0,
) -> DataFrame:
    """The joint landscape of every rate in ``chains`` from one decoding: (rate, block_id, pos, value).

    ``times`` are the runs of :func:`time_runs`, written once and read by all chains; ``states`` are the observed runs.
    Theta is seen through pairs of decoded time and observed state, any other rate through changes of decoded time. With
    ``rounds`` each chain's moves are trained first, and fragments then know what precedes and follows them.
    """
    if not chains:
        raise ValueError("no rate to decode")
    found = []
    for rate, chain in chains.items():
        symbols = emission_symbol_runs(times, states) if rate == "theta" else transition_symbol_runs(times, n)
        if rounds:
            values = em_loop(symbols, chain.emission, blocks, chain.trans, chain.scales, chain.base, size, rounds)
        else:
            packed = pack_factor_runs(factor_runs(symbols, chain.emission, len(chain.scales)), blocks, size)
            values = joint_decode(packed, chain.trans, chain.scales, chain.base)
        found.append(values.select(F.lit(rate).alias("rate"), "block_id", "pos", "value"))
    return reduce(DataFrame.unionByName, found)
