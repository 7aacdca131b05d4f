"""Log-likelihood of candidate models over all sequences, and the carry between fragments.

The unit of work is a fragment of a block, so the longest chromosome never sits in one task. A
fragment yields its transfer matrix from runs alone; matrices of a block are multiplied in groups
of ``FAN_IN`` per level until one is left. For scores, fragments of few runs are first laid together:
neighbours of a block into stretches, stretches into bundles, whose members are stepped side by side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.functions.kernels import RunPowers, chain
from locuswise.functions.lineage import settled
from locuswise.functions.tiling import running_total
from locuswise.operators.holes import with_holes
from locuswise.operators.runs import KEYS, run_length

FRAGMENT = 3_000_000
FAN_IN = 16
MODELS_PER_BATCH = 32
#: Rows whose matrices a Python worker holds at once.
ROWS = 256
#: Runs up to which fragments are laid together.
BUNDLE_RUNS = 1 << 15


@dataclass(frozen=True)
class Model:
    """One hidden Markov model: transition (S x S) and emission (S x symbols) probabilities."""

    trans: np.ndarray
    emis: np.ndarray

    @property
    def states(self) -> int:
        return len(self.trans)


def by_fragment(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash by fragment into a stated number of partitions.

    Work per byte is high after packing, so the partitions must not be merged by their size; and
    collecting gains nothing from a partial step, so this is the only shuffle of the packing.
    """
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, *keys, "file_index")


def join_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on whole-number ``keys``; null equals null, so a null diploid finds its own rows."""
    key = F.struct(*[F.col(k).cast("long").alias(k) for k in keys]).alias("_key")
    values = [c for c in right.columns if c not in keys]
    return left.select("*", key).join(right.select(key, *values), "_key").drop("_key")


def pack_fragments(runs: DataFrame, blocks: DataFrame, size: int = FRAGMENT) -> DataFrame:
    """One row per (diploid, block, fragment): first site, run lengths and symbols in order.

    A row holds at most ``size`` sites. The runs must cover the fragment without holes
    (:func:`locuswise.operators.holes.with_holes` makes runs that do).
    """
    limits = blocks.select("block_id", F.col("start").alias("_lo"))
    index = F.sequence(
        F.floor((F.col("start_pos") - F.col("_lo")) / F.lit(size)).cast("int"),
        F.floor((F.col("end_pos") - F.col("_lo")) / F.lit(size)).cast("int"),
    )
    pieces = (
        runs.join(limits, "block_id")
        .withColumn("_i", F.explode(index))
        .withColumn("start_pos", F.greatest(F.col("start_pos"), F.col("_lo") + F.col("_i") * F.lit(int(size))))
        .withColumn("end_pos", F.least(F.col("end_pos"), F.col("_lo") + (F.col("_i") + 1) * F.lit(int(size)) - 1))
    )
    run = F.struct(
        "start_pos", run_length().cast("int").alias("length"), F.col("state").cast("tinyint").alias("state")
    )
    placed = by_fragment(pieces.withColumn("file_index", F.col("_i") + 1), KEYS)
    packed = placed.groupBy(*KEYS, "file_index").agg(
        F.sort_array(F.collect_list(run)).alias("runs"),
        F.min("start_pos").alias("frag_start"),
        F.max("end_pos").alias("frag_end"),
        F.sum(run_length()).alias("sites"),
    )
    whole = F.when(
        F.col("frag_end") - F.col("frag_start") + 1 == F.col("sites"), F.lit(True)
    ).otherwise(F.raise_error(F.lit("runs leave holes or overlap inside a fragment")).cast("boolean"))
    return packed.filter(whole).select(
        *KEYS,
        "file_index",
        "frag_start",
        "sites",
        F.col("runs.length").alias("lengths"),
        F.col("runs.state").alias("symbols"),
    )


def pack_models(trans: DataFrame, emis: DataFrame) -> DataFrame:
    """Long matrices (candidate_id, s_from, s_to, p) and (candidate_id, s, obs, p) as row-major arrays."""
    t = trans.groupBy("candidate_id").agg(
        F.sort_array(F.collect_list(F.struct("s_from", "s_to", "p"))).alias("c")
    )
    e = emis.groupBy("candidate_id").agg(
        F.sort_array(F.collect_list(F.struct("s", "obs", "p"))).alias("c")
    )
    return t.select("candidate_id", F.col("c.p").alias("trans")).join(
        e.select("candidate_id", F.col("c.p").alias("emis")), "candidate_id"
    )


def collect_model(models: DataFrame) -> Model:
    """The single packed model of a one-row table as arrays."""
    rows = models.take(2)
    if len(rows) != 1:
        raise ValueError("expected exactly one model")
    size = math.isqrt(len(rows[0]["trans"]))
    return Model(
        np.array(rows[0]["trans"]).reshape(size, size), np.array(rows[0]["emis"]).reshape(size, -1)
    )


def most_fragments(blocks: DataFrame, size: int) -> int:
    longest = blocks.agg(F.max(F.col("end") - F.col("start") + 1)).first()[0] or 1
    return max(1, math.ceil(longest / size))


def _lists(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """Rows of an Arrow list column as views on its value buffer."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.asarray(column.value_lengths(), dtype=np.int64))
    return np.split(values, ends[:-1]) if len(ends) else []


def _nested(column: pa.Array) -> list[list[np.ndarray]]:
    """Rows of an Arrow list of lists as views: boxed numbers would take many times the memory of the batch."""
    members = _lists(column.flatten())
    ends = np.cumsum(np.asarray(column.value_lengths(), dtype=np.int64)).tolist()
    return [members[a:b] for a, b in zip([0, *ends], ends)]


def _short(batches):
    """Batches of at most ``ROWS`` rows: a row holds the matrices of a whole batch of models."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


def _carry_columns(batch: pa.RecordBatch, names: Sequence[str]):
    return {name: batch.column(batch.schema.get_field_index(name)) for name in names}


def _list_array(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(float)))


KEY_SCHEMA = "diploid long, block_id int, batch int, idx int"
TRANSFER_SCHEMA = f"{KEY_SCHEMA}, mats array<double>, logs array<double>"
TRANSFER_KEYS = ["diploid", "block_id", "batch"]


def _emit_transfer(keys, mats, logs):
    arrays = [
        keys["diploid"].cast(pa.int64()),
        keys["block_id"].cast(pa.int32()),
        keys["batch"].cast(pa.int32()),
        keys["idx"].cast(pa.int32()),
        _list_array([m.ravel() for m in mats]),
        _list_array(logs),
    ]
    return pa.RecordBatch.from_arrays(
        arrays, names=["diploid", "block_id", "batch", "idx", "mats", "logs"]
    )


def _transfers(lead: bool):
    def run(batches):
        key, powers = None, None
        for batch in _short(batches):
            if not batch.num_rows:
                continue
            cols = _carry_columns(batch, ["diploid", "block_id", "batch", "idx"])
            get = lambda name: _lists(batch.column(batch.schema.get_field_index(name)))
            lengths, symbols, trans, emis = get("lengths"), get("symbols"), get("trans"), get("emis")
            counts = batch.column(batch.schema.get_field_index("models")).to_pylist()
            firsts = cols["idx"].to_pylist()
            ids = cols["batch"].to_pylist()
            mats, logs = [None] * batch.num_rows, [None] * batch.num_rows
            for own, places in groupby(range(batch.num_rows), key=ids.__getitem__):
                places = list(places)
                if key != own:
                    at, key = places[0], own
                    states = math.isqrt(len(trans[at]) // counts[at])
                    powers = RunPowers(
                        trans[at].reshape(counts[at], states, states).copy(),
                        emis[at].reshape(counts[at], states, -1).copy(),
                    )
                # fragments of one kind are stepped side by side
                for opening in (True, False):
                    kind = [i for i in places if (firsts[i] == 1) == opening]
                    if not kind:
                        continue
                    start = np.full(states, 1.0 / states) if opening else None
                    found = powers.fragments([lengths[i] for i in kind], [symbols[i] for i in kind], start, lead)
                    for lanes, left, log in found:
                        for lane, m, own_log in zip(lanes, left.transpose(1, 0, 2, 3), log.T):
                            mats[kind[lane]], logs[kind[lane]] = m, own_log
            yield _emit_transfer(cols, mats, logs)

    return run


def batch_models(models: DataFrame, per_batch: int = MODELS_PER_BATCH) -> tuple[DataFrame, DataFrame, int]:
    """Models grouped into rows of at most ``per_batch``; also (candidate_id, batch, place).

    Matrices are made once and written to the checkpoint folder: they are read three times here.
    """
    models = settled(models, "models")
    numbered = running_total(
        models.select("candidate_id"), [], "candidate_id", F.lit(1), "_n", inclusive=False
    ).select(
        "candidate_id",
        F.floor(F.col("_n") / per_batch).cast("int").alias("batch"),
        (F.col("_n") % per_batch).cast("int").alias("place"),
    )
    grouped = (
        models.join(numbered, "candidate_id")
        .groupBy("batch")
        .agg(F.sort_array(F.collect_list(F.struct("place", "trans", "emis"))).alias("m"))
        .select(
            "batch",
            F.size("m").alias("models"),
            F.flatten("m.trans").alias("trans"),
            F.flatten("m.emis").alias("emis"),
        )
    )
    return grouped, numbered, max(1, math.ceil(models.count() / per_batch))


def fragment_transfers(
    fragments: DataFrame, batches: DataFrame, n_batches: int, lead: bool
) -> DataFrame:
    """Transfer of every fragment under every model batch.

    Each fragment meets each batch once. The join key carries a salt so that a handful of batches
    still spreads over all tasks; the model side is what gets repeated, and it does not grow with
    the data.
    """
    spark = fragments.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = fragments.withColumn(
        "_salt", F.pmod(F.xxhash64(*KEYS, "file_index"), F.lit(salts)).cast("int")
    ).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))))
    right = batches.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = left.join(right, ["batch", "_salt"]).select(
        F.col("diploid").cast("long"),
        F.col("block_id").cast("int"),
        "batch",
        F.col("file_index").alias("idx"),
        "lengths",
        "symbols",
        "models",
        "trans",
        "emis",
    )
    return joined.mapInArrow(_transfers(lead), TRANSFER_SCHEMA)


def _check_order(group: int, members: Sequence[int], fan: int) -> None:
    """A sequence starts at its block's start and has every fragment up to its last one."""
    start = (group - 1) * fan + 1
    if list(members) != list(range(start, start + len(members))):
        raise ValueError(f"fragments {list(members)} of a sequence are not complete from {start} on")


def _products(batches):
    for batch in _short(batches):
        if not batch.num_rows:
            continue
        cols = _carry_columns(batch, ["diploid", "block_id", "batch", "idx"])
        out_m, out_l = [], []
        for group, ids in zip(
            cols["idx"].to_pylist(), batch.column(batch.schema.get_field_index("members")).to_pylist()
        ):
            _check_order(group, ids, FAN_IN)
        nested = (_nested(batch.column(batch.schema.get_field_index(name))) for name in ("mats", "logs"))
        for mats, logs in zip(*nested):
            models = len(logs[0])
            states = math.isqrt(len(mats[-1]) // models) if len(mats) > 1 else None
            members = []
            for m, log in zip(mats, logs):
                width = states or len(m) // models
                members.append((np.array(m).reshape(models, -1, width), np.array(log)))
            left, log = chain(members)
            out_m.append(left)
            out_l.append(log)
        yield _emit_transfer(cols, out_m, out_l)


def _group_members(items: DataFrame) -> DataFrame:
    group = (F.floor((F.col("idx") - 1) / FAN_IN) + 1).cast("int")
    # the key is a struct: never null itself, so a null diploid stays and both readers of a level share its shuffle
    keyed = items.withColumn("_key", F.struct(*TRANSFER_KEYS, group.alias("idx")))
    grouped = keyed.groupBy("_key").agg(
        F.sort_array(F.collect_list(F.struct("idx", "mats", "logs"))).alias("m")
    )
    return grouped.select(
        "_key",
        "_key.*",
        F.col("m.idx").alias("members"),
        F.col("m.mats").alias("mats"),
        F.col("m.logs").alias("logs"),
    )


def multiply_up(items: DataFrame, depth: int, until: int = 1) -> list[DataFrame]:
    """Item tables per level, up to the first with at most ``until`` items per (diploid, block)."""
    levels = [items]
    while depth > until:
        levels.append(_group_members(levels[-1]).drop("_key").mapInArrow(_products, TRANSFER_SCHEMA))
        depth = math.ceil(depth / FAN_IN)
    return levels


@dataclass(frozen=True)
class Bundles:
    """Rows (bundle, members): the stretches of a bundle as ordered fragments; a stretch is ``fan`` fragments of a block."""

    rows: DataFrame
    fan: int
    depth: int


def bundled(fragments: DataFrame, depth: int) -> Bundles:
    """Stored fragments laid together as far as ``BUNDLE_RUNS`` allows; a fragment of more runs has its own row."""
    runs = F.size("lengths")
    found = fragments.agg(F.max(runs).alias("most"), F.sum(runs.cast("long")).alias("all")).first()
    fan = max(1, min(depth, BUNDLE_RUNS // max(found["most"] or 1, 1)))
    bundles = 1 + (found["all"] or 0) // BUNDLE_RUNS
    stretch = (F.floor((F.col("file_index") - 1) / fan) + 1).cast("int")
    placed = fragments.withColumn("idx", stretch).withColumn(
        "bundle", F.pmod(F.xxhash64(*KEYS, "idx"), F.lit(bundles)).cast("int")
    )
    member = F.struct(
        F.col("diploid").cast("long").alias("diploid"), F.col("block_id").cast("int").alias("block_id"), "idx", "file_index", "lengths", "symbols"
    )
    rows = placed.groupBy("bundle").agg(F.sort_array(F.collect_list(member)).alias("members"))
    return Bundles(rows, fan, max(1, math.ceil(depth / fan)))


def _stretches(fan: int):
    """Transfers of the stretches of a bundle; the first one of a block starts from equally likely states."""

    def run(batches):
        key, powers = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(batch.schema.get_field_index(name))[i] for name in batch.schema.names}
                if key != row["batch"].as_py():
                    key, count = row["batch"].as_py(), row["models"].as_py()
                    trans, emis = (row[name].values.to_numpy() for name in ("trans", "emis"))
                    states = math.isqrt(len(trans) // count)
                    powers = RunPowers(trans.reshape(count, states, states).copy(), emis.reshape(count, states, -1).copy())
                members = row["members"].values
                names = list(zip(*(members.field(c).to_pylist() for c in ("diploid", "block_id", "idx"))))
                order = members.field("file_index").to_pylist()
                lengths, symbols = (_lists(members.field(c)) for c in ("lengths", "symbols"))
                for lead in (False, True):
                    keys, runs = [], []
                    for name, places in groupby(range(len(names)), key=names.__getitem__):
                        if (name[2] > 1) == lead:
                            places = list(places)
                            _check_order(name[2], [order[p] for p in places], fan)
                            keys.append(name)
                            runs.append([np.concatenate([x[p] for p in places]) for x in (lengths, symbols)])
                    if not keys:
                        continue
                    start = None if lead else np.full(states, 1.0 / states)
                    for lanes, left, log in powers.fragments(*zip(*runs), start, lead):
                        diploid, block, idx = zip(*(keys[lane] for lane in lanes))
                        cols = {
                            "diploid": pa.array(diploid, pa.int64()),
                            "block_id": pa.array(block, pa.int32()),
                            "batch": pa.array([key] * len(lanes), pa.int32()),
                            "idx": pa.array(idx, pa.int32()),
                        }
                        yield _emit_transfer(cols, list(left.transpose(1, 0, 2, 3)), list(log.T))

    return run


def bundle_transfers(bundles: DataFrame, fan: int, batches: DataFrame, n_batches: int) -> DataFrame:
    """Transfer of every stretch under every model batch; a bundle meets the matrices of a batch as one row."""
    spark = bundles.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = bundles.withColumn("_salt", F.pmod("bundle", F.lit(count))).withColumn(
        "batch", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1)))
    )
    right = batches.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    joined = left.join(right, ["batch", "_salt"]).select("batch", "members", "models", "trans", "emis")
    # few rows with much work each, dealt evenly
    return joined.repartition(count).mapInArrow(_stretches(fan), TRANSFER_SCHEMA)


def _masses(batches):
    """Log of what is left in the vector of each model; null where nothing is."""
    for batch in batches:
        cols = _carry_columns(batch, ["diploid", "block_id", "batch"])
        get = lambda name: _lists(batch.column(batch.schema.get_field_index(name)))
        out = []
        for mats, logs in zip(get("mats"), get("logs")):
            mass = mats.reshape(len(logs), -1).sum(axis=1)
            with np.errstate(divide="ignore"):
                out.append(np.where(mass > 0, np.log(mass) + logs, np.nan))
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        flat = np.concatenate(out) if out else np.empty(0)
        yield pa.record_batch({**cols, "logliks": pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, mask=np.isnan(flat)))})


def score_bundles(bundles: Bundles, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log-likelihoods (diploid, block_id, batch, place, loglik), and which candidate has which (batch, place)."""
    batches, numbered, n_batches = batch_models(models)
    items = bundle_transfers(bundles.rows, bundles.fan, batches, n_batches)
    top = multiply_up(items, bundles.depth)[-1]
    scored = top.mapInArrow(_masses, "diploid long, block_id int, batch int, logliks array<double>")
    return scored.select("diploid", "block_id", "batch", F.posexplode("logliks").alias("place", "loglik")), numbered


def _packed(runs: DataFrame, blocks: DataFrame, size: int, holes: str | None) -> DataFrame:
    return settled(pack_fragments(runs if holes is None else with_holes(runs, blocks, holes), blocks, size), "fragments")


def forward_loglik(
    runs: DataFrame, blocks: DataFrame, models: DataFrame, size: int = FRAGMENT, holes: str | None = None
) -> DataFrame:
    """(candidate_id, diploid, block_id, loglik) from a scaled forward pass with uniform start.

    ``models(candidate_id, trans, emis)`` as packed by :func:`pack_models`. Runs with holes need ``holes``: the chain
    goes on unseen (``drift``) or begins anew behind each (``restart``).
    """
    scored, numbered = score_bundles(bundled(_packed(runs, blocks, size, holes), most_fragments(blocks, size)), models)
    return scored.join(numbered, ["batch", "place"]).select("candidate_id", "diploid", "block_id", "loglik")


@dataclass(frozen=True)
class Scorer:
    """Bundles written once, scored for any number of model tables."""

    bundles: Bundles

    @staticmethod
    def over(runs: DataFrame, blocks: DataFrame, size: int = FRAGMENT, holes: str | None = None) -> Scorer:
        made = bundled(_packed(runs, blocks, size, holes), most_fragments(blocks, size))
        return Scorer(replace(made, rows=settled(made.rows, "bundles")))

    def __call__(self, models: DataFrame) -> DataFrame:
        scored, numbered = score_bundles(self.bundles, models)
        totals = scored.groupBy("batch", "place").agg(F.sum("loglik").alias("loglik"))
        return totals.join(numbered, ["batch", "place"]).select("candidate_id", "loglik")


def _starts(states: int):
    """Start vectors of group members from the group's own start vector."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            rows = {"diploid": [], "block_id": [], "batch": [], "idx": [], "start": []}
            for d, b, n, members, mats, start in zip(
                get("diploid"), get("block_id"), get("batch"), get("members"), get("mats"), get("start")
            ):
                now = np.array(start)
                for idx, m in zip(members, mats):
                    for name, value in zip(rows, (d, b, n, idx, now)):
                        rows[name].append(value)
                    step = np.array(m).reshape(-1, states)
                    after = step[0] if len(step) == 1 else now @ step
                    now = after / after.sum()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["diploid"], pa.int64()),
                    pa.array(rows["block_id"], pa.int32()),
                    pa.array(rows["batch"], pa.int32()),
                    pa.array(rows["idx"], pa.int32()),
                    _list_array(rows["start"]),
                ],
                names=list(rows),
            )

    return run


def _ends(states: int):
    """What follows each member (backward vectors), from what follows its group."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            rows = {"diploid": [], "block_id": [], "batch": [], "idx": [], "start": []}
            for d, b, n, members, mats, after in zip(
                get("diploid"), get("block_id"), get("batch"), get("members"), get("mats"), get("start")
            ):
                now = np.array(after)
                for idx, m in zip(reversed(members), reversed(mats)):
                    for name, value in zip(rows, (d, b, n, idx, now)):
                        rows[name].append(value)
                    step = np.array(m).reshape(-1, states)
                    if len(step) == states:
                        before = step @ now
                        now = before / before.max()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["diploid"], pa.int64()),
                    pa.array(rows["block_id"], pa.int32()),
                    pa.array(rows["batch"], pa.int32()),
                    pa.array(rows["idx"], pa.int32()),
                    _list_array(rows["start"]),
                ],
                names=list(rows),
            )

    return run


START_SCHEMA = f"{KEY_SCHEMA}, start array<double>"


def push_down(levels: list[DataFrame], states: int, backward: bool = False) -> DataFrame:
    """Vector in force before (or after) every item of the lowest level.

    The highest level has at most ``FAN_IN`` items per block, so one group starts it.
    """
    fill = 1.0 if backward else 1.0 / states
    step = _ends(states) if backward else _starts(states)
    outer = F.array(*[F.lit(fill) for _ in range(states)])
    known = None
    for level in reversed(levels):
        grouped = _group_members(level).drop("logs")
        if known is None:
            grouped = grouped.withColumn("start", outer)
        else:
            grouped = grouped.join(known.select(F.struct(*TRANSFER_KEYS, "idx").alias("_key"), "start"), "_key")
        known = grouped.drop("_key").mapInArrow(step, START_SCHEMA)
    return known


def _single(model: Model, spark) -> DataFrame:
    row = (0, 1, model.trans.ravel().tolist(), model.emis.ravel().tolist())
    return spark.createDataFrame(
        [row], "batch int, models int, trans array<double>, emis array<double>"
    )


def carry_table(fragments: DataFrame, model: Model, depth: int) -> DataFrame:
    items = fragment_transfers(fragments, _single(model, fragments.sparkSession), 1, lead=False)
    levels = multiply_up(items, depth, FAN_IN)
    return push_down(levels, model.states).select(
        "diploid", "block_id", F.col("idx").alias("file_index"), "start"
    )


def filter_carry(runs: DataFrame, blocks: DataFrame, model: Model, size: int = FRAGMENT) -> DataFrame:
    """State distribution each fragment starts from: the end of the one before, uniform per block.

    All transfer matrices are made in parallel; chaining touches one matrix per fragment only.
    """
    fragments = pack_fragments(runs, blocks, size)
    return carry_table(fragments, model, most_fragments(blocks, size))


def composite_loglik(ll: DataFrame, test_ids: DataFrame | None = None) -> DataFrame:
    """Sum over blocks and diploids per candidate, tested diploids left out."""
    if test_ids is not None:
        ll = ll.join(test_ids.select("diploid").distinct(), "diploid", "left_anti")
    return ll.groupBy("candidate_id").agg(F.sum("loglik").alias("loglik"))


def _per_diploid(ll: DataFrame) -> DataFrame:
    return ll.groupBy("candidate_id", "diploid").agg(F.sum("loglik").alias("loglik"))


def median_loglik(ll: DataFrame) -> DataFrame:
    return _per_diploid(ll).groupBy("candidate_id").agg(F.percentile("loglik", 0.5).alias("loglik"))


def min_loglik(ll: DataFrame) -> DataFrame:
    return _per_diploid(ll).groupBy("candidate_id").agg(F.min("loglik").alias("loglik"))


def likelihood_sweep(
    models: DataFrame, runs: DataFrame, blocks: DataFrame, size: int = FRAGMENT, holes: str | None = None
) -> DataFrame:
    """Composite log-likelihood of every candidate on all data."""
    return Scorer.over(runs, blocks, size, holes)(models)
