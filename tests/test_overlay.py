"""Run overlays, and what is made from them, against site by site versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuswise.operators import bins, joint, overlay

SPANS = "diploid long, block_id int, start_pos long, end_pos long"


def runs_of(rng, keys, length, values, holes=0.2):
    """Runs with holes between some of them, and the value of each site."""
    rows, sites = [], {}
    for d, b in keys:
        at = int(rng.integers(1, 4))
        while at <= length:
            n = int(rng.integers(1, 9))
            if rng.random() >= holes:
                value = values[int(rng.integers(len(values)))]
                rows.append((d, b, at, min(length, at + n - 1), value))
                sites.update({(d, b, p): value for p in range(at, min(length, at + n - 1) + 1)})
            at += n
    return rows, sites


KEYS = [(1, 0), (2, 0), (None, 0), (1, 1), (7, 1)]


def sites_of(rows, columns):
    found = {}
    for r in rows:
        for p in range(r.start_pos, r.end_pos + 1):
            key = (r.diploid, r.block_id, p)
            assert key not in found
            found[key] = tuple(r[c] for c in columns)
    return found


@pytest.mark.parametrize("tile", [4, 7, 1 << 20])
def test_overlay_of_three_tables(spark, tile):
    rng = np.random.default_rng(tile)
    tables, wanted = {}, {}
    for i, (name, kind, values) in enumerate((("k", "int", [0, 1, 5]), ("state", "int", [0, 2]), ("value", "double", [0.5, -1.0]))):
        rows, sites = runs_of(rng, KEYS, 60, values)
        tables[name] = spark.createDataFrame(rows, f"{SPANS}, {name} {kind}")
        for key, value in sites.items():
            wanted.setdefault(key, [None] * 3)[i] = value
    got = overlay.overlay(tables, tile=tile).collect()
    assert sites_of(got, tables) == {k: tuple(v) for k, v in wanted.items()}


@pytest.mark.parametrize("tile", [5, 1 << 20])
def test_covering_sums_of_overlapping_runs(spark, tile):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(2)), int(a), int(a + rng.integers(0, 30)), int(rng.integers(-5, 9))) for a in rng.integers(1, 60, 80)]
    runs = spark.createDataFrame(rows, "block_id int, start_pos long, end_pos long, x int")
    want = {}
    for b, lo, hi, x in rows:
        for p in range(lo, hi + 1):
            n, total = want.get((b, p), (0, 0))
            want[b, p] = (n + 1, total + x)
    got = {}
    for r in overlay.covering_sums(runs, ["block_id"], {"x": runs.x}, tile).collect():
        got.update({(r.block_id, p): (r.covering, r.x) for p in range(r.start_pos, r.end_pos + 1)})
    assert got == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], f"{SPANS}, k int")
    states = spark.createDataFrame([(1, 0, 3, 5, 2)], f"{SPANS}, state int")
    assert [tuple(r) for r in overlay.overlay({"k": empty, "state": states}).collect()] == [(1, 0, 3, 5, None, 2)]
    assert overlay.overlay({"k": empty, "state": empty.withColumnRenamed("k", "state")}).count() == 0
    assert joint.transition_symbol_runs(empty, 2).count() == 0


@pytest.mark.parametrize("tile", [4, 1 << 20])
def test_symbol_runs_give_the_symbols_of_sites(spark, tile):
    rng = np.random.default_rng(8)
    rows, sites = runs_of(rng, [*KEYS, (9, 2)], 50, [0, 1, 2])
    states, state_sites = runs_of(rng, KEYS, 50, [0, 1, 2], holes=0.1)
    single = [(11, 0, 5, 5, 1)]
    times = spark.createDataFrame(rows + single, f"{SPANS}, k int")
    decoded = spark.createDataFrame([(*k, v) for k, v in sites.items()] + [(11, 0, 5, 1)], "diploid long, block_id int, pos long, k int")
    observed = spark.createDataFrame(states, f"{SPANS}, state int")
    dense = spark.createDataFrame([(*k, v) for k, v in state_sites.items()], "diploid long, block_id int, pos long, state int")
    for found, plain, column in (
        (joint.transition_symbol_runs(times, 3, tile), joint.transition_symbols(decoded, 3, tile), "symbol"),
        (joint.emission_symbol_runs(times, observed, 3, tile), joint.emission_symbols(decoded, dense), "symbol"),
        (joint.mask_decoded_runs(times, observed, 3, tile), joint.mask_decoded(decoded, dense, 3), "k"),
    ):
        want = {(r.diploid, r.block_id, r.pos): (r[column],) for r in plain.collect()}
        got = found.collect()
        assert sites_of(got, [column]) == want and len(got) < len(want)


def emission(spark, p):
    return spark.createDataFrame([(c, s, float(x)) for c, row in enumerate(p) for s, x in enumerate(row)], "cat int, symbol int, p double")


@pytest.mark.parametrize("tile", [6, 1 << 20])
def test_factor_runs_equal_site_factors(spark, tile):
    rng = np.random.default_rng(4)
    rows, sites = runs_of(rng, [(d, d % 2) for d in range(12)], 80, [0, 1, 2, 3], holes=0.1)
    table = emission(spark, rng.dirichlet(np.ones(4), size=3))
    symbols = spark.createDataFrame(rows, f"{SPANS}, symbol int")
    dense = spark.createDataFrame([(*k, v) for k, v in sites.items()], "diploid long, block_id int, pos long, symbol int")
    want = {(r.block_id, r.pos): r.logs for r in joint.site_factors(dense, table, 3).collect()}
    found = joint.factor_runs(symbols, table, 3, tile).collect()
    got = {(r.block_id, p): r.logs for r in found for p in range(r.start_pos, r.end_pos + 1)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert len(found) < len(want)


def test_impossible_categories_stay_impossible(spark):
    symbols = spark.createDataFrame([(1, 0, 1, 6, 0), (2, 0, 4, 9, 1)], f"{SPANS}, symbol int")
    logs = {r.start_pos: r.logs for r in joint.factor_runs(symbols, emission(spark, [[0.0, 0.5], [0.4, 0.25]]), 2).collect()}
    assert logs[1][0] == logs[4][0] == -math.inf and logs[4][1] == pytest.approx(math.log(0.1)) and logs[7][0] == pytest.approx(math.log(0.5))
    with pytest.raises(Exception, match="no category is possible at site 4"):
        joint.factor_runs(symbols, emission(spark, [[0.0, 0.5], [0.4, 0.0]]), 2).collect()
    with pytest.raises(Exception, match="no emission of symbol 1"):
        joint.factor_runs(symbols, emission(spark, [[0.0], [0.4]]), 2).collect()


def test_training_from_runs_equals_training_from_sites(spark):
    rng = np.random.default_rng(6)
    rows, sites = runs_of(rng, [(d, 0) for d in range(5)] + [(9, 1)], 70, [0, 1, 2, 3], holes=0.0)
    rows = [(d, b, 1 if i == 0 or rows[i - 1][:2] != (d, b) else lo, hi, s) for i, (d, b, lo, hi, s) in enumerate(rows)]
    symbols = spark.createDataFrame(rows, f"{SPANS}, symbol int")
    dense = spark.createDataFrame([(d, b, p, s) for d, b, lo, hi, s in rows for p in range(lo, hi + 1)], "diploid long, block_id int, pos long, symbol int")
    table, blocks = emission(spark, rng.dirichlet(np.ones(4), size=2)), spark.createDataFrame([(0, 1, 70), (1, 1, 70)], "block_id int, start long, end long")
    trans, scales = np.array([[0.9, 0.1], [0.3, 0.7]]), [0.5, 2.0]
    found = [
        {(r.block_id, r.pos): r.value for r in joint.em_loop(table_of, table, blocks, trans, scales, 1.0, size=16, rounds=2).collect()}
        for table_of in (symbols, dense)
    ]
    assert found[0].keys() == found[1].keys() and len(found[0]) == 140
    assert all(found[0][k] == pytest.approx(v, abs=1e-8) for k, v in found[1].items())


def test_bins_in_time(spark):
    rng = np.random.default_rng(9)
    made = [runs_of(rng, KEYS, 90, values) for values in ([0, 1, 2, 3], [0, 1, 2], [0.5, 1.5, 4.0])]
    tables = [
        spark.createDataFrame(rows, f"{SPANS}, {column} {kind}")
        for (rows, _), (column, kind) in zip(made, (("k", "int"), ("state", "int"), ("value", "double")))
    ]
    blocks = spark.createDataFrame([(0, 1, 90, 5, 85), (1, 1, 90, 1, 90)], "block_id int, start long, end long, lower_cut long, upper_cut long")
    want = {}
    for (d, b, p), k in made[0][1].items():
        if (5 if b == 0 else 1) <= p <= (85 if b == 0 else 90):
            for size in (10, 30):
                cell = want.setdefault((b, d, size, (p - (5 if b == 0 else 1)) // size), [0, []])
                cell[0] += 1
                if 1 <= k < 3:
                    cell[1].append((made[1][1].get((d, b, p)), made[2][1].get((d, b, p))))
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    got = {(r.block_id, r.diploid, r.bin_size, r.bin): r for r in bins.bins_in_time(*tables, blocks, (10, 30), 1, 3).collect()}
    assert got.keys() == want.keys()
    for key, (sites, inside) in want.items():
        r = got[key]
        assert (r.sites, r.sites_in_time) == (sites, len(inside))
        assert r.value == (pytest.approx(mean([v for _, v in inside if v is not None])))
        assert r.missing == pytest.approx(mean([s == 2 for s, _ in inside]))
        assert r.diversity == pytest.approx(mean([s == 1 for s, _ in inside if s != 2]))
    assert any(r.sites_in_time == 0 and r.value is None and r.missing is None for r in got.values())


def test_every_rate_has_its_joint_landscape_from_one_decoding(spark):
    """Joint landscapes of theta and rho against posteriors summed over all category paths, fragments apart."""
    rng = np.random.default_rng(5)
    sites = 9
    k = rng.integers(0, 2, (3, sites))
    state = rng.integers(0, 3, (3, sites))
    rows = [(d, 0, p + 1, int(k[d, p]), int(state[d, p])) for d in range(3) for p in range(sites)]
    dense = spark.createDataFrame(rows, "diploid long, block_id int, pos long, k int, state int")
    blocks = spark.createDataFrame([(0, "chr1", 1, sites, 1, sites)], "block_id int, chrom string, start long, end long, lower_cut long, upper_cut long")
    one = lambda name: dense.select("diploid", "block_id", F.col("pos").alias("start_pos"), F.col("pos").alias("end_pos"), name)
    tables = {"rho": rng.uniform(0.1, 0.9, (2, 4)), "theta": rng.uniform(0.1, 0.9, (3, 6))}
    trans = {"rho": np.array([[0.9, 0.1], [0.3, 0.7]]), "theta": np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.3, 0.3, 0.4]])}
    scales, bases = {"rho": [0.5, 2.0], "theta": [0.1, 1.0, 5.0]}, {"rho": 0.01, "theta": 0.2}
    chains = {
        rate: joint.Chain(
            spark.createDataFrame([(c, s, float(p)) for c, row in enumerate(table) for s, p in enumerate(row)], "cat int, symbol int, p double"),
            trans[rate], scales[rate], bases[rate],
        )
        for rate, table in tables.items()
    }
    pairs = np.array([[2 * r[i] + r[i + 1] if i + 1 < sites else 2 * r[i - 1] + r[i] for i in range(sites)] for r in k])
    symbols = {"rho": pairs, "theta": 3 * k + state}
    got = {(r.rate, r.pos): r.value for r in joint.joint_landscapes(one("k"), one("state"), blocks, chains, 2, size=5).collect()}
    assert len(got) == 2 * sites
    for rate in chains:
        for lo, hi in ((0, 5), (5, 9)):
            total, weight = np.zeros(hi - lo), 0.0
            for path in itertools.product(range(len(scales[rate])), repeat=hi - lo):
                p = math.prod(tables[rate][c, s] for i, c in enumerate(path) for s in symbols[rate][:, lo + i])
                p *= math.prod(trans[rate][a, b] for a, b in zip(path, path[1:]))
                # a fragment opens from the uniform distribution
                total += p * bases[rate] * np.array([scales[rate][c] for c in path])
                weight += p
            assert [got[rate, p + 1] for p in range(lo, hi)] == pytest.approx((total / weight).tolist(), rel=1e-9)
    trained = joint.joint_landscapes(one("k"), one("state"), blocks, chains, 2, size=5, rounds=2).collect()
    assert {(r.rate, r.pos) for r in trained} == set(got) and all(math.isfinite(r.value) for r in trained)
    with pytest.raises(ValueError):
        joint.joint_landscapes(one("k"), one("state"), blocks, {}, 2)
