"""Tiled helpers equal their plain counterparts when keys cross many tiles."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from locuswise.functions import tiling
from locuswise.operators import calling, intervals, runs

TILE = 7


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def sparse(spark):
    rng = random.Random(3)
    data = []
    for diploid in range(4):
        for block in range(2):
            # one key holds about half of the rows
            count = 90 if (diploid, block) == (0, 0) else 12
            for pos in sorted(rng.sample(range(1, 101), count)):
                data.append((diploid, block, pos, rng.choice([0, 0, 1, 2])))
    return spark.createDataFrame(data, "diploid long, block_id int, pos long, state int").cache()


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame(
        [(0, "chr1", 1, 100, 1, 100), (1, "chr2", 1, 100, 1, 100)],
        "block_id int, chrom string, start long, end long, lower_cut long, upper_cut long",
    )


def dense_states(sparse, standard=0):
    have = {(r.diploid, r.block_id, r.pos): r.state for r in sparse.collect()}
    keys = {k[:2] for k in have}
    return {(d, b, p): have.get((d, b, p), standard) for d, b in keys for p in range(1, 101)}


def dense_of(run_rows):
    out = {}
    for r in run_rows:
        for p in range(r.start_pos, r.end_pos + 1):
            key = (r.diploid, r.block_id, p)
            assert key not in out, "runs overlap"
            out[key] = r.state
    return out


def assert_maximal(run_rows):
    ordered = sorted(run_rows, key=lambda r: (r.diploid, r.block_id, r.start_pos))
    for a, b in zip(ordered, ordered[1:]):
        if (a.diploid, a.block_id) == (b.diploid, b.block_id) and a.end_pos + 1 == b.start_pos:
            assert a.state != b.state


@pytest.mark.parametrize("forward", [False, True])
def test_neighbours(sparse, forward):
    keys = ["diploid", "block_id"]
    w = Window.partitionBy(*keys).orderBy("pos")
    if forward:
        got = tiling.neighbours(sparse, keys, "pos", following="n", tile=TILE)
        want = sparse.withColumn("n", F.lead(F.struct("pos", "state")).over(w))
    else:
        got = tiling.neighbours(sparse, keys, "pos", previous="n", tile=TILE)
        want = sparse.withColumn("n", F.lag(F.struct("pos", "state")).over(w))
    pick = ["diploid", "block_id", "pos", F.coalesce("n.pos", F.lit(-1)), F.coalesce("n.state", F.lit(-1))]
    assert rows(got.select(*pick)) == rows(want.select(*pick))


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("keys", [["diploid", "block_id"], ["block_id"]])
def test_running_total(sparse, keys, inclusive):
    data = sparse.groupBy(*keys, "pos").agg(F.sum("state").alias("state"))
    got = tiling.running_total(data, keys, "pos", F.col("state"), "t", TILE, inclusive)
    w = Window.partitionBy(*keys).orderBy("pos")
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = data.withColumn("t", F.coalesce(F.sum("state").over(frame), F.lit(0)))
    assert rows(got.select(*keys, "pos", "t")) == rows(want.select(*keys, "pos", "t"))


@pytest.mark.parametrize("standard", [0, 2])
def test_fill_gaps_and_encode(sparse, blocks, standard):
    filled = calling.fill_gaps(sparse, blocks, standard, TILE)
    assert dense_of(filled.collect()) == dense_states(sparse, standard)
    encoded = runs.rle_encode(filled, TILE).collect()
    assert dense_of(encoded) == dense_states(sparse, standard)
    assert_maximal(encoded)


def test_encode_sites_with_holes(sparse):
    encoded = runs.rle_encode(sparse, TILE).collect()
    assert dense_of(encoded) == {(r.diploid, r.block_id, r.pos): r.state for r in sparse.collect()}
    assert_maximal(encoded)


def test_one_run_over_many_tiles(spark):
    df = spark.createDataFrame([(1, 0, 1, 1000, 0)], "diploid long, block_id int, start_pos long, end_pos long, state int")
    assert rows(runs.rle_encode(df, TILE)) == [(1, 0, 1, 1000, 0)]


@pytest.fixture(scope="module")
def mask(spark):
    rng = random.Random(5)
    data = [(rng.randrange(2), s := rng.randrange(0, 98), s + 1 + rng.randrange(9)) for _ in range(25)]
    data += [(0, 10, 20), (0, 20, 25), (0, 12, 15), (1, 90, 130)]
    return spark.createDataFrame(data, "block_id int, start0 long, end0 long").cache()


def test_mask_by_intervals(sparse, blocks, mask):
    hidden = {(r.block_id, p) for r in mask.collect() for p in range(r.start0 + 1, r.end0 + 1)}
    full = runs.rle_encode(calling.fill_gaps(sparse, blocks, 0, TILE), TILE)
    got = intervals.mask_by_intervals(full, mask, TILE).collect()
    want = {k: 2 if (k[1], k[2]) in hidden else s for k, s in dense_states(sparse).items()}
    assert dense_of(got) == want
    assert_maximal(got)


def test_subtract_intervals(blocks, mask):
    hidden = {(r.block_id, p) for r in mask.collect() for p in range(r.start0 + 1, r.end0 + 1)}
    got = intervals.subtract_intervals(blocks, mask, TILE).collect()
    bare = {(r.block_id, p) for r in got for p in range(r.start0 + 1, r.end0 + 1)}
    assert bare == {(b, p) for b in (0, 1) for p in range(1, 101)} - hidden


def test_informative_regions(spark):
    data = [(1, 0, 1, 10, 2), (1, 0, 11, 40, 0), (1, 0, 41, 44, 2), (1, 0, 45, 46, 1), (1, 0, 47, 60, 2), (1, 0, 61, 99, 0)]
    df = spark.createDataFrame(data, "diploid long, block_id int, start_pos long, end_pos long, state int")
    got = rows(runs.informative_regions(df, 10, 5, TILE).select("start_pos", "end_pos"))
    assert got == [(11, 46), (61, 99)]


def test_first_site_of_runs_and_sites(sparse, blocks):
    full = runs.rle_encode(calling.fill_gaps(sparse, blocks))
    from_runs = dense_of(calling.mask_first_site(full).collect())
    from_sites = {(r.diploid, r.block_id, r.pos): r.state for r in calling.mask_first_site(runs.expand_runs(full)).collect()}
    assert from_runs == from_sites
    assert all(from_runs[k] == 2 for k in from_runs if k[2] == 1)


def test_null_keys_and_positions_stay(spark):
    data = [(None, 3, 1), (None, 1, 2), (1, None, 3), (1, 9, 4), (1, 2, 5), (2, None, 6)]
    df = spark.createDataFrame(data, "k long, pos long, v long")
    window = Window.partitionBy("k").orderBy("pos")
    got = tiling.running_total(df, ["k"], "pos", F.col("v"), "total", tile=4)
    plain = df.withColumn("total", F.sum("v").over(window)).select("k", "pos", "v", "total")
    assert sorted(map(str, got.select("k", "pos", "v", "total").collect())) == sorted(map(str, plain.collect()))
    linked = tiling.neighbours(df, ["k"], "pos", "prev", "next", 4).select("k", "pos", "v", "prev.v", "next.v")
    plain = df.select("k", "pos", "v", F.lag("v").over(window), F.lead("v").over(window))
    assert sorted(str(tuple(r)) for r in linked.collect()) == sorted(str(tuple(r)) for r in plain.collect())


def test_fill_gaps_covers_blocks_without_records_and_rejects_unknown_ones(spark, blocks):
    sparse = spark.createDataFrame([(1, 0, 5, 1)], "diploid long, block_id int, pos long, state int")
    diploids = spark.createDataFrame([(1,), (2,)], "diploid long")
    full = rows(calling.fill_gaps(sparse, blocks, diploids=diploids))
    assert {(d, b) for d, b, *_ in full} == {(1, 0), (1, 1), (2, 0), (2, 1)}
    assert sum(end - start + 1 for _, _, start, end, _ in full) == 400
    with pytest.raises(Exception, match="unknown block"):
        calling.fill_gaps(sparse.withColumn("block_id", F.lit(9)), blocks).collect()


def test_sites_of_few_long_keys_are_spread(spark):
    """One key over a million positions is many groups, none of them above a tenth of it, and its runs are whole."""
    sites = spark.range(1, 1_000_001).selectExpr("1L AS diploid", "0 AS block_id", "id AS pos", "CAST(id > 700000 AS INT) AS state")
    pieces = tiling.split_at_tiles(runs.as_runs(sites)).groupBy("_tile").count()
    assert max(r["count"] for r in pieces.collect()) < 100_000
    assert rows(runs.rle_encode(sites)) == [(1, 0, 1, 700_000, 0), (1, 0, 700_001, 1_000_000, 1)]
