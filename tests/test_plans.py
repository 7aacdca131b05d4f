"""The ways from files to runs and from sites to maps."""

import pytest
from pyspark.sql import functions as F

from locuswise.functions.tiling import split_at_tiles
from locuswise.plans.ingest import prepare_states, read_states
from locuswise.plans.maps import genome_maps
from locuswise.sources import variants

VCF = """#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
chr1\t3\t.\tA\tC\t.\tPASS\t.\tGT\t0/0\t0|1
chr1\t6\t.\tA\tC\t.\tq10\t.\tGT\t0/1\t1/1
chr2\t2\t.\tA\tC\t.\tPASS\t.\tGT\t0/1\t0/0
"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def files(tmp_path):
    made = {
        "calls.vcf": VCF,
        "blocks.tab": "chr1\t1\t8\t0\t7\t1\t8\nchr2\t1\t4\t0\t3\t1\t4\n",
        "mask.bed": "chr1\t3\t5\nchr2\t3\t9\n",
    }
    for name, text in made.items():
        (tmp_path / name).write_text(text)
    return {name.split(".")[0]: str(tmp_path / name) for name in made}


def test_files_to_runs(spark, files):
    samples = spark.createDataFrame([("s1", 0), ("s2", 1)], "sample string, diploid int")
    runs, blocks = read_states(spark, files["calls"], files["blocks"], samples, files["mask"])
    columns = ["diploid", "block_id", "start_pos", "end_pos", "state"]
    assert rows(runs.select(columns)) == [
        (0, 0, 1, 1, 2), (0, 0, 2, 3, 0), (0, 0, 4, 6, 2), (0, 0, 7, 8, 0), (0, 1, 1, 1, 2), (0, 1, 2, 2, 1),
        (0, 1, 3, 3, 0), (0, 1, 4, 4, 2), (1, 0, 1, 1, 2), (1, 0, 2, 2, 0), (1, 0, 3, 3, 1), (1, 0, 4, 6, 2),
        (1, 0, 7, 8, 0), (1, 1, 1, 1, 2), (1, 1, 2, 3, 0), (1, 1, 4, 4, 2),
    ]
    assert blocks.count() == 2
    few = samples.filter("diploid = 0")
    with pytest.raises(Exception, match="sample without a diploid: s2"):
        read_states(spark, files["calls"], files["blocks"], few)[0].collect()
    known = variants.with_diploid_ids(variants.read_variants(spark, files["calls"]), few, unknown="drop")
    assert known.count() == 3


def test_records_without_rows_and_repeated_ones(spark, files):
    schema = "diploid long, block_id int, pos long, filter string, gt string, seq long"
    blocks = spark.createDataFrame([(0, 1, 5)], "block_id int, start long, end long")
    assert rows(prepare_states(spark.createDataFrame([], schema), blocks, order="seq")) == []
    twice = spark.createDataFrame([(1, 0, 2, "PASS", "0/1", 1), (1, 0, 2, "PASS", "0/0", 0), (1, 0, 4, ".", "1/0", 2)], schema)
    kept = prepare_states(twice, blocks, order="seq", duplicates="keep_first").select("start_pos", "end_pos", "state")
    assert rows(kept) == [(1, 1, 2), (2, 3, 0), (4, 4, 1), (5, 5, 0)]
    with pytest.raises(Exception, match="repeated position 2"):
        prepare_states(twice, blocks, order="seq").collect()


def test_maps_of_one_plan(spark):
    blocks = spark.createDataFrame(
        [(0, "chr1", 1, 10, 1, 10)], "block_id int, chrom string, start long, end long, lower_cut long, upper_cut long"
    )
    sites = spark.createDataFrame(
        [(d, 0, p, None if p == 2 else float(p), 1.0) for d in (1, None) for p in range(1, 6)],
        "diploid long, block_id int, pos long, value double, tmrca double",
    )
    states = spark.createDataFrame(
        [(1, 0, 1, 3, 1), (1, 0, 4, 4, 2), (1, 0, 5, 5, 0), (1, 0, 6, 10, 2)],
        "diploid long, block_id int, start_pos long, end_pos long, state int",
    )
    found = genome_maps(sites, states, blocks, [5, 10]).select(
        F.coalesce("diploid", F.lit(-1)).alias("d"), "bin_size", "bin", "value", "tmrca", "missing", "diversity", "chrom_start", "chrom_end"
    )
    got = {(r.d, r.bin_size, r.bin): tuple(r)[3:] for r in found.collect()}
    assert got == {
        (1, 5, 0): (3.25, 1.0, 0.2, 0.75, 0, 5),
        (1, 5, 1): (None, None, 1.0, None, 5, 10),
        (1, 10, 0): (3.25, 1.0, 0.6, 0.75, 0, 10),
        (-1, 5, 0): (3.25, 1.0, None, None, 0, 5),
        (-1, 10, 0): (3.25, 1.0, None, None, 0, 10),
    }


def test_spans_without_a_position_raise(spark):
    spans = spark.createDataFrame([(1, None)], "start_pos long, end_pos long")
    with pytest.raises(Exception, match="span without"):
        split_at_tiles(spans).collect()
