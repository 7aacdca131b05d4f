"""Readers and writers on small files in the supported formats."""

import gzip

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from locuswise.operators import bins, blocks, calling, simulated
from locuswise.sources import bedgraph, landscapes, sequences, tables, variants


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        data = text.encode()
        path.write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
        return str(path)

    return write


def test_blocks(spark, put):
    path = put("a.tab", "chr9\t10\t100\t0\t90\t20\t90\n\n chr10 \t1\t50\t0\t49\t1\t60\n")
    assert rows(tables.read_blocks(spark, path)) == [(0, "chr9", 10, 100, 20, 90), (1, "chr10", 1, 50, 1, 60)]
    with pytest.raises(PySparkException):
        tables.read_blocks(spark, put("b.tab", "chr1\t1\t2\n")).collect()


VCF = """##fileformat
##other
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
chr1\t3\t.\tA\tC\t.\tPASS\t.\tGT:DP\t0/0:3\t0|1:9
chr1\t5\t.\tA\tC\t.\t.\t.\tGT\t./.\t10/1
chr1\t6\t.\tA\tC\t.\tq10\t.\tGT\t0/1\t1/1
chr1\t7\t.\tA\tC\t.\t30\t.\tGT\t1\t10/10
chr2\t2\t.\tA\tC\t.\tPASS\t.\tGT\t0/1\t.
"""


@pytest.mark.parametrize("name", ["c.vcf", "c.vcf.gz"])
def test_variants_to_runs(spark, put, name):
    calls = variants.read_variants(spark, put(name, VCF))
    states = {(r.chrom, r.pos, r["sample"]): r.state for r in calling.call_state(calls).collect()}
    assert states == {
        ("chr1", 3, "s1"): 0, ("chr1", 3, "s2"): 1, ("chr1", 5, "s1"): 2, ("chr1", 5, "s2"): 1,
        ("chr1", 6, "s1"): 2, ("chr1", 6, "s2"): 2, ("chr1", 7, "s1"): 0, ("chr1", 7, "s2"): 0,
        ("chr2", 2, "s1"): 1, ("chr2", 2, "s2"): 2,
    }
    assert calling.call_state(calls, 40.0).filter("pos = 7 AND state = 2").count() == 2
    only = variants.read_variants(spark, put(name, VCF), chroms=["chr2"])
    assert {r.chrom for r in only.collect()} == {"chr2"}


def test_variants_without_format_and_without_header(spark, put):
    text = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tx\nchr1\t1\t.\tA\tC\t.\tPASS\t.\t0/1\n"
    assert rows(variants.read_variants(spark, put("d.vcf", text))) == [("chr1", 1, "PASS", "x", "0/1")]
    with pytest.raises(ValueError):
        variants.read_variants(spark, put("e.vcf", "chr1\t1\n"))


def test_rows_of_unknown_chromosomes_are_not_lost(spark):
    known = spark.createDataFrame([("chr1", 0)], "chrom string, block_id int")
    data = spark.createDataFrame([("chr1", 1), ("chrX", 2), (None, 3)], "chrom string, pos long")
    with pytest.raises(PySparkException, match="without a block"):
        tables.with_block_ids(data, known).collect()
    assert tables.with_block_ids(data, known, unknown="null").count() == 3
    assert tables.with_block_ids(data, known, unknown="drop").count() == 1


def test_repeated_positions(spark):
    data = spark.createDataFrame([(1, 0, 5, "a", 1), (1, 0, 5, "b", 0), (1, 0, 6, "c", 2)], "diploid long, block_id int, pos long, gt string, seq int")
    assert rows(calling.duplicate_positions(data)) == [(1, 0, 5, 2)]
    assert rows(calling.resolve_duplicates(data, "seq", "keep_first").select("pos", "gt")) == [(5, "b"), (6, "c")]
    with pytest.raises(PySparkException, match="repeated position"):
        calling.resolve_duplicates(data, "seq").collect()


def test_masks(spark, put):
    assert rows(variants.read_mask_bed(spark, put("m.bed.gz", "chr1\t0\t5\nchr2\t3\t4\n"))) == [("chr1", 0, 5), ("chr2", 3, 4)]
    with pytest.raises(PySparkException):
        variants.read_mask_bed(spark, put("n.bed", "chr1\t0\t5\n\nchr1\t7\t9\n")).collect()
    codes = sequences.read_mask_codes(spark, put("m.fa", ">chr1 x\n1P\n0N\n>chr2\nP\n"))
    assert rows(codes) == [("chr1", 1, "1"), ("chr1", 2, "P"), ("chr1", 3, "0"), ("chr1", 4, "N"), ("chr2", 1, "P")]


FASTA = ">h0\nACG\nT-A\n>h1\nACCTNA\n>h2\naggt\nac\n"


def test_haplotype_pairs(spark, put, monkeypatch):
    path = put("h.fa", FASTA)
    monkeypatch.setattr(sequences, "CHUNK", 4)
    pairs = spark.createDataFrame(calling.haplotype_pairs([0, 1, 1, 2]), "diploid long, hap1 long, hap2 long")
    want = sorted(
        [(0, p, s) for p, s in enumerate([0, 0, 1, 0, 2, 0], 1)] + [(1, p, s) for p, s in enumerate([0, 1, 1, 0, 2, 1], 1)]
    )
    pieces = sequences.read_haplotype_pieces(spark, path)
    assert rows(calling.pair_sequences(pieces, pairs, 4)) == want
    long = sequences.read_haplotypes(spark, path).drop("name")
    assert rows(calling.pair_haplotypes(long, pairs).select("diploid", "pos", "state")) == want
    for bad in ([0, 1, 2], [0, 0]):
        with pytest.raises(ValueError):
            calling.haplotype_pairs(bad)


def test_names_with_the_record_sign_and_records_without_symbols(spark, put):
    found = rows(sequences.read_haplotypes(spark, put("g.fa", ">h1 note a>b\nAC\n>h2\n>h3\r\nGT\r\n")))
    assert found == [(0, "h1 note a>b", 1, "A"), (0, "h1 note a>b", 2, "C"), (2, "h3", 1, "G"), (2, "h3", 2, "T")]


def test_snp_matrix(spark, put):
    out = sequences.read_snp_matrix(spark, put("s.txt", "a b c\n0 1 2\n110\n"))
    assert rows(out.select("hap", "pos", "base")) == [(0, 1, "0"), (0, 2, "1"), (1, 1, "1"), (1, 2, "1"), (2, 1, "2"), (2, 2, "0")]


def test_line_numbers_over_many_splits(spark, put):
    from locuswise.sources.lines import numbered_lines

    path = put("big.txt", "".join(f"line{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = numbered_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line, r.value) for r in got) == [(i, f"line{i}") for i in range(5000)]


@pytest.fixture(scope="module")
def blocks_table(spark):
    return spark.createDataFrame([(0, "chr1", 1, 10, 1, 10)], "block_id int, chrom string, start long, end long, lower_cut long, upper_cut long")


def test_state_fasta(spark, blocks_table, tmp_path):
    data = [(d, 0, s, e, x) for d in (1, 2) for s, e, x in [(1, 3, 0), (4, 4, d % 2), (5, 10, 2)]]
    runs = spark.createDataFrame(data, "diploid long, block_id int, start_pos long, end_pos long, state int")
    path = str(tmp_path / "states")
    sequences.write_state_fasta(runs, blocks_table, path, 4)
    got = {(r.diploid, r.pos): r.state for r in sequences.read_state_fasta(spark, path).collect()}
    assert got == {(d, p): x for d, _, s, e, x in data for p in range(s, e + 1)}


def test_landscape_text(spark, blocks_table, tmp_path):
    data = [(d, 0, p, p / 8 + d, p % 3) for d in (1, 2) for p in range(1, 11)]
    table = spark.createDataFrame(data, "diploid int, block_id int, pos long, value double, k int")
    frags = blocks.fragment_blocks(blocks_table, 4)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    landscapes.write_landscape_text(table, frags, 4, one)
    landscapes.write_landscape_text(table, frags, 4, two, ("k", "value"))
    assert rows(landscapes.read_landscape_text(spark, one).select("diploid", "block_id", "pos", "value")) == sorted(r[:4] for r in data)
    assert rows(landscapes.read_landscape_pair(spark, two).select("diploid", "block_id", "pos", "rate", "k")) == sorted(data)


def test_fragments_that_share_a_file(spark, blocks_table, tmp_path):
    data = [(d, 0, p, p / 8 + d, p % 3) for d in (1, 2) for p in range(1, 11)]
    table = spark.createDataFrame(data, "diploid int, block_id int, pos long, value double, k int")
    path = str(tmp_path / "shared")
    landscapes.write_landscape_text(table, blocks.fragment_blocks(blocks_table, 2), 2, path, ("k", "value"), 3)
    found = spark.read.text(path)
    assert rows(found.select("diploid", "file_index").distinct()) == [(d, i) for d in (1, 2) for i in (1, 4)]
    assert len(found.inputFiles()) == 4
    assert rows(landscapes.read_landscape_pair(spark, path).select("diploid", "block_id", "pos", "rate", "k")) == sorted(data)


def test_lines_of_compressed_files_are_never_broadcast(spark, put):
    from locuswise.sources.lines import numbered_lines

    path = put("rows.txt.gz", "".join(f"line{i}\n" for i in range(50)))
    plan = numbered_lines(spark, path)._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_bedgraph(spark, blocks_table, tmp_path):
    data = [(d, 0, p, float(p + d)) for d in (1, 2) for p in range(1, 11)]
    land = spark.createDataFrame(data, "diploid int, block_id int, pos long, value double")
    made = bins.bin_rate(land, blocks_table, [4, 8])
    joint = made.filter("diploid = 1").withColumn("value", F.lit(0.5))
    paths = bedgraph.write_bedgraph(made, blocks_table, str(tmp_path / "x.rho"), [1, 2], [4, 8], joint)
    got = rows(bedgraph.read_bedgraph(spark, paths[0], "x", "4b").select("chrom_start", "chrom_end", "diploid", "value"))
    assert got[:4] == [(0, 4, "1", 3.5), (0, 4, "2", 4.5), (0, 4, "joint_decode", 0.5), (0, 4, "sample_mean", 4.0)]
    assert got[-1][:2] == (8, 10)
    assert [bedgraph.size_suffix(s) for s in (25_000, 1_000_000, 500)] == ["25kb", "1Mb", "500b"]


def test_estimates(spark, tmp_path):
    table = spark.createDataFrame([("rho", 0.25), ("y0", 1e-9)], "name string, value double")
    path = str(tmp_path / "est")
    tables.write_estimates(table, path, -12.5)
    assert rows(tables.read_estimates(spark, path)) == [("rho", 0.25), ("y0", 1e-9)]
    assert any("LogLikelihood" in r.value for r in spark.read.text(path).collect())


def test_bin_options(spark, blocks_table):
    land = spark.createDataFrame([(1, 0, p, float(p), p % 2) for p in range(1, 11)], "diploid int, block_id int, pos long, value double, k int")
    lossy = {r.bin: r.value for r in bins.bin_rate_dropping_last(land, blocks_table, [4]).collect()}
    assert lossy == {0: 6 / 4, 1: 18 / 4, 2: 9 / 2}
    empty = bins.bin_rate_in_time(land, blocks_table, [4], 5, 9).collect()
    assert all(r.value is None and r.sites_in_time == 0 for r in empty)
    fine = {r.bin: (r.value, r.sites) for r in bins.bin_rate(land, blocks_table, [5]).collect()}
    assert fine == {0: (3.0, 5), 1: (8.0, 5)}


def test_slices(spark):
    sites = spark.createDataFrame([(1, 0, p, 0) for p in range(1, 6)], "diploid long, block_id int, pos long, state int")
    assert calling.slice_range(sites, 2, 4).count() == 3
    with pytest.raises(PySparkException, match="leaves block"):
        calling.slice_range(sites, 2, 9).collect()
    with pytest.raises(ValueError):
        calling.slice_range(sites, 4, 2)


def test_simulated_positions(spark):
    hits = spark.createDataFrame([(0, 5, 1), (0, 5, 2), (0, 6, 3), (0, 9, 4), (0, 5, 5)], "hap long, pos long, seq long")
    assert rows(simulated.shift_collisions(hits, ["hap"], "seq").select("pos", "seq")) == [(5, 1), (6, 2), (9, 4)]
    dense = simulated.densify_haplotypes(hits.select("hap", "pos").distinct(), 12, tile=5)
    assert rows(dense) == [(0, p, int(p in (5, 6, 9))) for p in range(1, 13)]


def test_dense_positions_are_not_shuffled(spark):
    hits = spark.createDataFrame([(0, 5), (0, 5), (0, 10), (0, 11), (0, 13), (1, 0), (2, 1), (2, 12), (None, 3)], "hap long, pos long")
    dense = simulated.densify_haplotypes(hits, 12, tile=5)
    got = sorted((-1 if r.hap is None else r.hap, r.pos, r.base) for r in dense.collect())
    derived = {(0, 5), (0, 10), (0, 11), (2, 1), (2, 12)}
    assert got == [(h, p, int((h, p) in derived)) for h in (-1, 0, 1, 2) for p in range(1, 13)]
    made = "explode(sequence("
    plan = dense._jdf.queryExecution().sparkPlan().toString().lower()
    # positions become rows above every join: nothing is left to bring together
    assert plan.index(made) < plan.index("join")


def test_dense_pieces_of_many_haplotypes(spark):
    """Several haplotypes a piece, hits that share a position, hits that come twice, a null haplotype."""
    derived = {(h, p) for h in range(11) for p in range(1, 18) if (h * 7 + p * p) % 5 == 0} | {(11, 17), (12, 1), (13, 99)}
    rows_ = [*derived, *list(derived)[:20], (None, 4), (None, 4)]
    for haps, tile in ((1, 4), (3, 5), (100, 17), (4, 100)):
        dense = simulated.densify_haplotypes(spark.createDataFrame(rows_, "hap long, pos long"), 17, tile, haps).collect()
        got = sorted((-1 if r.hap is None else r.hap, r.pos, r.base) for r in dense)
        assert got == [(h, p, int((h, p) in derived)) for h in sorted({-1, *(h for h, _ in derived)}) for p in range(1, 18)]


def test_dense_form_takes_less_than_a_byte_a_row(spark, tmp_path):
    """The result is as long as haplotypes times positions, so what a row takes decides whether it fits a disk."""
    hits = spark.range(3000).select((F.col("id") % 30).alias("hap"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) + 1).alias("pos"))
    simulated.densify_haplotypes(hits, 100_000).write.parquet(str(tmp_path / "dense"))
    assert sum(f.stat().st_size for f in (tmp_path / "dense").glob("*.parquet")) < 30 * 100_000
