"""Streams over several micro-batches give the batch result, and run from any working folder."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from locuswise import bindings as b
from locuswise.catalog import hmm, streams
from locuswise.operators import calling, runs, scoring


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    """The events in ts order, as several files with rising modification times."""
    path = tmp_path_factory.mktemp("stream")
    events = b.table(spark, small, "events").orderBy("ts").toPandas()
    import pyarrow as pa
    import pyarrow.parquet as pq

    step = -(-len(events) // 5)
    for i in range(5):
        part = pa.Table.from_pandas(events.iloc[i * step : (i + 1) * step], preserve_index=False)
        file = path / f"events_{i}.parquet"
        pq.write_table(part, file, coerce_timestamps="us")
        os.utime(file, (1_000_000 + i, 1_000_000 + i))
    return str(path)


def test_filter_over_batches_equals_one_batch(spark, small, folder):
    def rows(df):
        return {(r.diploid, r.block_id, r.pos): (*r.dist, r.loglik) for r in df.collect()}

    many, one = rows(streams.filtered(spark, folder)), rows(streams.filtered(spark, small))
    assert many.keys() == one.keys() and len(many) > 500
    # of repeats at a position the stream keeps what arrives first, the single batch the lowest id
    raw = b.raw_variants(spark, small)
    repeats = {(r.diploid, r.block_id) for r in calling.duplicate_positions(raw).collect()}
    for key, values in many.items():
        if key[:2] not in repeats:
            assert values == pytest.approx(one[key], abs=1e-9)


def test_last_filtered_loglik_is_the_batch_loglik(spark, small, folder):
    calls = b.calls(spark, small)
    spans = calls.groupBy("diploid", "block_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    filled = calling.fill_gaps(calls, b.event_blocks(spark, small), standard_state=2)
    # positions outside the first and last call carry no information either way
    model = spark.createDataFrame(
        [(0, hmm.TRANS.ravel().tolist(), hmm.EMIS.ravel().tolist())],
        "candidate_id long, trans array<double>, emis array<double>",
    )
    clipped = (
        filled.join(spans, ["diploid", "block_id"])
        .withColumn("start_pos", F.greatest("start_pos", "lo"))
        .withColumn("end_pos", F.least("end_pos", "hi"))
        .filter("start_pos <= end_pos")
        .drop("lo", "hi")
    )
    batch = {
        (r.diploid, r.block_id): r.loglik
        for r in scoring.forward_loglik(runs.rle_encode(clipped), b.event_blocks(spark, small), model).collect()
    }
    last = streams.filtered(spark, small).groupBy("diploid", "block_id").agg(F.max_by("loglik", "pos").alias("ll"))
    checked = 0
    firsts = {(r.diploid, r.block_id): r.lo for r in spans.collect()}
    for r in last.collect():
        # a block whose first fragment starts late still starts from the uniform distribution
        assert firsts[r.diploid, r.block_id] >= 1
        assert r.ll == pytest.approx(batch[r.diploid, r.block_id], abs=1e-9)
        checked += 1
    assert checked == len(batch)


def test_bins_over_batches(spark, small, folder):
    def rows(df):
        return {(r.diploid, r.window_start): (round(r.value, 9), r.sites) for r in df.collect()}

    assert rows(streams.binned(spark, folder)) == rows(streams.binned(spark, small))


def test_jobs_need_no_installed_package(tmp_path):
    """Python workers started elsewhere still find the code, because it travels with the job."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "d = '/root/testdata/sf0.001'\n"
        "assert e.entry(s).count() > 0\n"
        "assert e.queries()['filter_carry'](s, d).count() > 0\n"
        "assert e.queries()['rate_categories'](s, d).count() > 0\n"
        "print('fine')\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-2000:]
