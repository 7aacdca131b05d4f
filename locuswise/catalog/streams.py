"""Streaming queries over events, run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from locuswise import bindings as b
from locuswise.catalog import sql as q
from locuswise.catalog.hmm import TWO_STATES
from locuswise.catalog.maps import rounded
from locuswise.operators.calling import call_state
from locuswise.streaming.binning import stream_bins
from locuswise.streaming.filtering import stream_filter
from locuswise.streaming.sinks import run_available

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DELAY_SECONDS = 3600


def events_stream(spark, folder, pattern="events*.parquet", files_per_batch=1):
    return (
        spark.readStream.schema(EVENTS)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def binned(spark, folder, pattern="events*.parquet"):
    instant = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"
    sites = events_stream(spark, folder, pattern).select(
        F.col("user_id").alias("diploid"),
        F.lit(0).alias("block_id"),
        F.expr(instant).alias("ts"),
        "value",
    )
    return run_available(stream_bins(sites, "1 day", f"{DELAY_SECONDS} seconds"))


def filtered(spark, folder, pattern="events*.parquet"):
    sites = call_state(b.as_variants(events_stream(spark, folder, pattern)))
    named = sites.withColumnRenamed("event_id", "seq").select("diploid", "block_id", "pos", "state", "seq")
    return run_available(stream_filter(named, TWO_STATES))


def filtered_rows(spark, sf):
    rows = filtered(spark, sf).select(
        "diploid", "block_id", "pos", F.col("dist")[0].alias("p0"), F.col("dist")[1].alias("p1"), "loglik"
    )
    return rounded(rows, "p0", "p1", "loglik", digits=6)


QUERIES = {
    "stream_bins": lambda s, d: rounded(binned(s, d), "value", digits=9),
    "stream_filter": filtered_rows,
}

ORACLES = {
    "stream_bins": f"""
        SELECT user_id AS diploid, 0 AS block_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start,
               round(avg(value), 9) AS value, count(*) AS sites
        FROM events
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL {DELAY_SECONDS} SECOND
        GROUP BY 1, 2, 3""",
    "stream_filter": q.query(q.CALLS + """,
        span AS (SELECT diploid, block_id, min(pos) AS lo, max(pos) AS hi FROM calls GROUP BY 1, 2),
        filled AS (
          SELECT s.diploid, s.block_id, p.pos, p.pos = s.lo AS opens, c.state IS NOT NULL AS seen,
                 CASE coalesce(c.state, 2) WHEN 0 THEN CAST(0.95 AS DOUBLE) WHEN 1 THEN 0.05 ELSE 1 END AS e0,
                 CASE coalesce(c.state, 2) WHEN 0 THEN CAST(0.7 AS DOUBLE) WHEN 1 THEN 0.3 ELSE 1 END AS e1
          FROM span s JOIN (SELECT unnest(range(1, 241)) AS pos) p ON p.pos BETWEEN s.lo AND s.hi
          LEFT JOIN calls c ON c.diploid = s.diploid AND c.block_id = s.block_id AND c.pos = p.pos),
        fwd AS (
          SELECT diploid, block_id, pos, seen, e0 / (e0 + e1) AS a0, e1 / (e0 + e1) AS a1,
                 ln((e0 + e1) / 2) AS ll FROM filled WHERE opens
          UNION ALL
          SELECT diploid, block_id, pos, seen, b0 / (b0 + b1), b1 / (b0 + b1), ll + ln(b0 + b1) FROM (
            SELECT d.diploid, d.block_id, d.pos, d.seen, f.ll,
                   (f.a0 * CAST(0.99 AS DOUBLE) + f.a1 * CAST(0.02 AS DOUBLE)) * d.e0 AS b0,
                   (f.a0 * CAST(0.01 AS DOUBLE) + f.a1 * CAST(0.98 AS DOUBLE)) * d.e1 AS b1
            FROM fwd f JOIN filled d ON d.diploid = f.diploid AND d.block_id = f.block_id AND d.pos = f.pos + 1))""",
        """SELECT diploid, block_id, pos, round(a0, 6) AS p0, round(a1, 6) AS p1, round(ll, 6) AS loglik
        FROM fwd WHERE seen""", recursive=True),
}
