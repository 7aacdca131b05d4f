"""Queries over calls, runs, masks and haplotypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from locuswise import bindings as b
from locuswise.catalog import sql as q
from locuswise.operators import blocks, calling, intervals, runs, simulated
from locuswise.plans.ingest import prepare_states
from locuswise.sources.sequences import CHUNK

FILTER_THRESHOLD = 50
MISSING_RUN = 2
GAP_LENGTH = 1
MASKED_BLOCKS = 40
REGION_LENGTH = 100
SLICE = (25, 200)


def flagged(spark, sf):
    flags = calling.pass_filter(b.variants(spark, sf), FILTER_THRESHOLD)
    return flags.select("diploid", "block_id", "pos", "filter", F.col("passes").cast("int").alias("passes"))


def dense_sites(spark, sf):
    return runs.expand_runs(b.state_runs(spark, sf))


def mask_codes(spark, sf):
    """Codes per site from lineitem: part of the values are callable."""
    return b.lands(spark, sf).groupBy("block_id", "pos").agg(
        F.when(F.min("k") > 10, "P").when(F.min("k") > 5, "1").otherwise("0").alias("code")
    )


def hits(spark, sf):
    """One hit per lineitem: supplier as haplotype, part as position."""
    return b.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("hap"),
        (F.col("l_partkey") + 1).alias("pos"),
        F.col("l_orderkey").alias("seq"),
        "l_returnflag",
    )


def dense_haplotypes(spark, sf):
    length = b.table(spark, sf, "part").agg(F.max("p_partkey")).first()[0] + 1
    derived = hits(spark, sf).filter("l_returnflag = 'R'").select("hap", "pos")
    return simulated.densify_haplotypes(derived, length)


def prepared(spark, sf):
    """Event records to runs in one plan, with orders as mask."""
    mask = b.table(spark, sf, "orders").select(
        (F.col("o_custkey") % MASKED_BLOCKS).cast("int").alias("block_id"),
        (F.col("o_orderkey") % b.BLOCK_HOURS).alias("start0"),
        (F.col("o_orderkey") % b.BLOCK_HOURS + 1 + F.col("o_custkey") % 3).alias("end0"),
    )
    return prepare_states(b.raw_variants(spark, sf), b.event_blocks(spark, sf), mask, "event_id", "keep_first")


QUERIES = {
    "prepare_states": prepared,
    "shift_collisions": lambda s, d: simulated.shift_collisions(hits(s, d), ["hap"], "seq").select("hap", "pos"),
    "densify_haplotypes": dense_haplotypes,
    "derive_blocks": lambda s, d: blocks.derive_blocks(b.raw_variants(s, d)),
    "pass_filter": flagged,
    "call_state": lambda s, d: b.calls(s, d),
    "duplicate_positions": lambda s, d: calling.duplicate_positions(b.raw_variants(s, d)),
    "fill_gaps": lambda s, d: calling.fill_gaps(b.calls(s, d), b.event_blocks(s, d)),
    "rle_encode": lambda s, d: b.state_runs(s, d),
    "mask_first_site": lambda s, d: runs.rle_encode(calling.mask_first_site(b.state_runs(s, d))),
    "slice_range": lambda s, d: calling.slice_range(dense_sites(s, d), *SLICE),
    "theta_estimate": lambda s, d: runs.theta_estimate(b.state_runs(s, d)).select(
        F.round("theta", 9).alias("theta"), "diploids"
    ),
    "observed_states": lambda s, d: runs.observed_states(b.state_runs(s, d)),
    "state_counts": lambda s, d: runs.state_counts(b.state_runs(s, d)),
    "variant_counts": lambda s, d: runs.variant_counts(b.state_runs(s, d)),
    "missing_runs": lambda s, d: runs.missing_runs(b.state_runs(s, d), MISSING_RUN),
    "informative_regions": lambda s, d: runs.informative_regions(
        b.state_runs(s, d), GAP_LENGTH, REGION_LENGTH
    ),
    "diploid_labels": lambda s, d: blocks.diploid_labels(b.calls(s, d), "driver"),
    "pair_haplotypes": lambda s, d: calling.pair_sequences(
        b.haplotype_pieces(s, d, CHUNK), b.hap_pairs(s, d), CHUNK
    ),
    "mask_by_intervals": lambda s, d: intervals.mask_by_intervals(b.land_runs(s, d), b.order_mask(s, d)),
    "mask_by_codes": lambda s, d: intervals.mask_by_codes(
        b.lands(s, d).select("block_id", "diploid", "pos", "state"), mask_codes(s, d)
    ),
    "subtract_intervals": lambda s, d: intervals.subtract_intervals(
        b.land_blocks(s, d), b.order_mask(s, d)
    ),
    "block_offsets": lambda s, d: blocks.block_offsets(b.land_blocks(s, d)).select(
        "block_id", "genome_start", "genome_end"
    ),
}

ORACLES = {
    "prepare_states": q.query(q.DENSE + f""",
        hidden AS (
          SELECT DISTINCT o_custkey % {MASKED_BLOCKS} AS block_id,
                 unnest(range(o_orderkey % 240 + 1, o_orderkey % 240 + 2 + o_custkey % 3)) AS pos
          FROM orders),
        seen AS (
          SELECT d.diploid, d.block_id, d.pos, CAST(CASE WHEN d.pos = 1 OR h.pos IS NOT NULL THEN 2 ELSE d.state END AS INTEGER) AS state
          FROM dense d LEFT JOIN hidden h ON h.block_id = d.block_id AND h.pos = d.pos)"""
        + q.islands("seen", "seen_runs"), "SELECT * FROM seen_runs"),
    "shift_collisions": """
        SELECT l_suppkey AS hap, l_partkey + 1 AS pos FROM lineitem
        UNION SELECT l_suppkey, l_partkey + 2 FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) > 1""",
    "densify_haplotypes": """
        WITH derived AS (SELECT DISTINCT l_suppkey AS hap, l_partkey + 1 AS pos FROM lineitem WHERE l_returnflag = 'R'),
        every AS (SELECT hap, unnest(range(1, (SELECT max(p_partkey) + 2 FROM part))) AS pos
                  FROM (SELECT DISTINCT hap FROM derived))
        SELECT e.hap, e.pos, CAST(d.hap IS NOT NULL AS INTEGER) AS base
        FROM every e LEFT JOIN derived d ON d.hap = e.hap AND d.pos = e.pos""",
    "derive_blocks": q.query(q.RAW_VARIANTS, """
        SELECT block_id, min(pos) AS "start", max(pos) AS "end", min(pos) AS lower_cut,
               max(pos) AS upper_cut FROM raw_variants GROUP BY block_id"""),
    "pass_filter": q.query(q.VARIANTS, f"""
        SELECT diploid, block_id, pos, filter, CAST(filter IN ('PASS', '.') OR
               coalesce(TRY_CAST(filter AS DOUBLE), 0) > {FILTER_THRESHOLD} AS INTEGER) AS passes
        FROM variants"""),
    "call_state": q.query(q.CALLS, "SELECT diploid, block_id, pos, state FROM calls"),
    "duplicate_positions": q.query(q.RAW_VARIANTS, """
        SELECT diploid, block_id, pos, count(*) AS records FROM raw_variants
        GROUP BY 1, 2, 3 HAVING count(*) > 1"""),
    "fill_gaps": q.query(q.CALLS, """,
        fenced AS (
          SELECT diploid, block_id, pos, state FROM calls
          UNION ALL SELECT DISTINCT diploid, block_id, 0, NULL FROM calls
          UNION ALL SELECT DISTINCT diploid, block_id, 241, NULL FROM calls),
        linked AS (
          SELECT *, lag(pos) OVER (PARTITION BY diploid, block_id ORDER BY pos) AS prev FROM fenced)
        SELECT diploid, block_id, pos AS start_pos, pos AS end_pos, state FROM linked
        WHERE state IS NOT NULL
        UNION ALL
        SELECT diploid, block_id, prev + 1, pos - 1, 0 FROM linked WHERE prev + 1 <= pos - 1"""),
    "rle_encode": q.query(q.RUNS, "SELECT diploid, block_id, start_pos, end_pos, state FROM runs"),
    "mask_first_site": q.query(
        q.DENSE + """,
        masked AS (SELECT diploid, block_id, pos, CASE WHEN pos = 1 THEN 2 ELSE state END AS state
                   FROM dense)""" + q.islands("masked", "masked_runs"),
        "SELECT diploid, block_id, start_pos, end_pos, CAST(state AS INTEGER) AS state FROM masked_runs"),
    "slice_range": q.query(q.DENSE, f"""
        SELECT diploid, block_id, pos, state FROM dense WHERE pos BETWEEN {SLICE[0]} AND {SLICE[1]}"""),
    "theta_estimate": q.query(q.DENSE, """
        SELECT round(avg(theta), 9) AS theta, count(*) AS diploids FROM (
          SELECT diploid, sum(CAST(state = 1 AS INTEGER)) / sum(CAST(state <> 2 AS INTEGER)) AS theta
          FROM dense GROUP BY diploid)"""),
    "observed_states": q.query(q.DENSE, """
        SELECT min(n) AS min_states, max(n) AS max_states, count(*) AS diploids, min(n) = max(n) AS agree
        FROM (SELECT diploid, count(DISTINCT state) AS n FROM dense GROUP BY diploid)"""),
    "state_counts": q.query(q.DENSE, """
        SELECT diploid, block_id, state, count(*) AS sites FROM dense GROUP BY 1, 2, 3"""),
    "variant_counts": q.query(q.DENSE, """
        SELECT diploid, count(*) FILTER (state = 1) AS het_sites,
               count(*) FILTER (state <> 2) AS callable_sites,
               count(*) FILTER (state = 2) AS missing_sites FROM dense GROUP BY diploid"""),
    "missing_runs": q.query(q.RUNS, f"""
        SELECT diploid, block_id, start_pos, end_pos, end_pos - start_pos + 1 AS length
        FROM runs WHERE state = 2 AND end_pos - start_pos + 1 >= {MISSING_RUN}"""),
    "informative_regions": q.query(q.RUNS, f""",
        walls AS (
          SELECT diploid, block_id, start_pos, end_pos FROM runs
          WHERE state = 2 AND end_pos - start_pos + 1 >= {GAP_LENGTH}
          UNION ALL SELECT DISTINCT diploid, block_id, 0, 0 FROM runs
          UNION ALL SELECT DISTINCT diploid, block_id, 241, 241 FROM runs),
        linked AS (
          SELECT diploid, block_id, start_pos - 1 AS e,
                 lag(end_pos) OVER (PARTITION BY diploid, block_id ORDER BY start_pos) + 1 AS b
          FROM walls)
        SELECT diploid, block_id, b AS start_pos, e AS end_pos, e - b + 1 AS length
        FROM linked WHERE e - b + 1 > {REGION_LENGTH}"""),
    "diploid_labels": q.query(q.CALLS, """
        SELECT 'driver_diploid_' || row_number() OVER (ORDER BY diploid) AS decoding_label,
               diploid AS diploid_id FROM (SELECT DISTINCT diploid FROM calls)"""),
    "pair_haplotypes": q.query(q.HAPS, """
        SELECT diploid, pos, CAST(CASE WHEN count(*) < 2 OR bool_or(base IN ('-', 'N')) THEN 2
               WHEN min(base) = max(base) THEN 0 ELSE 1 END AS INTEGER) AS state
        FROM (SELECT diploid, unnest([hap1, hap2]) AS hap FROM pairs) JOIN haps USING (hap)
        GROUP BY diploid, pos"""),
    "mask_by_intervals": q.query(
        q.LANDS + "," + q.MASK + """,
        covered AS (
          SELECT l.diploid, l.block_id, l.pos, CASE WHEN m.pos IS NULL THEN l.state ELSE 2 END AS state
          FROM lands l LEFT JOIN masked_sites m ON m.block_id = l.block_id AND m.pos = l.pos)"""
        + q.islands("covered", "covered_runs"),
        "SELECT diploid, block_id, start_pos, end_pos, CAST(state AS INTEGER) AS state FROM covered_runs"),
    "mask_by_codes": q.query(q.LANDS, """,
        codes AS (SELECT block_id, pos, CASE WHEN min(k) > 10 THEN 'P' WHEN min(k) > 5 THEN '1'
                  ELSE '0' END AS code FROM lands GROUP BY 1, 2)
        SELECT l.block_id, l.diploid, l.pos,
               CAST(CASE WHEN c.code IN ('1', 'P') THEN l.state ELSE 2 END AS INTEGER) AS state
        FROM lands l LEFT JOIN codes c ON c.block_id = l.block_id AND c.pos = l.pos"""),
    "subtract_intervals": q.query(q.BLOCKS + "," + q.MASK, """,
        bare AS (
          SELECT block_id, pos FROM (SELECT block_id, unnest(range("start", "end" + 1)) AS pos FROM blocks)
          ANTI JOIN masked_sites USING (block_id, pos))
        SELECT block_id, min(pos) - 1 AS start0, max(pos) AS end0 FROM (
          SELECT *, pos - row_number() OVER (PARTITION BY block_id ORDER BY pos) AS grp FROM bare)
        GROUP BY block_id, grp"""),
    "block_offsets": q.query(q.BLOCKS, """
        SELECT block_id, CAST(genome_end - len AS BIGINT) AS genome_start, genome_end FROM (
          SELECT block_id, "end" - "start" + 1 AS len,
                 CAST(sum("end" - "start" + 1) OVER (ORDER BY block_id) AS BIGINT) AS genome_end
          FROM blocks)"""),
}
