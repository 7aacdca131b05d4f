"""Round trips through every file format, on files that Spark writes from the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from locuswise import bindings as b
from locuswise.catalog import sql as q
from locuswise.catalog.maps import BINNED, DIGITS, FRAGMENT, SIZES, rounded
from locuswise.catalog.models import PARAMS, param_list
from locuswise.catalog.sites import mask_codes
from locuswise.functions.lineage import scratch_folder
from locuswise.functions.tiling import running_total
from locuswise.operators import bins, blocks
from locuswise.sources import bedgraph, landscapes, lines, sequences, tables, variants

FILE_SITES = 1500
#: Positions whose fragments share a file.
FILE_SPAN = 1_000_000


def blocks_file(spark, sf):
    path = scratch_folder(spark, "blocks")
    tables.write_blocks(b.land_blocks(spark, sf), path)
    return tables.read_blocks(spark, path)


def variant_files(spark, sf):
    """One call file per block: header, then a line per position with every diploid as a column."""
    calls = b.variants(spark, sf)
    # the columns of a call file are its samples, so their list fits a row
    samples = calls.select("diploid").distinct().agg(F.sort_array(F.collect_list("diploid")).alias("ids"))
    names = samples.scalar()
    places = running_total(
        calls.select("diploid").distinct().filter("diploid IS NOT NULL"),
        [],
        "diploid",
        F.lit(1),
        "place",
        blocks.ORDER_TILE,
    )
    found = F.when(F.col("place").isNotNull(), F.struct("place", "gt"))
    sites = (
        calls.join(places, "diploid", "left")
        .groupBy("block_id", "pos")
        .agg(F.sort_array(F.collect_list(found)).alias("gts"), F.min("filter").alias("filter"))
        .withColumn("ids", names)
    )
    # what lies between two records of a site is absent: work follows the records and the text, not records x samples
    absent = lambda count: F.repeat(F.lit("\t./."), count.cast("int"))
    before = F.concat(F.array(F.lit(0).cast("long")), F.col("gts.place"))
    called = F.zip_with(
        "gts",
        F.slice(before, 1, F.size("gts")),
        lambda g, last: F.concat(absent(g["place"] - last - 1), F.lit("\t"), g["gt"]),
    )
    filled = F.concat(F.array_join(called, ""), absent(F.size("ids") - F.element_at(before, -1)))
    chrom = F.concat(F.lit("chr"), F.col("block_id") + 1)
    fixed = F.concat_ws("\t", chrom, "pos", F.lit("."), F.lit("A"), F.lit("C"), F.lit("."), "filter", F.lit("."), F.lit("GT"))
    body = F.concat(fixed, filled)
    head = F.concat_ws(
        "\t",
        *[F.lit(c) for c in "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split()],
        F.transform("ids", lambda d: d.cast("string")),
    )
    # the list joins the blocks only after they are told apart: one list per record would have to be sorted otherwise
    headers = calls.select("block_id").distinct().withColumn("ids", names).select(
        "block_id", F.lit(0).cast("long").alias("pos"), F.concat(F.lit("##made for a test\n"), head).alias("value")
    )
    path = scratch_folder(spark, "calls")
    (
        sites.select("block_id", "pos", body.alias("value"))
        .unionByName(headers)
        .repartition("block_id")
        .sortWithinPartitions("block_id", "pos")
        .select("block_id", "value")
        .write.partitionBy("block_id")
        .option("compression", "gzip")
        .text(path)
    )
    return variants.read_variants(spark, path)


def haplotype_files(spark, sf):
    record = F.concat(F.lit(">"), F.col("doc_id"), F.lit("\n"), b.haplotype_text())
    path = scratch_folder(spark, "haplotypes")
    b.table(spark, sf, "documents").select(record.alias("value")).write.text(path)
    pieces = sequences.read_haplotype_pieces(spark, path)
    return sequences.haplotype_sites(pieces.withColumn("hap", F.col("name").cast("long")), "hap")


def site_strings(spark, sf):
    """Per (block, position) the states of diploids 1 to 7 as one string, 2 where absent."""
    by_diploid = F.map_from_entries(F.collect_list(F.struct("diploid", "state")))
    states = F.transform(
        F.sequence(F.lit(1), F.lit(7)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(2)).cast("string")
    )
    return (
        b.lands(spark, sf)
        .groupBy("block_id", "pos")
        .agg(by_diploid.alias("m"))
        .select("block_id", "pos", F.array_join(states, "").alias("value"))
    )


def snp_files(spark, sf):
    sites = site_strings(spark, sf)
    heads = sites.select("block_id").distinct().select(
        "block_id", F.lit(0).cast("long").alias("pos"), F.lit("h1 h2 h3 h4 h5 h6 h7").alias("value")
    )
    path = scratch_folder(spark, "snps")
    (
        sites.unionByName(heads)
        .repartition("block_id")
        .sortWithinPartitions("block_id", "pos")
        .select("block_id", "value")
        .write.partitionBy("block_id")
        .text(path)
    )
    out = sequences.read_snp_matrix(spark, path)
    return out.select(lines.path_number("block_id").alias("block_id"), "hap", "pos", "base")


def mask_files(spark, sf):
    path = scratch_folder(spark, "mask")
    chrom = F.concat(F.lit("chr"), F.col("block_id") + 1)
    line = F.concat_ws("\t", chrom, "start0", "end0")
    b.order_mask(spark, sf).select(line.alias("value")).write.option("compression", "gzip").text(path)
    return variants.read_mask_bed(spark, path)


def code_files(spark, sf):
    """One record of codes per block over the positions that carry one."""
    codes = mask_codes(spark, sf)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda s: s["code"]), "")
    records = codes.groupBy("block_id").agg(text.alias("text"))
    path = scratch_folder(spark, "codes")
    records.select(
        F.concat(F.lit(">chr"), F.col("block_id") + 1, F.lit("\n"), F.col("text")).alias("value")
    ).write.text(path)
    return sequences.read_mask_codes(spark, path)


def state_files(spark, sf):
    path = scratch_folder(spark, "states")
    sequences.write_state_fasta(b.state_runs(spark, sf), b.event_blocks(spark, sf), path, 100)
    return sequences.read_state_fasta(spark, path)


def landscape_files(spark, sf):
    path = scratch_folder(spark, "landscape")
    rows = b.lands(spark, sf).select(
        "diploid", "block_id", "pos", F.lit("rho").alias("metric"), "value"
    )
    landscapes.write_landscape(rows, path)
    return landscapes.read_landscape(spark, path, ["rho"]).select(
        "diploid", "block_id", "pos", "metric", "value"
    )


def pair_files(spark, sf):
    path = scratch_folder(spark, "pairs")
    limits = blocks.fragment_blocks(b.land_blocks(spark, sf), FILE_SITES)
    landscapes.write_landscape_text(b.lands(spark, sf), limits, FILE_SITES, path, ("k", "value"), FILE_SPAN // FILE_SITES)
    return landscapes.read_landscape_pair(spark, path).drop("file_index")


def fragment_files(spark, sf):
    path = scratch_folder(spark, "fragments")
    tables.write_fragments(blocks.fragment_blocks(b.land_blocks(spark, sf), FRAGMENT), path)
    return tables.read_fragments(spark, path)


def map_files(spark, sf):
    limits = b.land_blocks(spark, sf)
    rates = bins.bin_rate(b.lands(spark, sf), limits, [SIZES[-1]])
    ids = sorted(r[0] for r in rates.select("diploid").distinct().collect())
    path = scratch_folder(spark, "maps") + "/rho"
    (made,) = bedgraph.write_bedgraph(rates, limits, path, ids, [SIZES[-1]])
    out = bedgraph.read_bedgraph(spark, made, "rho", bedgraph.size_suffix(SIZES[-1]))
    return rounded(out.filter("value IS NOT NULL"), "value")


def all_map_files(spark, sf):
    """Every resolution written in one call, and all files read back."""
    limits = b.land_blocks(spark, sf)
    rates = bins.bin_rate(b.lands(spark, sf), limits, SIZES)
    # the diploids are the columns of a file, so their list fits a row
    ids = sorted(r[0] for r in rates.select("diploid").distinct().collect())
    made = bedgraph.write_bedgraph(rates, limits, scratch_folder(spark, "maps") + "/rho", ids, SIZES)
    parts = [bedgraph.read_bedgraph(spark, path, "rho", bedgraph.size_suffix(n)) for path, n in zip(made, SIZES, strict=True)]
    return rounded(reduce(lambda x, y: x.unionByName(y), parts).filter("value IS NOT NULL"), "value")


def estimate_files(spark, sf):
    path = scratch_folder(spark, "estimates")
    named = param_list(spark, sf).select(
        F.concat_ws("_", "name", F.col("candidate_id").cast("string")).alias("name"), "value"
    )
    tables.write_estimates(named, path, -1.5)
    return rounded(tables.read_estimates(spark, path), "value")


QUERIES = {
    "read_blocks": blocks_file,
    "read_variants": variant_files,
    "read_haplotypes": haplotype_files,
    "read_snp_matrix": snp_files,
    "read_mask_bed": mask_files,
    "read_mask_codes": code_files,
    "write_state_fasta": state_files,
    "read_state_fasta": state_files,
    "write_landscape": landscape_files,
    "read_landscape": landscape_files,
    "read_landscape_pair": pair_files,
    "write_fragments": fragment_files,
    "read_fragments": fragment_files,
    "write_bedgraph": map_files,
    "read_bedgraph": map_files,
    "bedgraph_sizes": all_map_files,
    "write_estimates": estimate_files,
    "read_estimates": estimate_files,
}

STATE_ROWS = q.query(q.DENSE, "SELECT diploid, block_id, pos, state FROM dense")
LANDSCAPE_ROWS = q.query(q.LANDS, "SELECT diploid, block_id, pos, 'rho' AS metric, value FROM lands")
FRAGMENT_ROWS = q.query(q.BLOCKS, f"""
    SELECT block_id, CAST(i AS INTEGER) AS file_index, "start" + (i - 1) * {FRAGMENT} AS frag_start,
           least("end", "start" + i * {FRAGMENT} - 1) AS frag_end
    FROM (SELECT *, unnest(range(1, ("end" - "start") // {FRAGMENT} + 2)) AS i FROM blocks)""")
MAP_ROWS = q.query(BINNED, f"""
    SELECT chrom, chrom_start, chrom_end, diploid, round(value, {DIGITS}) AS value, 'rho' AS label,
           '{SIZES[-1]}b' AS window_size
    FROM (
      SELECT chrom, lo - 1 + bin * bin_size AS chrom_start, least(lo - 1 + (bin + 1) * bin_size, hi) AS chrom_end,
             CAST(diploid AS VARCHAR) AS diploid, sum(value) / count(*) AS value
      FROM binned WHERE bin_size = {SIZES[-1]} GROUP BY chrom, lo, hi, bin, bin_size, diploid
      UNION ALL
      SELECT chrom, lo - 1 + bin * bin_size, least(lo - 1 + (bin + 1) * bin_size, hi), 'sample_mean', avg(value)
      FROM (SELECT chrom, lo, hi, bin, bin_size, diploid, sum(value) / count(*) AS value FROM binned
            WHERE bin_size = {SIZES[-1]} GROUP BY ALL) GROUP BY ALL)""")
ALL_MAP_ROWS = q.query(BINNED, f""",
    per_diploid AS (
      SELECT chrom, lo - 1 + bin * bin_size AS chrom_start, least(lo - 1 + (bin + 1) * bin_size, hi) AS chrom_end,
             diploid, bin_size, sum(value) / count(*) AS value
      FROM binned GROUP BY chrom, lo, hi, bin, bin_size, diploid)
    SELECT chrom, chrom_start, chrom_end, CAST(diploid AS VARCHAR) AS diploid, round(value, {DIGITS}) AS value,
           'rho' AS label, bin_size || 'b' AS window_size
    FROM per_diploid
    UNION ALL
    SELECT chrom, chrom_start, chrom_end, 'sample_mean', round(avg(value), {DIGITS}), 'rho', bin_size || 'b'
    FROM per_diploid GROUP BY chrom, chrom_start, chrom_end, bin_size""")
ESTIMATE_ROWS = q.query(PARAMS, f"""
    SELECT name || '_' || candidate_id AS name, round(value, {DIGITS}) AS value FROM params""")

ORACLES = {
    "read_blocks": q.query(q.BLOCKS, """
        SELECT block_id, chrom, "start", "end", lower_cut, upper_cut FROM blocks"""),
    "read_variants": q.query(q.VARIANTS, """,
        sites AS (SELECT block_id, pos, min(filter) AS filter FROM variants GROUP BY 1, 2),
        ids AS (SELECT DISTINCT diploid FROM variants)
        SELECT 'chr' || (s.block_id + 1) AS chrom, s.pos, s.filter, CAST(i.diploid AS VARCHAR) AS sample,
               coalesce(v.gt, './.') AS gt
        FROM sites s CROSS JOIN ids i
        LEFT JOIN variants v ON v.block_id = s.block_id AND v.pos = s.pos AND v.diploid = i.diploid"""),
    "read_haplotypes": q.query(q.HAPS, "SELECT hap, pos, base FROM haps"),
    "read_snp_matrix": q.query(q.LANDS, """,
        sites AS (SELECT block_id, pos, row_number() OVER (PARTITION BY block_id ORDER BY pos) AS line
                  FROM (SELECT DISTINCT block_id, pos FROM lands))
        SELECT s.block_id, h AS hap, s.line AS pos, CAST(coalesce(l.state, 2) AS VARCHAR) AS base
        FROM sites s CROSS JOIN range(0, 7) r(h)
        LEFT JOIN lands l ON l.block_id = s.block_id AND l.pos = s.pos AND l.diploid = h + 1"""),
    "read_mask_bed": q.query(q.MASK, "SELECT 'chr' || (block_id + 1) AS chrom, start0, end0 FROM mask"),
    "read_mask_codes": q.query(q.LANDS, """
        SELECT 'chr' || (block_id + 1) AS chrom, row_number() OVER (PARTITION BY block_id ORDER BY pos) AS pos,
               CASE WHEN min(k) > 10 THEN 'P' WHEN min(k) > 5 THEN '1' ELSE '0' END AS code
        FROM lands GROUP BY block_id, lands.pos"""),
    "write_state_fasta": STATE_ROWS,
    "read_state_fasta": STATE_ROWS,
    "write_landscape": LANDSCAPE_ROWS,
    "read_landscape": LANDSCAPE_ROWS,
    "read_landscape_pair": q.query(q.LANDS, """
        SELECT diploid, block_id, row_number() OVER (PARTITION BY diploid, block_id ORDER BY pos) AS pos,
               k, value AS rate FROM lands"""),
    "write_fragments": FRAGMENT_ROWS,
    "read_fragments": FRAGMENT_ROWS,
    "write_bedgraph": MAP_ROWS,
    "read_bedgraph": MAP_ROWS,
    "bedgraph_sizes": ALL_MAP_ROWS,
    "write_estimates": ESTIMATE_ROWS,
    "read_estimates": ESTIMATE_ROWS,
}
