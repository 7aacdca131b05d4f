"""Sequence text: aligned haplotypes, callability codes, SNP matrices and state sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuswise.operators.runs import as_runs
from locuswise.operators.scoring import FRAGMENT, pack_fragments
from locuswise.sources.lines import numbered_lines

CHUNK = 1 << 16


def _records(spark: SparkSession, path) -> DataFrame:
    """(file, record, name, piece, text): records in file order, cut into pieces of bounded length.

    A record begins with ``>`` at the start of a line; the sign may stand in a name as well. A record without
    symbols keeps its number and has no pieces.
    """
    raw = numbered_lines(spark, path, keep=F.trim("value") != "", separator="\n>")
    parts = F.split(F.regexp_replace("value", r"\A\s*>", ""), "\n", 2)
    head = F.trim(F.regexp_replace(parts[0], "\r$", ""))
    body = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "")
    return raw.select(
        "file",
        F.col("line").alias("record"),
        head.alias("name"),
        F.posexplode(F.regexp_extract_all(body, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))).alias("piece", "text"),
    )


def _characters(pieces: DataFrame, *keys) -> DataFrame:
    return pieces.select(
        *keys, "piece", F.posexplode(F.split("text", "")).alias("i", "symbol")
    ).select(
        *keys,
        (F.col("piece").cast("long") * CHUNK + F.col("i") + 1).alias("pos"),
        "symbol",
    )


def read_haplotype_pieces(spark: SparkSession, path) -> DataFrame:
    """(hap, name, piece, text): records cut into pieces of ``CHUNK`` symbols, ready for pairing."""
    return _records(spark, path).select(
        F.col("record").alias("hap"), "name", "piece", F.upper("text").alias("text")
    )


def read_haplotypes(spark: SparkSession, path) -> DataFrame:
    """(hap, name, pos, base): aligned records, numbered from 0 in the order of their file."""
    return haplotype_sites(read_haplotype_pieces(spark, path), "hap", "name")


def haplotype_sites(pieces: DataFrame, *keys) -> DataFrame:
    """(keys, pos, base) from pieces: a symbol has no work of its own but its row, so keys are best made before."""
    return _characters(pieces, *keys).withColumnRenamed("symbol", "base")


def read_mask_codes(spark: SparkSession, path) -> DataFrame:
    """(chrom, pos, code): one record per chromosome."""
    named = _records(spark, path).withColumn("chrom", F.split("name", r"\s+")[0])
    return _characters(named, "chrom").select("chrom", "pos", F.col("symbol").alias("code"))


def read_snp_matrix(spark: SparkSession, path) -> DataFrame:
    """(file, hap, pos, base): a header line, then one line per site, one character per haplotype."""
    lines = numbered_lines(spark, path).filter(F.col("line") > 0)
    chars = F.regexp_replace("value", r"\s", "")
    return lines.filter(chars != "").select(
        "file", F.col("line").alias("pos"), F.posexplode(F.split(chars, "")).alias("hap", "base")
    ).select("file", F.col("hap").cast("long").alias("hap"), "pos", "base")


def write_state_fasta(states: DataFrame, blocks: DataFrame, path: str, size: int = FRAGMENT) -> None:
    """Per block, gzip text records of 0/1/2 strings: ``>diploid fragment first_site``.

    Built from runs, so no site is ever a row; a record is one fragment to bound its length.
    """
    packed = pack_fragments(as_runs(states), blocks, size)
    text = F.array_join(
        F.zip_with("symbols", "lengths", lambda s, n: F.call_function("repeat", s.cast("string"), n)), ""
    )
    head = F.concat_ws(" ", F.concat(F.lit(">"), F.col("diploid")), "file_index", "frag_start")
    (
        packed.select("block_id", F.concat(head, F.lit("\n"), text).alias("value"))
        .write.partitionBy("block_id")
        .option("compression", "gzip")
        .text(path)
    )


def read_state_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(diploid, block_id, pos, state) from what :func:`write_state_fasta` wrote."""
    from locuswise.sources.lines import path_number

    f = F.split("name", " ")
    keyed = _records(spark, path).select(
        f[0].cast("long").alias("diploid"),
        path_number("block_id").alias("block_id"),
        f[2].cast("long").alias("first"),
        "piece",
        "text",
    )
    sites = _characters(keyed, "diploid", "block_id", "first")
    return sites.select(
        "diploid",
        "block_id",
        (F.col("first") + F.col("pos") - 1).alias("pos"),
        F.col("symbol").cast("int").alias("state"),
    )
