"""From variant records, blocks and masks to the runs that everything else starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locuswise.operators import calling, intervals
from locuswise.operators.runs import rle_encode
from locuswise.sources import tables, variants


def prepare_states(
    records: DataFrame,
    blocks: DataFrame,
    mask: DataFrame | None = None,
    order: str | None = None,
    duplicates: str = "error",
    threshold: float = 0.0,
    standard_state: int = calling.HOMOZYGOUS,
    diploids: DataFrame | None = None,
) -> DataFrame:
    """Maximal runs (diploid, block_id, start_pos, end_pos, state) that cover the blocks.

    ``records(diploid, block_id, pos, filter, gt)`` are called, gaps between them get ``standard_state``, sites under
    ``mask(block_id, start0, end0)`` and the first site of every sequence become missing. With ``order`` a position
    may hold several records: the first one stays, or with ``duplicates="error"`` they raise. Mask intervals of other
    blocks, or past a block's end, change nothing there. Tables without rows give none.
    """
    if order is not None:
        records = calling.resolve_duplicates(records, order, duplicates)
    called = calling.call_state(records, threshold)
    runs = calling.fill_gaps(called, blocks, standard_state, diploids=diploids)
    if mask is not None:
        runs = intervals.mask_by_intervals(runs, mask)
    return rle_encode(calling.mask_first_site(runs))


def read_states(
    spark: SparkSession, calls: str, block_table: str, samples: DataFrame, mask: str | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """Runs and blocks from files; ``samples(sample, diploid)`` names the diploids, ``options`` as above.

    Chromosomes without a block and samples without a diploid raise.
    """
    blocks = tables.read_blocks(spark, block_table)
    found = variants.with_diploid_ids(tables.with_block_ids(variants.read_variants(spark, calls), blocks), samples)
    spans = None if mask is None else tables.with_block_ids(variants.read_mask_bed(spark, mask), blocks)
    return prepare_states(found, blocks, spans, **options), blocks
