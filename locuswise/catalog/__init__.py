"""Named queries over the driver tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from locuswise.catalog import files, hmm, maps, models, modulated, sites, streams

SECTIONS = (files, sites, maps, models, modulated, hmm, streams)


def queries():
    return {name: run for section in SECTIONS for name, run in section.QUERIES.items()}


def oracles():
    return {name: text for section in SECTIONS for name, text in section.ORACLES.items()}


def flagship(spark, sf_dir):
    """Calls to runs to per-bin missing share and diversity of every diploid, with coordinates."""
    from pyspark.sql import functions as F

    from locuswise import bindings
    from locuswise.operators import bins, blocks

    limits = bindings.event_blocks(spark, sf_dir)
    counted = bins.bin_states(bindings.state_runs(spark, sf_dir), limits, (24, 120))
    shares = counted.withColumns(
        {
            "missing": F.col("missing_sites") / F.col("sites"),
            "diversity": F.col("het_sites") / F.nullif(F.col("sites") - F.col("missing_sites"), F.lit(0)),
        }
    )
    return blocks.window_coords(shares, limits)
