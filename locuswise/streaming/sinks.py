"""Running a stream over what is available and reading its result back."""

from __future__ import annotations

from pyspark.sql import DataFrame

from locuswise.functions.lineage import scratch_folder


def run_available(stream: DataFrame) -> DataFrame:
    """Process all available input into Parquet files under the checkpoint folder; return them."""
    spark = stream.sparkSession
    base = scratch_folder(spark, "stream")
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/log")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
