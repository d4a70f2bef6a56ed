"""Running a stream to the end of its input into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickloom.functions.lineage import shared_folder


def run_to_table(stream: DataFrame, spark: SparkSession, output_mode: str = "append") -> DataFrame:
    """Process all available input, return the written table."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = (
        stream.writeStream.outputMode(output_mode).format("parquet")
        .option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/table")
        .trigger(availableNow=True)
    )
    query = writer.start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def run_foreach(stream: DataFrame, spark: SparkSession, handle) -> None:
    """Process all available input with `handle(batch, batch_id)`."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
