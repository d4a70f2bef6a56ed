"""Spark session defaults used by tests, the bench and examples.

On a cluster the session comes from spark-submit; nothing here is needed then
except the UTC time zone and adaptive execution, which are Spark's defaults or
are set in the cluster's own configuration.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "tickloom", cpus: int | str = "*", memory: str = "12g", shared: str | None = None) -> SparkSession:
    """`shared` is the folder for written intermediate tables (`spark.checkpoint.dir`)."""
    builder = SparkSession.builder.config("spark.checkpoint.dir", shared) if shared else SparkSession.builder
    spark = (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
