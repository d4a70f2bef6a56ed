"""Append-only audit table as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas


# Microseconds, which the checksum covers.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def append_audit(records: DataFrame, path: str) -> None:
    records.write.mode("append").option("timestampFormat", TIME_FORMAT).json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All well-formed records in time order; malformed lines are skipped."""
    reader = spark.read.schema(schemas.AUDIT).option("mode", "DROPMALFORMED").option("timestampFormat", TIME_FORMAT)
    return reader.json(path).filter(F.col("timestamp").isNotNull()).orderBy("timestamp")
