"""Streaming audit append with checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickloom.operators.governance import with_checksum
from tickloom.sources.audit_log import TIME_FORMAT


def audit_writer(path: str, stream: str | None = None):
    """A foreachBatch handler that appends sealed records.

    Each micro-batch of each stream has its own folder, overwritten when the
    batch is retried, so a restart after a failure does not append it twice.
    The folder carries the stream's id, which its checkpoint keeps: a stream
    with a new checkpoint starts again at batch 0 and must not overwrite older
    records.  `stream` names it instead, where batches are written by hand.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        name = stream or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not name:
            raise ValueError("no running stream: give its name")
        with_checksum(batch).write.mode("overwrite").option("timestampFormat", TIME_FORMAT).json(f"{path}/stream={name}/batch={batch_id}")

    return handle
