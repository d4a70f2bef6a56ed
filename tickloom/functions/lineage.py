"""Cut a plan by writing an intermediate table to the shared checkpoint folder.

A table that feeds several branches is computed once instead of once per
branch, and a lost executor re-reads it instead of recomputing it.  Unlike a
cached table it lives on shared storage; unlike an RDD checkpoint it keeps
column pruning, filters and size statistics.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that `small` has broadcast.
SMALL_ROWS = 100_000


_OWN: dict[str, str] = {}
#: Paths of the tables that `cut` has written in this process, in order.
WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session.

    Where it is unset, as in tests under a local master, all tasks share this machine: then a temporary folder of this
    application, which goes when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _OWN:
        _OWN[application] = tempfile.mkdtemp(prefix="tickloom-")
        atexit.register(shutil.rmtree, _OWN[application], ignore_errors=True)
    return _OWN[application]


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for the jobs that run inside; the session's own limit holds where it is lower."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(name))
    if rows is None or 0 < own <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(own))


def cut(df: DataFrame, batch: int | None = None) -> DataFrame:
    """`batch` bounds the rows of an Arrow batch: a task holds a batch several times, on both sides of its Python worker."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    with batches_of(df.sparkSession, batch):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions, written to the shared folder, without the plan that made them.

    For rows that feed many small jobs: every stage carries the plan behind its rows to its tasks.  Unlike a cached table it
    binds no task to the executor that holds it.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """An aggregate that is about to be joined to many rows: written first, and broadcast only if it has few rows.

    Joined lazily, its size is a guess when the plan is made, so the large side would be shuffled on a key with few values.
    A table of more rows is joined as any other.
    """
    table = cut(df)
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables whose readers are done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
