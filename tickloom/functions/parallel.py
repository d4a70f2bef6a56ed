"""Independent jobs side by side: driver threads that only submit, each in a scheduler pool of its own."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")

#: Calls that run at once.
WORKERS = 8
_POOL = "spark.scheduler.pool"


def side_by_side(spark: SparkSession, calls: Sequence[Callable[[], Result]], workers: int = WORKERS, pool: str = "side") -> list[Result]:
    """Results of the calls in their order; the first error is raised once all have ended.

    Under `spark.scheduler.mode=FAIR` every thread's jobs get an equal share of the cores; under FIFO the jobs of later
    calls take what earlier ones leave free.  Threads inherit the caller's local properties (job group, description).
    """
    if len(calls) < 2:
        return [call() for call in calls]

    def run(number: int, call: Callable[[], Result]) -> Result:
        spark.sparkContext.setLocalProperty(_POOL, f"{pool}-{number}")
        return call()

    with ThreadPoolExecutor(min(workers, len(calls))) as threads:
        waiting = [threads.submit(inheritable_thread_target(spark)(run), i, call) for i, call in enumerate(calls)]
        return [w.result() for w in waiting]
