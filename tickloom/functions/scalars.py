"""Values of a one-row table next to the rows of another one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(rows: DataFrame, single: DataFrame) -> DataFrame:
    """Add the columns of a keyless aggregate to every row.

    A scalar subquery: Spark runs the aggregate once and uses its values like
    literals, without a join.  An empty table gives NULLs.
    """
    value = single.select(F.struct(*single.columns).alias("v")).scalar()
    return rows.withColumn("_single", value).select("*", "_single.*").drop("_single")
