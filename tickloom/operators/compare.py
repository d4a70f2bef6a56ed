"""Champion / challenger comparison on fold metrics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.prefix import average_ranks
from tickloom.functions.pricing import normal_cdf
from tickloom.functions.scalars import attach_row

# Verdict limits (fixed values).
ALPHA = 0.05
MIN_DELTA = 0.01
EXACT_UP_TO = 8
# Most values of U that the exact distribution is built for (one small list in a task).
EXACT_VALUES = 100_000


def _ways(n1: int, n2: int) -> list[int]:
    """Number of orderings of two samples for every value of U."""
    counts = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        for u in range(i + n2, n1 * n2 + 1)[::-1]:
            counts[u] -= counts[u - i - n2]
        for u in range(i, n1 * n2 + 1):
            counts[u] += counts[u - i]
    return counts


@F.pandas_udf(T.DoubleType())
def _exact_p(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    """Two-sided exact p-value; called for small samples without ties only."""

    def one(a, b, value):
        ways = _ways(int(a), int(b))
        return min(1.0, 2 * sum(ways[math.ceil(value):]) / sum(ways))

    return pd.Series([one(*row) for row in zip(n1, n2, u)], dtype=float)


def mann_whitney(values: DataFrame, keys: list[str] | None = None, method: str = "auto") -> DataFrame:
    """Two-sided U test of (challenger BOOLEAN, value) rows.

    `method`: "exact" (the distribution of U; NULL with ties or more than 100,000 values of U), "asymptotic" (the normal
    approximation with tie and continuity correction) or "auto": exact where the smaller sample has at most 8 values
    and that is possible, else asymptotic.
    """
    if method not in ("auto", "exact", "asymptotic"):
        raise ValueError(f"method {method!r}")
    given = keys or []
    rows = values if given else values.withColumn("_all", F.lit(0))
    keys = given or ["_all"]
    table = average_ranks(rows, keys, "value", {"mine": F.col("challenger").cast("long")})
    n = F.col("n").cast("double")
    sums = table.groupBy(*keys).agg(
        F.sum("mine").cast("double").alias("n1"), F.sum(F.col("n") - F.col("mine")).cast("double").alias("n2"),
        F.sum(F.col("mine") * F.col("avg_rank")).alias("_r"), F.sum(n * n * n - n).alias("_ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    total = n1 + n2
    u = sums.withColumn("u", F.col("_r") - n1 * (n1 + 1) / 2)
    larger = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    spread = F.sqrt(n1 * n2 / 12 * (total + 1 - F.try_divide(F.col("_ties"), total * (total - 1))))
    tail = F.least(2 * (1 - normal_cdf(F.try_divide(larger - n1 * n2 / 2 - 0.5, spread))), F.lit(1.0))
    exact = (F.col("_ties") == 0) & (n1 * n2 <= EXACT_VALUES)
    if method == "auto":
        exact = exact & (F.least("n1", "n2") <= EXACT_UP_TO)
    elif method == "asymptotic":
        exact = F.lit(False)
    other = F.lit(None).cast("double") if method == "exact" else F.col("_normal")
    staged = u.withColumns({"_exact": exact, "_larger": larger, "_normal": F.coalesce(tail, F.lit(1.0))})
    # The helper sees zeros unless the exact value is wanted.
    sized = [F.when(F.col("_exact"), c).otherwise(0.0) for c in (n1, n2, F.col("_larger"))]
    return staged.withColumn("_p", _exact_p(*sized)).select(
        *given, n1.cast("long").alias("n_challenger"), n2.cast("long").alias("n_champion"), "u",
        F.when(F.col("_exact"), F.col("_p")).otherwise(other).alias("p_value"),
    )


def _mean(value: str, challenger: bool) -> Column:
    side = F.col("challenger") if challenger else ~F.col("challenger")
    return F.avg(F.when(side, F.col(value)))


def ab_compare(folds: DataFrame, alpha: float = ALPHA, min_delta: float = MIN_DELTA) -> DataFrame:
    """Verdict from fold rows (challenger BOOLEAN, f1, pr_auc, brier)."""
    side = F.col("challenger")
    variance = lambda s: F.var_samp(F.when(s, F.col("f1")))
    stats = folds.agg(
        _mean("f1", False).alias("f1_champion"), _mean("f1", True).alias("f1_challenger"),
        (_mean("pr_auc", True) - _mean("pr_auc", False)).alias("pr_auc_delta"),
        (_mean("brier", False) - _mean("brier", True)).alias("brier_delta"),
        F.sqrt((variance(side) + variance(~side)) / 2).alias("_spread"),
    )
    test = mann_whitney(folds.select("challenger", F.col("f1").alias("value")))
    delta = F.col("f1_challenger") - F.col("f1_champion")
    significant = F.col("p_value") < alpha
    return attach_row(stats, test).select(
        "f1_champion", "f1_challenger", delta.alias("f1_delta"), "pr_auc_delta", "brier_delta", "u", "p_value",
        significant.alias("is_significant"),
        (delta / F.greatest(F.coalesce("_spread", F.lit(0.0)), F.lit(1e-6))).alias("effect_size"),
        F.when(significant & (delta > min_delta), "challenger")
        .when(significant & (delta < -min_delta), "champion").otherwise("tie").alias("winner"),
    )
