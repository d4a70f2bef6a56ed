"""Evaluation of scored rows: (keys, symbol, bar_date, label, score, pred).

Counts and moments are plain grouped aggregates.  Rank metrics first collapse
every group to its distinct scores, then use running totals over score cells,
so one model or fold may hold any share of the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.lineage import small
from tickloom.functions.prefix import average_ranks, exact_percentiles, top_rows
from tickloom.functions.scalars import attach_row

# Alert budgets (fixed values).
ALERT_FRACTIONS = (0.01, 0.05, 0.10)
# Cut-offs tried by the threshold search: 100 even steps.
CUTOFFS = [float(x) for x in np.linspace(0.01, 0.50, 100)]


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def confusion(scored: DataFrame, keys: list[str]) -> DataFrame:
    hit, pred = F.col("label") == 1, F.col("pred")
    return scored.groupBy(*keys).agg(
        F.count_if(~hit & ~pred).alias("tn"), F.count_if(~hit & pred).alias("fp"),
        F.count_if(hit & ~pred).alias("fn"), F.count_if(hit & pred).alias("tp"),
        F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"),
    )


def classification(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 and Brier score."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion(scored, keys).withColumns({
        "accuracy": (tp + tn) / (tp + tn + fp + fn),
        "precision": _zero(F.try_divide(tp, tp + fp)),
        "recall": _zero(F.try_divide(tp, tp + fn)),
        "f1": _zero(F.try_divide(2 * tp, 2 * tp + fp + fn)),
    })


def ranking(scored: DataFrame, keys: list[str]) -> DataFrame:
    """ROC AUC and average precision; 0 when only one class is present."""
    by_score = average_ranks(scored, keys, "score", {"pos": F.col("label").cast("long")})
    totals = scored.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum(F.col("label").cast("long")).alias("positives")
    )
    joined = by_score.join(totals, keys)
    # At or above a score: everything in the group minus what lies below.
    above = F.col("rows") - F.col("upto") + F.col("n")
    pos_above = F.col("positives") - F.col("pos_upto") + F.col("pos")
    step = F.col("pos") * pos_above / above
    sums = joined.groupBy(*keys).agg(
        F.sum(F.col("pos") * F.col("avg_rank")).alias("_ranks"), F.sum(step).alias("_steps"),
        F.first("rows").alias("rows"), F.first("positives").alias("positives"),
    )
    p, n = F.col("positives"), F.col("rows") - F.col("positives")
    return sums.select(
        *keys, "rows", "positives",
        _zero(F.try_divide(F.col("_ranks") - p * (p + 1) / 2, p * n)).alias("roc_auc"),
        F.when(n > 0, _zero(F.try_divide(F.col("_steps"), p))).otherwise(0.0).alias("pr_auc"),
    )


def evaluate(scored: DataFrame, keys: list[str]) -> DataFrame:
    return classification(scored, keys).join(ranking(scored, keys), keys)


def baselines(scored: DataFrame, keys: list[str], state: str = "current_transition") -> DataFrame:
    """Always-negative and persistence (today's state repeats) predictions."""
    options = F.array(
        F.struct(F.lit("always_negative").alias("baseline"), F.lit(0).alias("p")),
        F.struct(F.lit("persistence").alias("baseline"), F.col(state).cast("int").alias("p")),
    )
    rows = scored.select(*keys, "label", F.explode(options).alias("_b")).select(
        *keys, "label", "_b.baseline", (F.col("_b.p") == 1).alias("pred"),
        F.col("_b.p").cast("double").alias("score"),
    )
    return evaluate(rows, [*keys, "baseline"])


def threshold_curve(scored: DataFrame, keys: list[str], cutoffs: list[float] = CUTOFFS) -> DataFrame:
    """Rows and positives at or above every cut-off.

    Each row falls into one of the cut-off intervals; the intervals are counted
    map-side, and only those few counts per key meet the list of cut-offs.
    """
    cuts = F.array(*[F.lit(c) for c in cutoffs])
    step = (cutoffs[-1] - cutoffs[0]) / (len(cutoffs) - 1)
    guess = F.floor((F.col("score") - cutoffs[0]) / step).cast("int")
    guess = F.greatest(F.least(guess, F.lit(len(cutoffs) - 1)), F.lit(-1))
    # The guess may be one off at a cut-off; settle it by comparing.
    guess = F.when(F.get(cuts, guess + 1) <= F.col("score"), guess + 1).otherwise(guess)
    guess = F.when(F.get(cuts, guess) > F.col("score"), guess - 1).otherwise(guess)
    counts = (
        scored.withColumn("_cut", guess).groupBy(*keys, "_cut")
        .agg(F.count("*").alias("_n"), F.sum(F.col("label").cast("long")).alias("_pos"))
    )
    expanded = counts.withColumn("_reach", F.sequence(F.lit(-1), F.col("_cut")))
    curve = expanded.select(*keys, "_n", "_pos", F.explode("_reach").alias("cut"))
    summed = curve.groupBy(*keys, "cut").agg(F.sum("_n").alias("predicted"), F.sum("_pos").alias("tp"))
    everything = summed.filter("cut = -1").select(*keys, F.col("tp").alias("positives"))
    grid = everything.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(len(cutoffs) - 1))))
    return grid.join(summed, [*keys, "cut"], "left").select(
        *keys, "cut", F.get(cuts, F.col("cut")).alias("threshold"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"), F.coalesce("tp", F.lit(0)).alias("tp"), "positives",
    )


def optimize_threshold(train_scored: DataFrame, keys: list[str], beta: float = 2.0, cutoffs: list[float] = CUTOFFS) -> DataFrame:
    """First cut-off with the highest F-beta, from train rows only."""
    b2 = beta * beta
    fbeta = _zero(F.try_divide((1 + b2) * F.col("tp"), b2 * F.col("positives") + F.col("predicted")))
    curve = threshold_curve(train_scored, keys, cutoffs).withColumn("f_beta", fbeta)
    best = F.max(F.struct("f_beta", (-F.col("cut")).alias("c"), "threshold"))
    return curve.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, F.col("_best.threshold").alias("threshold"), F.col("_best.f_beta").alias("f_beta")
    )


def _top(scored: DataFrame, keys: list[str], limits: dict[str, Column]) -> DataFrame:
    return top_rows(
        scored, keys, "score", limits,
        tie_bucket=F.struct("symbol", F.year("bar_date").alias("year")),
        tie_order=[F.col("symbol"), F.col("bar_date")],
    )


def _limits(fractions, rounding) -> dict[str, Column]:
    return {
        f"{f:g}": F.greatest(F.lit(1), rounding(F.col("group_size") * F.lit(float(f)))) for f in fractions
    }


def alerts_at_k(scored: DataFrame, keys: list[str], fractions=ALERT_FRACTIONS) -> DataFrame:
    """Precision, recall and lift of the best ceil(n * fraction) scores."""
    chosen = _top(scored, keys, _limits(fractions, F.ceil))
    hits = chosen.groupBy(*keys, "list", "k").agg(F.sum(F.col("label").cast("long")).alias("hits"))
    base = scored.groupBy(*keys).agg(
        F.sum(F.col("label").cast("long")).alias("_pos"), F.avg(F.col("label").cast("double")).alias("_rate")
    )
    precision = F.col("hits") / F.col("k")
    return hits.join(base, keys).select(
        *keys, F.col("list").cast("double").alias("fraction"), F.col("k").alias("alerts"),
        precision.alias("precision_at_k"),
        _zero(F.try_divide("hits", "_pos")).alias("recall_at_k"),
        _zero(F.try_divide(precision, "_rate")).alias("lift"),
    )


def precision_at_percent(scored: DataFrame, keys: list[str], percents=(1, 5, 10)) -> DataFrame:
    """Precision of the best floor(n * percent / 100) scores, at least one."""
    limits = {
        str(p): F.greatest(F.lit(1), F.floor(F.col("group_size") * p / 100)) for p in percents
    }
    chosen = _top(scored, keys, limits)
    return chosen.groupBy(*keys, F.col("list").cast("int").alias("percent"), F.col("k").alias("rows")).agg(
        F.avg(F.col("label").cast("double")).alias("precision")
    )


def select_alerts(scored: DataFrame, keys: list[str], fraction: float, **only) -> DataFrame:
    """Rows of the best int(n * fraction) scores per key, at least one.

    `only` restricts columns first, for example symbol=["AF", "RF"], model="logistic", horizon=1, period=1998.
    """
    for column, wanted in only.items():
        scored = scored.filter(F.col(column).isin(*(wanted if isinstance(wanted, (list, tuple, set)) else [wanted])))
    chosen = _top(scored, keys, _limits([fraction], F.floor))
    return chosen.drop("list", "k", "group_size")


def rule_baselines(test: DataFrame, keys: list[str]) -> DataFrame:
    """F1 and average precision of three single-feature rules."""
    limit = exact_percentiles(test, keys, "Return_Shock_5d", [0.9], "_cut")
    joined = test.join(small(limit), keys, "left")
    rules = {
        "volatility_slope_positive": F.col("Volatility_Slope_5d") > 0,
        "return_shock_high": F.col("Return_Shock_5d") >= F.col("_cut")[0],
        "bb_width_expanding": F.col("BB_Width_Change_5d") > 0,
    }
    options = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.coalesce(rule, F.lit(False)).alias("pred"))
        for name, rule in rules.items()
    ])
    rows = joined.select(*keys, "label", F.explode(options).alias("_r")).select(
        *keys, "label", "_r.rule", "_r.pred", F.col("_r.pred").cast("double").alias("score")
    )
    return evaluate(rows, [*keys, "rule"]).select(*keys, "rule", "f1", "pr_auc")


def ranked_alerts(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), "symbol", "bar_date")


def fold_summary(scored: DataFrame, keys: list[str], baseline: str | None = "current_transition") -> DataFrame:
    """One row per fold: classification, ranking, top 1 % and 5 % alerts, baseline F1."""
    top = alerts_at_k(scored, keys, (0.01, 0.05)).groupBy(*keys).agg(
        F.max(F.when(F.col("fraction") == 0.05, F.col("precision_at_k"))).alias("precision_at_5pct"),
        F.max(F.when(F.col("fraction") == 0.01, F.col("lift"))).alias("lift_1pct"),
    )
    summary = evaluate(scored, keys).join(top, keys).withColumn(
        "positive_rate", F.col("positives") / F.col("rows")
    )
    if baseline is None:
        return summary
    repeats = classification(scored.withColumn("pred", F.col(baseline) == 1), keys)
    return summary.join(repeats.select(*keys, F.col("f1").alias("baseline_f1")), keys)


def compare_models(summary: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean metrics per model (and horizon, say) and whether it has the best mean F1."""
    means = summary.groupBy(*keys).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in ("f1", "pr_auc", "brier", "baseline_f1")]
    )
    best = means.agg(F.max_by(F.struct(*keys), F.struct("mean_f1", *keys)).alias("_best"))
    return attach_row(means, best).withColumn("best", F.struct(*keys) == F.col("_best")).drop("_best")


def pooled_highlights(summary: DataFrame, alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: best F1 fold, best lift, best rule of that fold, first and last positive rate."""
    best_f1 = summary.agg(F.max(F.struct("f1", "model", "horizon", "period")).alias("b")).select(
        F.col("b.model").alias("best_model"), F.col("b.horizon").alias("horizon"),
        F.col("b.period").alias("period"), F.col("b.f1").alias("best_f1"),
    )
    best_lift = alerts.agg(F.max(F.struct("lift", "model", "period", "fraction")).alias("b")).select(
        F.col("b.lift").alias("best_lift"), F.col("b.model").alias("lift_model"), F.col("b.fraction").alias("lift_fraction")
    )
    matching = rules.join(F.broadcast(best_f1.select("horizon", "period")), ["horizon", "period"], "left_semi")
    best_rule = matching.agg(F.max(F.struct("f1", "rule")).alias("b")).select(
        F.col("b.rule").alias("best_rule"), F.col("b.f1").alias("best_rule_f1")
    )
    rates = summary.groupBy("period").agg(F.avg("positive_rate").alias("r")).agg(
        F.min_by("r", "period").alias("first_positive_rate"), F.max_by("r", "period").alias("last_positive_rate")
    )
    row = best_f1
    for single in (best_lift, best_rule, rates):
        row = attach_row(row, single)
    return row


def fold_regimes(returns: DataFrame, folds: DataFrame, keys: list[str], trading_days: int = 252) -> DataFrame:
    """Low / Medium / High by terciles of each fold's realised volatility.

    `returns` carries (keys, returns) of the test rows.  The terciles are taken
    over one row per fold, not over the rows.
    """
    vols = returns.groupBy(*keys).agg((F.stddev_samp("returns") * F.sqrt(F.lit(float(trading_days)))).alias("realised_vol"))
    vols = vols.join(folds.select(*keys), keys)
    bounds = vols.agg(F.percentile("realised_vol", F.array(F.lit(0.3333), F.lit(0.6667))).alias("_b"))
    regime = (
        F.when(F.col("realised_vol") <= F.col("_b")[0], "Low")
        .when(F.col("realised_vol") <= F.col("_b")[1], "Medium").otherwise("High")
    )
    return attach_row(vols, bounds).withColumn("regime", regime).drop("_b")


def regime_report(summary: DataFrame, regimes: DataFrame, keys: list[str]) -> DataFrame:
    return summary.join(regimes.select(*keys, "regime"), keys).groupBy("regime").agg(
        F.count("*").alias("folds"), F.avg("f1").alias("avg_f1"), F.avg("pr_auc").alias("avg_pr_auc"),
        F.avg("precision_at_5pct").alias("avg_precision_at_5pct"),
        F.avg("positive_rate").alias("avg_positive_rate"),
        F.max("f1").alias("max_f1"), F.min("f1").alias("min_f1"),
    )
