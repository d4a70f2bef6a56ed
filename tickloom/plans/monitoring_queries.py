"""Queries over drift, experiment comparison, alert decisions and governance tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.lineage import cut
from tickloom.functions.pricing import cdf_sql
from tickloom.operators import alerts as al
from tickloom.operators import compare, drift, evaluate, governance
from tickloom.plans import views
from tickloom.plans.evaluation_queries import _ALL_CTE, _ALL_NAMES, _all
from tickloom.plans.registry import query, rounded
from tickloom.sources.results import normalize_alerts, normalize_metrics

# --- R drift -------------------------------------------------------------------

_SPLIT = "1999-01-01"
_LONG = _ALL_CTE + ", lf AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, {n}::DOUBLE AS x, bar_date < DATE '{_SPLIT}' AS base FROM f WHERE {n} IS NOT NULL" for n in _ALL_NAMES
) + "), "
_EDGES = "ed AS (SELECT feature, " + ", ".join(f"quantile_cont(x, {i / 10}) AS e{i}" for i in range(11)) + " FROM lf GROUP BY 1), "
_PSI = _LONG + _EDGES + "bn AS (SELECT l.feature, base, " + " + ".join(f"(x >= e{i})::INT" for i in range(1, 10)) + """ AS b FROM lf l JOIN ed USING (feature)),
gr AS (SELECT feature, i FROM (SELECT DISTINCT feature FROM lf) d, range(0, 10) r(i)),
ct AS (SELECT g.feature, g.i, count(*) FILTER (WHERE base) AS nb, count(*) FILTER (WHERE NOT base) AS nc FROM gr g LEFT JOIN bn ON bn.feature = g.feature AND bn.b = g.i GROUP BY 1, 2),
pc AS (SELECT feature, (nb + 1e-6) / sum(nb) OVER (PARTITION BY feature) AS pb, (nc + 1e-6) / sum(nc) OVER (PARTITION BY feature) AS pcur FROM ct),
psi AS (SELECT feature, sum((pcur - pb) * ln(pcur / pb)) AS psi FROM pc GROUP BY 1)
"""


def _halves(spark, sf):
    rows = cut(_all(spark, sf))
    return rows.filter(F.col("bar_date") < F.lit(_SPLIT).cast("date")), rows.filter(F.col("bar_date") >= F.lit(_SPLIT).cast("date"))


@query("psi", f"{_PSI} SELECT feature, round(psi, 6) + 0.0 AS psi FROM psi")
def psi(spark, sf):
    return rounded(drift.psi(*_halves(spark, sf), _ALL_NAMES), {"psi": 6}, ("feature",))


_SEV = "CASE WHEN value > {h} THEN 'high' WHEN value > {m} THEN 'moderate' ELSE 'low' END"
_FD = "fd AS (SELECT feature AS name, 'feature' AS drift_type, psi AS value, 0.25::DOUBLE AS threshold, " + _SEV.replace("value", "psi").format(h=0.25, m=0.10) + " AS severity FROM psi)"


@query("feature_drift", f"{_PSI}, {_FD} SELECT name, drift_type, round(value, 6) + 0.0 AS value, threshold, severity, severity <> 'low' AS is_drift FROM fd")
def feature_drift(spark, sf):
    table = drift.feature_drift(*_halves(spark, sf), _ALL_NAMES)
    return rounded(table, {"value": 6}, ("name", "drift_type", "threshold", "severity", "is_drift"))


_PD = "pd AS (SELECT abs(c.m - b.m) / greatest(b.s, 1e-6) AS value FROM (SELECT avg(score) AS m, stddev_pop(score) AS s FROM sp WHERE period < 1999) b, (SELECT avg(score) AS m FROM sp WHERE period >= 1999) c)"


def _prediction(spark, sf):
    rows = views.scored_periods(spark, sf)
    return drift.prediction_drift(rows.filter("period < 1999"), rows.filter("period >= 1999"))


@query("prediction_drift", f"WITH {views.PERIODS_SQL}, {_PD} SELECT 'prediction_scores' AS name, 'prediction' AS drift_type, round(value, 6) + 0.0 AS value, 2.0::DOUBLE AS threshold, {_SEV.format(h=6, m=2)} AS severity, value > 2 AS is_drift FROM pd")
def prediction_drift(spark, sf):
    return rounded(_prediction(spark, sf), {"value": 6}, ("name", "drift_type", "threshold", "severity", "is_drift"))


_PF = """bt AS (SELECT model, date_trunc('month', bar_date)::DATE AS batch, coalesce(count(*) FILTER (WHERE pred AND label = 1) / nullif(count(*) FILTER (WHERE pred), 0)::DOUBLE, 0.0) AS value FROM sp GROUP BY 1, 2),
pf AS (SELECT *, CAST(sum((value < 0.01)::INT) OVER (PARTITION BY model ORDER BY batch ROWS 2 PRECEDING) AS INTEGER) AS degraded FROM bt)"""
_PF_SEV = "CASE WHEN degraded >= 3 THEN 'high' WHEN degraded >= 2 THEN 'moderate' ELSE 'low' END"


def _performance(spark, sf):
    batches = drift.batch_precision(views.scored_periods(spark, sf), F.trunc("bar_date", "month"), ["model"])
    return drift.performance_drift(batches, 0.02, ["model"])


@query("performance_drift", f"WITH {views.PERIODS_SQL}, {_PF} SELECT model, batch, round(value, 6) + 0.0 AS value, 0.01::DOUBLE AS threshold, degraded, {_PF_SEV} AS severity, degraded >= 2 AS is_drift FROM pf")
def performance_drift(spark, sf):
    return rounded(_performance(spark, sf), {"value": 6}, ("model", "batch", "threshold", "degraded", "severity", "is_drift"))


def monitoring_results(spark, sf):
    """Feature, score and performance drift as (name, drift_type, severity)."""
    performance = _performance(spark, sf).select(F.col("model").alias("name"), F.lit("performance").alias("drift_type"), "severity")
    columns = ["name", "drift_type", "severity"]
    features = drift.feature_drift(*_halves(spark, sf), _ALL_NAMES).select(*columns)
    return features.unionByName(_prediction(spark, sf).select(*columns)).unionByName(performance)


@query(
    "overall_status",
    f"{_PSI}, {_FD}, {views.PERIODS_SQL.replace('bars AS (', 'bars2 AS (', 1).replace('FROM bars ', 'FROM bars2 ')}, {_PD}, {_PF}, al AS (SELECT severity FROM fd UNION ALL SELECT {_SEV.format(h=6, m=2)} FROM pd UNION ALL SELECT {_PF_SEV} FROM pf) "
    "SELECT count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'moderate') AS moderate, "
    "CASE WHEN count(*) FILTER (WHERE severity = 'high') > 0 THEN 'alert' WHEN count(*) FILTER (WHERE severity = 'moderate') > 0 THEN 'caution' ELSE 'healthy' END AS overall_status FROM al",
)
def overall_status(spark, sf):
    return drift.overall_status(monitoring_results(spark, sf))


@query(
    "mean_shift",
    f"{_LONG} ms AS (SELECT feature, avg(x) FILTER (WHERE base) AS a, avg(x) FILTER (WHERE NOT base) AS b, stddev_samp(x) FILTER (WHERE base) AS s FROM lf GROUP BY 1) "
    "SELECT feature, round(a, 4) + 0.0 AS train_mean, round(b, 4) + 0.0 AS test_mean, round(abs(b - a) / nullif(s, 0), 6) + 0.0 AS shift FROM ms",
)
def mean_shift(spark, sf):
    return rounded(drift.mean_shift(*_halves(spark, sf), _ALL_NAMES), {"train_mean": 4, "test_mean": 4, "shift": 6}, ("feature",))


# --- A6, A5 result tables ---------------------------------------------------------


@query(
    "load_result_metrics",
    f"WITH {views.FOLD_METRICS_SQL} SELECT model, period AS fold_id, round(round(f1 * 100, 1) / 100, 6) + 0.0 AS f1, round(round(pr_auc, 3), 6) + 0.0 AS pr_auc FROM fm",
)
def load_result_metrics(spark, sf):
    """Fold metrics formatted as text and read back."""
    text = views.fold_metrics(spark, sf).select(
        F.col("model").alias("Model"), F.col("period").cast("string").alias("Period"),
        F.concat(F.round(F.col("f1") * 100, 1).cast("string"), F.lit("%")).alias("F1"),
        F.round("pr_auc", 3).cast("string").alias("PR AUC"),
    )
    table = normalize_metrics(text).withColumn("fold_id", F.col("fold_id").cast("int"))
    return rounded(table, {"f1": 6, "pr_auc": 6}, ("model", "fold_id"))


@query("load_alerts", f"WITH {views.ALERTS_SQL} SELECT symbol, bar_date, round(score, 8) + 0.0 AS score FROM alerts")
def load_alerts(spark, sf):
    exported = views.alerts(spark, sf).select(
        F.col("bar_date").cast("string").alias("level_0"), F.col("symbol").alias("level_1"), F.col("score").cast("string").alias("Score")
    )
    return rounded(normalize_alerts(exported), {"score": 8})


@query("select_alerts", f"WITH {views.PERIODS_SQL} SELECT model, period, symbol, bar_date, round(score, 8) + 0.0 AS score FROM {views.top_sql('sp', 'model, period', 'greatest(1, floor(n * 0.05))')} x WHERE model = 'AF'")
def select_alerts(spark, sf):
    rows = views.scored_periods(spark, sf).filter("model = 'AF'")
    return rounded(evaluate.select_alerts(rows, ["model", "period"], 0.05), {"score": 8}, ("model", "period", "symbol", "bar_date"))


# --- S comparison -------------------------------------------------------------------

_AB = views.FOLD_METRICS_SQL + f""",
ab AS (SELECT model LIKE 'R%' OR model LIKE 'N%' AS challenger, f1, pr_auc, brier FROM fm),
rk AS (SELECT *, rank() OVER (ORDER BY f1) + (count(*) OVER (PARTITION BY f1) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY f1) AS t FROM ab),
us AS (SELECT count(*) FILTER (WHERE challenger) AS n1, count(*) FILTER (WHERE NOT challenger) AS n2, sum(r) FILTER (WHERE challenger) AS rs, sum(t::DOUBLE * t - 1) AS ties FROM rk),
uu AS (SELECT *, rs - n1 * (n1 + 1) / 2.0 AS u, n1::DOUBLE * n2 AS nn, (n1 + n2)::DOUBLE AS n FROM us),
zz AS (SELECT *, (greatest(u, nn - u) - nn / 2 - 0.5) / sqrt(nn / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM uu),
pp AS (SELECT *, least(2 * (1 - {cdf_sql('z')}), 1.0) AS p_value FROM zz),
abs_ AS (SELECT avg(f1) FILTER (WHERE NOT challenger) AS f1_champion, avg(f1) FILTER (WHERE challenger) AS f1_challenger,
              avg(pr_auc) FILTER (WHERE challenger) - avg(pr_auc) FILTER (WHERE NOT challenger) AS pr_auc_delta,
              avg(brier) FILTER (WHERE NOT challenger) - avg(brier) FILTER (WHERE challenger) AS brier_delta,
              sqrt((var_samp(f1) FILTER (WHERE challenger) + var_samp(f1) FILTER (WHERE NOT challenger)) / 2) AS spread FROM ab)
"""


def _ab(spark, sf):
    return views.fold_metrics(spark, sf).select(
        (F.col("model").startswith("R") | F.col("model").startswith("N")).alias("challenger"), "f1", "pr_auc", "brier"
    )


@query("mann_whitney", f"WITH {_AB} SELECT n1 AS n_challenger, n2 AS n_champion, round(u, 4) + 0.0 AS u, round(p_value, 6) + 0.0 AS p_value FROM pp")
def mann_whitney(spark, sf):
    table = compare.mann_whitney(_ab(spark, sf).withColumnRenamed("f1", "value"))
    return rounded(table, {"u": 4, "p_value": 6}, ("n_challenger", "n_champion"))


@query("effect_size", f"WITH {_AB} SELECT round(f1_challenger - f1_champion, 6) + 0.0 AS f1_delta, round((f1_challenger - f1_champion) / greatest(coalesce(spread, 0), 1e-6), 6) + 0.0 AS effect_size FROM abs_")
def effect_size(spark, sf):
    return rounded(compare.ab_compare(_ab(spark, sf)), {"f1_delta": 6, "effect_size": 6}, ())


_AB_DIGITS = {c: 6 for c in ("f1_champion", "f1_challenger", "pr_auc_delta", "brier_delta", "p_value")}


@query(
    "ab_compare",
    f"WITH {_AB} SELECT " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _AB_DIGITS)
    + ", p_value < 0.05 AS is_significant, CASE WHEN p_value < 0.05 AND f1_challenger - f1_champion > 0.01 THEN 'challenger' WHEN p_value < 0.05 AND f1_challenger - f1_champion < -0.01 THEN 'champion' ELSE 'tie' END AS winner FROM abs_, pp",
)
def ab_compare(spark, sf):
    return rounded(compare.ab_compare(_ab(spark, sf)), _AB_DIGITS, ("is_significant", "winner"))


# --- T alert decisions -----------------------------------------------------------------

_DECIDE = f"""WITH RECURSIVE {views.SCORED_SQL},
cand AS (SELECT symbol, bar_date, score, substr(symbol, 1, 1) AS sector, CAST(year(bar_date) AS VARCHAR) AS book FROM scored),
ord AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY score DESC, symbol, bar_date) AS i FROM cand),
walk AS (
  SELECT book, 0::BIGINT AS i, []::STRUCT(s VARCHAR, d DATE, x VARCHAR)[] AS held, NULL::VARCHAR AS symbol, NULL::DATE AS bar_date, NULL::DOUBLE AS score, NULL::VARCHAR AS sector,
         false AS approved, NULL::VARCHAR AS reason, NULL::DOUBLE AS adjusted_score
  FROM (SELECT DISTINCT book FROM ord) b
  UNION ALL
  SELECT book, i, CASE WHEN ok THEN list_append(held, {{'s': symbol, 'd': bar_date, 'x': sector}}) ELSE held END, symbol, bar_date, score, sector, ok,
         CASE WHEN score < 0.55 THEN printf('Score %.3f < min 0.550', score)
              WHEN len(held) >= 10 THEN 'Portfolio at capacity (10)'
              WHEN ns >= 3 THEN printf('%d alerts in 5d window (max 3)', ns)
              WHEN ok THEN 'approved' ELSE printf('Adjusted score %.3f < min 0.550 (sector_overlap_%d)', score - 0.15 * nx, nx) END,
         CASE WHEN ok THEN score - 0.15 * nx ELSE score END
  FROM (SELECT *, score >= 0.55 AND len(held) < 10 AND ns < 3 AND score - 0.15::DOUBLE * nx >= 0.55 AS ok FROM (
    SELECT o.*, w.held, len(list_filter(w.held, lambda a: a.s = o.symbol AND a.d > o.bar_date - 5)) AS ns, len(list_filter(w.held, lambda a: a.x = o.sector)) AS nx
    FROM walk w JOIN ord o ON o.book = w.book AND o.i = w.i + 1) q) r),
decided AS (SELECT * FROM walk WHERE i > 0)
"""


def _decided(spark, sf):
    rows = views.scored(spark, sf).select(
        "symbol", "bar_date", "score", F.substring("symbol", 1, 1).alias("sector"), F.year("bar_date").cast("string").alias("book")
    )
    return al.decide_alerts(rows)


@query("decide_alerts", f"{_DECIDE} SELECT book, symbol, bar_date, sector, round(score, 8) + 0.0 AS score, approved, reason, round(adjusted_score, 6) + 0.0 AS adjusted_score FROM decided")
def decide_alerts(spark, sf):
    return rounded(_decided(spark, sf), {"score": 8, "adjusted_score": 6}, ("book", "symbol", "bar_date", "sector", "approved", "reason"))


@query("alert_sizing", f"WITH {views.ALERTS_SQL} SELECT symbol, bar_date, round(greatest(0.0, least(1.0, (score - 0.55) / 0.45)) * 0.1, 6) + 0.0 AS position_size FROM alerts")
def alert_sizing(spark, sf):
    return rounded(views.alerts(spark, sf).withColumn("position_size", al.alert_size(F.col("score"))), {"position_size": 6})


@query("open_positions", f"{_DECIDE} SELECT book, symbol, bar_date, round(adjusted_score, 6) + 0.0 AS adjusted_score FROM decided WHERE approved AND date_diff('day', bar_date, DATE '1998-06-30') < 200")
def open_positions(spark, sf):
    table = al.open_positions(_decided(spark, sf), "1998-06-30", 200)
    return rounded(table, {"adjusted_score": 6}, ("book", "symbol", "bar_date"))


_RANK = views.FOLD_METRICS_SQL + ", sm AS (SELECT model AS symbol, avg(pr_auc) AS pr_auc, avg(f1) AS f1, avg(lift_1pct) AS lift_1pct FROM fm GROUP BY 1), rs AS (SELECT *, 0.4 * pr_auc + 0.4 * f1 + 0.2 * least(lift_1pct / 20, 1.0) AS rank_score FROM sm)"


def _ranked(spark, sf):
    means = views.fold_metrics(spark, sf).groupBy(F.col("model").alias("symbol")).agg(
        *[F.avg(c).alias(c) for c in ("pr_auc", "f1", "lift_1pct")]
    )
    return al.rank_symbols(means)


@query("rank_symbols", f"WITH {_RANK} SELECT symbol, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("pr_auc", "f1", "lift_1pct", "rank_score")) + " FROM rs ORDER BY rank_score DESC, symbol")
def rank_symbols(spark, sf):
    return rounded(_ranked(spark, sf), {c: 6 for c in ("pr_auc", "f1", "lift_1pct", "rank_score")}, ("symbol",))


@query("allocation_weights", f"WITH {_RANK} SELECT symbol, round(CASE WHEN sum(rank_score) OVER () = 0 THEN 1.0 / count(*) OVER () ELSE rank_score / sum(rank_score) OVER () END, 6) + 0.0 AS weight FROM rs")
def allocation_weights(spark, sf):
    return rounded(al.allocation_weights(cut(_ranked(spark, sf))), {"weight": 6}, ("symbol",))


# --- U governance ----------------------------------------------------------------------------


def _promotions(fm):
    """Every version with a positive F1 was promoted at the end of its year."""
    version = F.concat("model", F.lit("-"), F.col("period").cast("string"))
    return fm.filter("f1 > 0").select(
        version.alias("version"), F.make_timestamp("period", F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)).alias("promoted_at"),
        F.lit("reviewer").alias("promoted_by"), F.lit("").alias("rationale"),
    )


def decision_log(spark, sf):
    """Predictions, alert decisions, promotions and risk checks in one schema."""
    scored = views.state_scored(spark, sf)
    stamp = F.col("bar_date").cast("timestamp")
    version = F.concat(F.lit("v"), F.year("bar_date").cast("string"))
    alerts = scored.filter("score >= 0.55").withColumns({
        "approved": F.col("score") >= 0.9,
        "reason": F.when(F.col("score") >= 0.9, "approved").otherwise("Portfolio at capacity (10)"),
        "position_size": F.when(F.col("score") >= 0.9, al.alert_size(F.col("score"))).otherwise(0.0),
    })
    checks = scored.filter("score >= 0.95").select(
        "symbol", stamp.alias("checked_at"), F.lit("portfolio_capacity").alias("check_name"),
        (F.col("score") < 0.99).alias("passed"), F.when(F.col("score") < 0.99, "within limit").otherwise("limit reached").alias("details"),
    )
    return governance.decision_log(
        governance.prediction_records(scored, version, stamp), governance.alert_records(alerts, version, stamp),
        governance.promotion_records(_promotions(views.fold_metrics(spark, sf, scored))), governance.risk_records(checks),
    )


_LOG_NUM = {c: 6 for c in ("score", "probability", "threshold", "position_size")}


def _digest_sql(columns: str) -> str:
    """Length and text of every column, NULL marked."""
    parts = []
    for name in columns.split():
        text = f"CAST({name} AS VARCHAR)"
        if name == "timestamp":
            text = "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S.%f')"
        elif name in _LOG_NUM:
            scaled = f"{name}::DOUBLE * {2**26}::DOUBLE"
            text = f"concat(CAST(floor({scaled}) AS BIGINT), '/', CAST(({scaled} - floor({scaled})) * {2**60}::DOUBLE AS BIGINT))"
        parts.append(f"CASE WHEN {name} IS NULL THEN 'N' ELSE concat('V', length({text}), ':', {text}) END")
    return f"concat({', '.join(parts)})"


_LOG = views.FOLD_METRICS_SQL + """,
promo AS (SELECT concat(model, '-', CAST(period AS VARCHAR)) AS version, make_timestamp(period, 12, 31, 0, 0, 0.0) AS promoted_at FROM fm WHERE f1 > 0),
log0 AS (
  SELECT CAST(bar_date AS TIMESTAMP) AS "timestamp", 'prediction' AS entry_type, concat('v', CAST(year(bar_date) AS VARCHAR)) AS model_version, symbol AS ticker, CAST(bar_date AS VARCHAR) AS signal_date,
         score, 'prediction_served' AS decision, 'model inference' AS reason, score AS probability, 0.55::DOUBLE AS threshold, 0.0::DOUBLE AS position_size, 'system' AS operator_id FROM scored
  UNION ALL SELECT CAST(bar_date AS TIMESTAMP), CASE WHEN score >= 0.9 THEN 'alert_approved' ELSE 'alert_rejected' END, concat('v', CAST(year(bar_date) AS VARCHAR)), symbol, CAST(bar_date AS VARCHAR),
         score, CASE WHEN score >= 0.9 THEN 'approved' ELSE 'rejected' END, CASE WHEN score >= 0.9 THEN 'approved' ELSE 'Portfolio at capacity (10)' END, score, 0.55,
         CASE WHEN score >= 0.9 THEN greatest(0.0, least(1.0, (score - 0.55::DOUBLE) / (1::DOUBLE - 0.55::DOUBLE))) * 0.1 ELSE 0.0 END, 'system' FROM scored WHERE score >= 0.55
  UNION ALL SELECT promoted_at, 'model_promoted', version, 'all', strftime(promoted_at, '%Y-%m-%d %H:%M:%S'), 0.0, 'promoted', 'model promotion', 0.0, 0.0, 0.0, 'reviewer' FROM promo
  UNION ALL SELECT CAST(bar_date AS TIMESTAMP), 'risk_check', 'N/A', symbol, strftime(CAST(bar_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S'), CASE WHEN score < 0.99 THEN 1.0 ELSE 0.0 END,
         CASE WHEN score < 0.99 THEN 'passed' ELSE 'failed' END, concat('portfolio_capacity: ', CASE WHEN score < 0.99 THEN 'within limit' ELSE 'limit reached' END),
         CASE WHEN score < 0.99 THEN 1.0 ELSE 0.0 END, 1.0, 0.0, 'system' FROM scored WHERE score >= 0.95),
log AS (SELECT *, sha256(""" + _digest_sql("decision entry_type model_version operator_id position_size probability reason run_id score signal_date threshold ticker timestamp") + """) AS audit_id FROM (SELECT *, 'run' AS run_id FROM log0)),
sums AS (SELECT *, sha256(""" + _digest_sql("audit_id decision entry_type model_version operator_id position_size probability reason run_id score signal_date threshold ticker timestamp") + """) AS checksum FROM log)
"""
_LOG_TEXT = ("entry_type", "model_version", "ticker", "signal_date", "decision", "reason", "operator_id", "run_id", "audit_id")


@query("decision_records", f"WITH {_LOG} SELECT {', '.join(_LOG_TEXT)}, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _LOG_NUM) + ", strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') AS at FROM log")
def decision_records(spark, sf):
    log = decision_log(spark, sf).withColumn("at", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    return rounded(log, _LOG_NUM, (*_LOG_TEXT, "at"))


@query("audit_checksum", f"WITH {_LOG} SELECT audit_id, checksum FROM sums")
def audit_checksum(spark, sf):
    return governance.with_checksum(decision_log(spark, sf)).select("audit_id", "checksum")


_FORGED = "entry_type = 'alert_approved' AND ticker = 'AF' AND score < 0.95", "entry_type = 'risk_check' AND ticker = 'RF'", "entry_type = 'model_promoted'"


@query("audit_tampered", f"WITH {_LOG} SELECT audit_id, entry_type, signal_date FROM sums WHERE " + " OR ".join(f"({w})" for w in _FORGED))
def audit_tampered(spark, sf):
    """Found again: a score changed by 1e-9, a time by a microsecond, text moved to the column before."""
    sealed = governance.with_checksum(decision_log(spark, sf))
    score, time, text = map(F.expr, _FORGED)
    forged = sealed.withColumns({
        "score": F.when(score, F.col("score") + 1e-9).otherwise(F.col("score")),
        "timestamp": F.when(time, F.timestamp_micros(F.unix_micros("timestamp") + 1)).otherwise(F.col("timestamp")),
        "model_version": F.when(text, F.concat("model_version", F.substring("operator_id", 1, 1))).otherwise(F.col("model_version")),
        "operator_id": F.when(text, F.substring("operator_id", 2, 100)).otherwise(F.col("operator_id")),
    })
    return governance.tampered(forged).select("audit_id", "entry_type", "signal_date")


@query("audit_range", f"WITH {_LOG} SELECT audit_id, entry_type, strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') AS at FROM log WHERE \"timestamp\" BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' ORDER BY \"timestamp\"")
def audit_range(spark, sf):
    rows = governance.audit_range(decision_log(spark, sf), "1997-01-01", "1997-12-31")
    return rows.select("audit_id", "entry_type", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    "governance_summary",
    f"""WITH {_LOG}, t AS (SELECT (count(*) FILTER (WHERE entry_type = 'prediction'))::DOUBLE AS predictions, (count(*) FILTER (WHERE entry_type = 'alert_approved'))::DOUBLE AS approvals,
(count(*) FILTER (WHERE entry_type = 'alert_rejected'))::DOUBLE AS rejections, count(*) FILTER (WHERE entry_type = 'alert_approved') / (count(*) FILTER (WHERE entry_type IN ('alert_approved', 'alert_rejected')))::DOUBLE AS approval_rate,
avg(probability) FILTER (WHERE entry_type = 'prediction') AS average_probability FROM log)
SELECT metric, 'all' AS key, round(value, 6) + 0.0 AS value FROM (UNPIVOT t ON predictions, approvals, rejections, approval_rate, average_probability INTO NAME metric VALUE value) u
UNION ALL SELECT 'predictions_by_model', model_version, count(*)::DOUBLE FROM log WHERE entry_type = 'prediction' GROUP BY 2
UNION ALL SELECT 'risk_checks_by_reason', reason, count(*)::DOUBLE FROM log WHERE entry_type = 'risk_check' GROUP BY 2""",
)
def governance_summary(spark, sf):
    return rounded(governance.governance_summary(decision_log(spark, sf)), {"value": 6}, ("metric", "key"))


def _registrations(fm):
    """Each version is registered at the start of its year and again, corrected, in July."""
    return fm.withColumn("month", F.explode(F.array(F.lit(1), F.lit(7)))).select(
        F.concat("model", F.lit("-"), F.col("period").cast("string")).alias("version"),
        F.make_timestamp("period", "month", F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("registered_at"),
        F.col("model").alias("ticker"), F.lit("logistic").alias("model_kind"),
        F.when(F.col("month") == 1, 0.0).otherwise(F.col("pr_auc")).alias("pr_auc"), "f1",
    )


_VER = _LOG + ", ver AS (SELECT concat(model, '-', CAST(period AS VARCHAR)) AS version, model AS ticker, pr_auc, f1, period FROM fm), champ AS (SELECT version FROM promo ORDER BY promoted_at DESC, version DESC LIMIT 1)"


@query("version_ledger", f"WITH {_VER} SELECT version, ticker, round(pr_auc, 6) + 0.0 AS pr_auc, round(f1, 6) + 0.0 AS f1, CAST(make_date(period, 7, 1) AS DATE) AS registered FROM ver")
def version_ledger(spark, sf):
    table = governance.latest_versions(_registrations(views.fold_metrics(spark, sf))).withColumn("registered", F.to_date("registered_at"))
    return rounded(table, {"pr_auc": 6, "f1": 6}, ("version", "ticker", "registered"))


@query("champion_version", f"WITH {_VER} SELECT version, version = (SELECT version FROM champ) AS promoted FROM ver")
def champion_version(spark, sf):
    fm = views.fold_metrics(spark, sf)
    return governance.list_versions(_registrations(fm), _promotions(fm)).select("version", "promoted")


@query("rollback_version", f"WITH {_VER} SELECT version, version = (SELECT min(version) FROM ver) AS promoted FROM ver")
def rollback_version(spark, sf):
    """Promoting the first version again makes it the only promoted one."""
    fm = views.fold_metrics(spark, sf)
    first = _registrations(fm).agg(F.min("version").alias("version")).select(
        "version", F.lit("2030-01-01").cast("timestamp").alias("promoted_at"), F.lit("reviewer").alias("promoted_by"), F.lit("rollback").alias("rationale")
    )
    promotions = _promotions(fm).unionByName(first)
    return governance.list_versions(_registrations(fm), promotions).select("version", "promoted")


@query("guarded_delete", f"WITH {_VER} SELECT version, version = (SELECT version FROM champ) AS promoted FROM ver WHERE period <> 2001 OR version = (SELECT version FROM champ)")
def guarded_delete(spark, sf):
    fm = views.fold_metrics(spark, sf)
    versions = governance.list_versions(_registrations(fm), _promotions(fm)).select("version", "promoted")
    requests = versions.filter(F.col("version").endswith("-2001")).select("version")
    return governance.delete_versions(versions, requests)
