"""Model and streaming queries.  Fits and streams have no SQL twin unless one is given."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.functions.lineage import cut, shared_folder
from tickloom.functions.scalars import attach_row
from tickloom.operators import drift, evaluate, folds, frame, governance, labels, ledger, models
from tickloom.operators.calibrated import CalibratedModel
from tickloom.plans import views
from tickloom.plans.evaluation_queries import _ALL_CTE, _ASSIGNED, _COMPLETE, _FOLDS, _LABEL
from tickloom.plans.monitoring_queries import _LOG, decision_log, monitoring_results
from tickloom.plans.registry import ORACLE, query, rounded
from tickloom.sources.audit_log import append_audit, read_audit
from tickloom.sources.bars import write_table
from tickloom.sources.results import write_report
from tickloom.streaming import alerts as stream_alerts
from tickloom.streaming import audit as stream_audit
from tickloom.streaming import drift as stream_drift
from tickloom.streaming.bars import stream_bars
from tickloom.streaming.runs import run_foreach, run_to_table

NAMES = frame.feature_names()


def dataset(spark, sf):
    """Complete labelled feature rows."""
    built = frame.build_features(views.bars_daily(spark, sf), labels=(labels.transition_target,), lookahead=1)
    return cut(frame.complete_rows(built, NAMES, "transition").select(
        "symbol", "bar_date", "close", F.col("transition").alias("label"), *NAMES
    ))


def assigned(spark, sf):
    # Scored rows hold no features; the ledger needs the plain volatility, so a copy goes along.
    rows = dataset(spark, sf).withColumn("volatility", F.col("Volatility_20d"))
    windows = folds.walk_forward_windows(folds.date_bounds(rows), 3, 1, 1)
    split = cut(folds.keep_large_folds(folds.assign_folds(rows, windows)))
    # One row per test year.
    return split, [r.fold_id for r in split.select("fold_id").distinct().orderBy("fold_id").collect()]


def _scores(spark, sf, kind: str, calibrate: bool):
    rows, fold_ids = assigned(spark, sf)
    return models.walk_forward_scores(rows, fold_ids, NAMES, kind, calibrate=calibrate)


def _model_query(name: str, kind: str, calibrate: bool = True):
    @query(name)
    def run(spark, sf):
        decided = cut(models.with_decisions(_scores(spark, sf, kind, calibrate)))
        table = evaluate.evaluate(decided, ["model", "fold_id"])
        return rounded(table, {c: 6 for c in ("precision", "recall", "f1", "roc_auc", "pr_auc", "brier")}, ("model", "fold_id", "rows", "positives"))


_model_query("model_logistic", "logistic", calibrate=False)
_model_query("model_random_forest", "random_forest")
_model_query("model_boosted_fixed_weight", "boosted_a")
_model_query("model_boosted_auto_weight", "boosted_b")
_model_query("model_calibrated_logistic", "logistic")


# What is known of a fit without fitting: rows and positives of every fold, the parts of its model, and which rules its
# scores must keep.  Counts of rows that keep a rule stand beside the counts of rows.

_DATASET_SQL = f"{_ALL_CTE}, {_LABEL}, bars AS (SELECT symbol, bar_date, transition AS label FROM fl WHERE {_COMPLETE})"
_FOLD_ROWS_SQL = (
    f"{_DATASET_SQL}{_FOLDS.removeprefix(views.BARS_SQL)}{_ASSIGNED}, fr AS (SELECT fold_id, split, symbol, bar_date, label FROM asg JOIN bars USING (symbol, bar_date) "
    "WHERE fold_id IN (SELECT fold_id FROM asg GROUP BY fold_id HAVING count(*) FILTER (WHERE split = 'train') >= 100 AND count(*) FILTER (WHERE split = 'test') >= 50))"
)
#: Trees of a base model and their greatest depth.
_TREES = {"logistic": (0, 0), "random_forest": (200, 6), "boosted_a": (300, 4), "boosted_b": (300, 4)}


def _close(a, b):
    return F.abs(a - b) <= 1e-12


def _facts_sql(kind: str) -> str:
    trees, _ = _TREES[kind]
    return (
        f"{_FOLD_ROWS_SQL} SELECT '{kind}' AS model, fold_id, count(*) FILTER (WHERE split = 'train') AS train_rows, CAST(sum(label) FILTER (WHERE split = 'train') AS BIGINT) AS train_positives, "
        "count(*) FILTER (WHERE split = 'test') AS test_rows, CAST(sum(label) FILTER (WHERE split = 'test') AS BIGINT) AS test_positives, "
        f"CAST(3 AS INTEGER) AS bases, CAST({3 * trees} AS INTEGER) AS trees, true AS within_depth, count(*) AS in_range, count(*) AS mean_of_sigmoids FROM fr GROUP BY fold_id"
    )


def _facts_query(kind: str):
    @query(f"model_facts_{kind}", _facts_sql(kind))
    def run(spark, sf):
        rows, fold_ids = assigned(spark, sf)
        fitted = models.fit_folds(rows, fold_ids, NAMES, kind)
        parts = []
        for fold, model in fitted.items():
            own = rows.filter(F.col("fold_id") == fold)
            # The same rows once more through each base and its own sigmoid.
            each = [1 / (1 + F.exp(-(F.lit(slope) * F.col(f"_m{i}") + F.lit(shift)))) for i, (slope, shift) in enumerate(model.sigmoids)]
            again = model.transform(model.margins(own)).withColumn("mean", sum(each) / len(each))
            trees = model.trees()
            parts.append(again.groupBy("fold_id").agg(
                F.count_if(F.col("split") == "train").alias("train_rows"), F.sum(F.when(F.col("split") == "train", F.col("label").cast("long"))).alias("train_positives"),
                F.count_if(F.col("split") == "test").alias("test_rows"), F.sum(F.when(F.col("split") == "test", F.col("label").cast("long"))).alias("test_positives"),
                F.lit(len(model.bases)).alias("bases"), F.lit(sum(n for n, _ in trees)).alias("trees"),
                F.lit(all(depth <= _TREES[kind][1] for _, depth in trees)).alias("within_depth"),
                F.count_if(F.col("score").between(0, 1)).alias("in_range"), F.count_if(_close(F.col("score"), F.col("mean"))).alias("mean_of_sigmoids")))
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part)
        return table.withColumn("model", F.lit(kind))


for _kind in _TREES:
    _facts_query(_kind)


@query("batch_scoring")
def batch_scoring(spark, sf):
    rows = dataset(spark, sf)
    model = models.fit_final(rows, NAMES, "logistic")
    return rounded(models.score_batch(model, rows), {"score": 6}, ("symbol", "bar_date", "label"))


def _saved(spark, rows):
    """A final model, and the same model saved and loaded."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    return models.fit_final(rows, NAMES, "logistic", path), CalibratedModel.load(path)


@query("final_model")
def final_model(spark, sf):
    """Fit on everything, save, load, score."""
    rows = dataset(spark, sf)
    return rounded(models.score_batch(_saved(spark, rows)[1], rows), {"score": 6}, ("symbol", "bar_date"))


@query("final_model_facts", f"{_DATASET_SQL} SELECT symbol, bar_date, label, true AS in_range, true AS same_when_loaded FROM bars")
def final_model_facts(spark, sf):
    """Every complete row gets a probability, and the saved model gives the same one."""
    rows = dataset(spark, sf)
    made, loaded = _saved(spark, rows)
    both = models.score_batch(loaded, models.score_batch(made, rows).withColumnRenamed("score", "first"))
    return both.select("symbol", "bar_date", "label", F.col("score").between(0, 1).alias("in_range"), _close(F.col("score"), F.col("first")).alias("same_when_loaded"))


def _fold_models(spark, sf):
    rows, fold_ids = assigned(spark, sf)
    return models.fit_folds(rows, fold_ids, NAMES, "logistic")


@query("coefficient_stability")
def coefficient_stability(spark, sf):
    table = models.coefficient_stability(models.coefficients(_fold_models(spark, sf), spark))
    return rounded(table, {c: 6 for c in ("mean", "mean_abs", "std", "positive_fraction")}, ("feature",))


@query(
    "coefficient_facts",
    f"{_FOLD_ROWS_SQL} SELECT feature, fold_id, CAST(3 AS INTEGER) AS bases, true AS mean_of_bases FROM (SELECT DISTINCT fold_id FROM fr), (VALUES {', '.join(f'({n!r})' for n in NAMES)}) AS v(feature)",
)
def coefficient_facts(spark, sf):
    """A fold's coefficient lies at the mean of its base models' coefficients."""
    fitted = _fold_models(spark, sf)
    each = [(f, n, float(b.coefficients[i])) for f, m in fitted.items() for b in m.bases for i, n in enumerate(NAMES)]
    means = spark.createDataFrame(each, "fold_id int, feature string, value double").groupBy("fold_id", "feature").agg(F.avg("value").alias("value"), F.count("*").cast("int").alias("bases"))
    return models.coefficients(fitted, spark).join(means, ["fold_id", "feature"]).select("feature", "fold_id", "bases", _close(F.col("value"), F.col("coefficient")).alias("mean_of_bases"))


@query("walk_forward_ledger")
def walk_forward_ledger(spark, sf):
    """Train scores give the Kelly fraction of each fold, test scores its ledger."""
    keys = ["model", "fold_id", "symbol"]
    scored = cut(_scores(spark, sf, "logistic", True))
    thresholds = evaluate.optimize_threshold(scored.filter("split = 'train'"), ["model", "fold_id"])
    decided = cut(scored.join(thresholds, ["model", "fold_id"]).withColumn("pred", F.col("score") >= F.col("threshold")))
    train = ledger.run_ledger(decided.filter("split = 'train'"), keys, vol="volatility")
    sized = decided.filter("split = 'test'").join(ledger.kelly_fraction(train, keys), keys, "left")
    trades = ledger.run_ledger(sized, keys, kelly=F.coalesce("kelly", F.lit(ledger.FIXED_POSITION)), vol="volatility")
    table = ledger.ledger_metrics(cut(trades), keys)
    return rounded(table, {c: 6 for c in ("win_rate", "total_return", "sharpe_ratio", "max_drawdown")}, (*keys, "total_trades"))


# --- A sinks -----------------------------------------------------------------------


@query("write_table", f"WITH {views.BARS_SQL} SELECT symbol, bar_date, round(close, 4) + 0.0 AS close FROM bars")
def write_bars(spark, sf):
    """Written by symbol as CSV and read back with the same schema."""
    bars = views.bars_daily(spark, sf).select("symbol", "bar_date", "close")
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    write_table(bars, path, "csv", ("symbol",))
    return rounded(spark.read.schema(bars.schema).option("header", True).csv(path), {"close": 4})


_INTACT = f"WITH {_LOG} SELECT entry_type, count(*) AS n, count(*) AS intact FROM log GROUP BY 1"


@query("audit_log", _INTACT)
def audit_log(spark, sf):
    """Append two batches, read everything back."""
    records = governance.with_checksum(decision_log(spark, sf))
    path = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    append_audit(records.filter("entry_type = 'prediction'"), path)
    append_audit(records.filter("entry_type <> 'prediction'"), path)
    back = read_audit(spark, path)
    return back.groupBy("entry_type").agg(F.count("*").alias("n"), F.count_if(F.col("checksum") == governance.checksum()).alias("intact"))


@query("write_report", ORACLE["overall_status"])
def report(spark, sf):
    """A monitoring report with nested results, written as JSON and read back."""
    results = cut(monitoring_results(spark, sf))
    nested = attach_row(
        drift.overall_status(results), results.agg(F.collect_list(F.struct("name", "drift_type", "severity")).alias("drift_results"))
    )
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    write_report(nested, path)
    return spark.read.schema(nested.schema).json(path).select("high", "moderate", "overall_status")


# --- V streaming --------------------------------------------------------------------


def _stream(spark, table):
    """A stored table as a stream."""
    path = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.readStream.schema(table.schema).parquet(path)


@query(
    "stream_bars",
    f"WITH {views.TICKS_SQL}, b AS (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS bar_start, min_by(price, ts) AS open, max(price) AS high, min(price) AS low, max_by(price, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2) "
    "SELECT symbol, bar_start, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, volume FROM b "
    "WHERE bar_start + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ticks)",
)
def stream_bars_query(spark, sf):
    """Bars closed by the watermark when the input ends."""
    bars = run_to_table(stream_bars(_stream(spark, views.price_events(spark, sf))), spark)
    return rounded(bars, {c: 6 for c in ("open", "high", "low", "close", "volume")}, ("symbol", "bar_start"))


@query("stream_scoring")
def stream_scoring(spark, sf):
    rows = dataset(spark, sf)
    model = models.fit_final(rows, NAMES, "logistic")
    scored = run_to_table(models.score_batch(model, _stream(spark, rows)), spark)
    return rounded(scored, {"score": 6}, ("symbol", "bar_date"))


@query("stream_scoring_facts", f"{_DATASET_SQL} SELECT symbol, bar_date, label, true AS in_range, true AS same_as_batch FROM bars")
def stream_scoring_facts(spark, sf):
    """The loaded model gives a stream the scores that it gives the table."""
    rows = dataset(spark, sf)
    _, model = _saved(spark, rows)
    first = models.score_batch(model, rows).withColumnRenamed("score", "first")
    scored = run_to_table(models.score_batch(model, _stream(spark, first)), spark)
    return scored.select("symbol", "bar_date", "label", F.col("score").between(0, 1).alias("in_range"), _close(F.col("score"), F.col("first")).alias("same_as_batch"))


_STREAM_DRIFT = f"""WITH {views.PERIODS_SQL},
w AS (SELECT model, time_bucket(INTERVAL 30 DAY, CAST(bar_date AS TIMESTAMP), TIMESTAMP '1970-01-01') AS batch, count(*) FILTER (WHERE pred) AS predicted, count(*) FILTER (WHERE pred AND label = 1) AS hits FROM sp GROUP BY 1, 2),
v AS (SELECT model, CAST(batch AS DATE) AS batch, coalesce(hits / nullif(predicted, 0)::DOUBLE, 0.0) AS value FROM w
      WHERE batch + INTERVAL 30 DAY <= (SELECT max(CAST(bar_date AS TIMESTAMP)) - INTERVAL 1 DAY FROM sp)),
d AS (SELECT *, CAST(sum((value < 0.01)::INT) OVER (PARTITION BY model ORDER BY batch ROWS 2 PRECEDING) AS INTEGER) AS degraded FROM v)
SELECT model, batch, round(value, 6) + 0.0 AS value, degraded, CASE WHEN degraded >= 3 THEN 'high' WHEN degraded >= 2 THEN 'moderate' ELSE 'low' END AS severity FROM d
"""


@query("stream_performance_drift", _STREAM_DRIFT)
def stream_performance_drift(spark, sf):
    scored = views.scored_periods(spark, sf).select("model", "bar_date", "label", "pred")
    batches = run_to_table(stream_drift.batch_counts(_stream(spark, scored)), spark)
    table = run_to_table(stream_drift.performance_drift(_stream(spark, batches), 0.02), spark)
    return rounded(table, {"value": 6}, ("model", "batch", "degraded", "severity"))


_STREAM_DECIDE = f"""WITH RECURSIVE {views.ALERTS_SQL},
ord AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY bar_date, score DESC, symbol) AS i FROM alerts),
walk AS (
  SELECT book, 0::BIGINT AS i, []::STRUCT(s VARCHAR, d DATE, x VARCHAR)[] AS held, NULL::VARCHAR AS symbol, NULL::DATE AS bar_date, NULL::DOUBLE AS score,
         false AS approved, NULL::VARCHAR AS reason, NULL::DOUBLE AS adjusted_score
  FROM (SELECT DISTINCT book FROM ord) b
  UNION ALL
  SELECT book, i, CASE WHEN ok THEN list_append(held, {{'s': symbol, 'd': bar_date, 'x': sector}}) ELSE held END, symbol, bar_date, score, ok,
         CASE WHEN len(held) >= 10 THEN 'Portfolio at capacity (10)' WHEN ns >= 3 THEN printf('%d alerts in 5d window (max 3)', ns)
              WHEN ok THEN 'approved' ELSE printf('Adjusted score %.3f < min 0.550 (sector_overlap_%d)', score - 0.15 * nx, nx) END,
         CASE WHEN ok THEN score - 0.15 * nx ELSE score END
  FROM (SELECT *, len(held) < 10 AND ns < 3 AND score - 0.15::DOUBLE * nx >= 0.55 AS ok FROM (
    SELECT *, len(list_filter(held, lambda a: a.s = symbol AND a.d > bar_date - 5)) AS ns, len(list_filter(held, lambda a: a.x = sector)) AS nx FROM (
      SELECT o.*, list_filter(w.held, lambda a: date_diff('day', a.d, o.bar_date) < 5) AS held FROM walk w JOIN ord o ON o.book = w.book AND o.i = w.i + 1) p) q) r)
SELECT book, symbol, bar_date, approved, reason, round(score, 6) + 0.0 AS score, round(adjusted_score, 6) + 0.0 AS adjusted_score FROM walk WHERE i > 0
UNION ALL SELECT CAST(year(bar_date) AS VARCHAR), symbol, bar_date, false, printf('Score %.3f < min 0.550', score), round(score, 6) + 0.0, round(score, 6) + 0.0 FROM scored WHERE score < 0.55
"""


@query("stream_alert_decisions", _STREAM_DECIDE)
def stream_alert_decisions(spark, sf):
    rows = views.scored(spark, sf).select(
        "symbol", "bar_date", "score", F.substring("symbol", 1, 1).alias("sector"), F.year("bar_date").cast("string").alias("book"))
    decided = stream_alerts.decide_batches(_stream(spark, rows), spark, f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}")
    return rounded(decided, {"score": 6, "adjusted_score": 6}, ("book", "symbol", "bar_date", "approved", "reason"))


@query("stream_audit", _INTACT)
def stream_audit_query(spark, sf):
    path = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    run_foreach(_stream(spark, decision_log(spark, sf)), spark, stream_audit.audit_writer(path))
    back = read_audit(spark, path)
    return back.groupBy("entry_type").agg(F.count("*").alias("n"), F.count_if(F.col("checksum") == governance.checksum()).alias("intact"))
