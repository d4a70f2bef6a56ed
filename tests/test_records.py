"""Audit records, reports and small sides: cases that no query shows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions.lineage import cut, shared_folder, small
from tickloom.operators import compare, evaluate, folds, frame, governance, models, quality
from tickloom.sources.audit_log import append_audit, read_audit
from tickloom.sources.chains import normalize_chain
from tickloom.streaming import alerts as stream_alerts
from tickloom.streaming.audit import audit_writer


@pytest.fixture(scope="module")
def sealed(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    promoted = spark.createDataFrame([("v1", at, "a|b", "c"), ("v2", at, "a", "b|c")], "version string, promoted_at timestamp, promoted_by string, rationale string")
    return cut(governance.with_checksum(governance.promotion_records(promoted)))


@pytest.mark.parametrize("column, forged", [
    ("score", "score + 1e-12"), ("timestamp", "timestamp + interval 1 microsecond"), ("decision", "cast(null as string)"), ("decision", "''"),
    ("model_version", "concat(model_version, '|')"),
])
def test_every_change_is_found(sealed, column, forged):
    assert governance.tampered(sealed).count() == 0
    assert governance.tampered(sealed.withColumn(column, F.expr(forged))).count() == 2


def test_null_is_not_empty_and_text_cannot_move(spark):
    rows = spark.createDataFrame([(None, "x"), ("", "x"), ("x", ""), ("a|b", "c"), ("a", "b|c"), ("1:", ""), ("", "1:")], "decision string, reason string")
    for name in schemas.AUDIT_COLUMNS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(schemas.AUDIT[name].dataType))
    assert rows.select(governance.checksum().alias("c")).distinct().count() == 7


def test_ids_differ_between_runs_and_times(spark):
    made = lambda day, run: governance.promotion_records(
        spark.createDataFrame([("v1", dt.datetime(2024, 1, day), "me", "")], "version string, promoted_at timestamp, promoted_by string, rationale string"), run)
    rows = made(1, "a").unionByName(made(2, "a")).unionByName(made(1, "b"))
    assert rows.select("audit_id").distinct().count() == 3


def test_two_streams_keep_all_records(spark, sealed):
    path = f"{shared_folder(spark)}/two-streams"
    plain = sealed.drop("checksum")
    audit_writer(path, "one")(plain, 0)
    audit_writer(path, "two")(plain, 0)
    audit_writer(path, "two")(plain, 0)  # a retry
    back = read_audit(spark, path)
    assert back.count() == 4 and governance.tampered(back).count() == 0
    append_audit(sealed, f"{path}-batch")
    assert governance.tampered(read_audit(spark, f"{path}-batch")).count() == 0


def test_report_checks_columns_and_order(spark):
    start = dt.date(2020, 1, 1)
    rows = [("A", start + dt.timedelta(days=i if i != 5 else 3), i, 1.0, 2.0, 1.0, 1.5, 10.0) for i in range(8)]
    bars = spark.createDataFrame(rows, "symbol string, bar_date date, n int, open double, high double, low double, close double, volume double")
    report = {r.check: (r.value, r.level) for r in quality.validation_report(bars.drop("volume"), arrival="n").collect()}
    assert report["missing_columns"] == (1.0, "error") and report["out_of_order"] == (1.0, "error")
    assert {r.check: r.level for r in quality.validation_report(bars).collect()}["missing_columns"] == "ok"


def test_vendor_header_type(spark):
    raw = spark.createDataFrame([("2024-01-19", "100", "call", "1.5")], "expiration string, strike string, type string, bid string")
    assert normalize_chain(raw).select("expiration_date", "strike", "option_type").first() == (dt.date(2024, 1, 19), 100.0, "call")


def test_u_test_methods(spark):
    values = spark.createDataFrame([(i % 2 == 0, float(i * i % 17) + i / 100) for i in range(12)], "challenger boolean, value double")
    p = {m: compare.mann_whitney(values, method=m).first().p_value for m in ("auto", "exact", "asymptotic")}
    assert p["auto"] == p["exact"] != p["asymptotic"] and abs(p["exact"] - p["asymptotic"]) < 0.05
    tied = values.withColumn("value", F.lit(1.0))
    assert compare.mann_whitney(tied, method="exact").first().p_value is None
    with pytest.raises(ValueError):
        compare.mann_whitney(values, method="other")


def test_selected_alerts_can_be_restricted(spark):
    rows = [(s, dt.date(2020, 1, d), 1, d / 10, "m", y) for s in ("A", "B") for d in range(1, 9) for y in (1, 5)]
    scored = spark.createDataFrame(rows, "symbol string, bar_date date, label int, score double, model string, horizon int")
    got = evaluate.select_alerts(scored, ["model"], 0.25, symbol=["B"], horizon=5).collect()
    assert {(r.symbol, r.horizon) for r in got} == {("B", 5)} and len(got) == 2


def test_low_and_late_alerts_get_their_row(spark):
    days = [(f"S{i % 4}", "x" if i % 2 else "y", dt.date(2024, 1, 1 + i % 20), 0.3 + 0.02 * i, "b") for i in range(30)]
    one = spark.createDataFrame(days, "symbol string, sector string, bar_date date, score double, book string")
    folder = f"{shared_folder(spark)}/alerts-in"
    one.coalesce(1).write.parquet(folder)
    stream = stream_alerts.decide(spark.readStream.schema(one.schema).parquet(folder))
    query = stream.writeStream.format("memory").queryName("decided_alerts").trigger(availableNow=True).option("checkpointLocation", f"{folder}-state").start()
    query.awaitTermination()
    got = spark.table("decided_alerts").collect()
    assert len(got) == 30
    assert sum(r.reason.startswith("Score ") for r in got) == sum(d[3] < 0.55 for d in days)


def test_small_sides_do_not_move_the_rows(spark):
    rows = cut(spark.range(2_000).select(
        F.concat(F.lit("s"), F.col("id") % 3).alias("symbol"), (F.col("id") % 5).cast("int").alias("fold_id"), (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 7 == 0, "test").otherwise("train").alias("split"), F.col("id").cast("double").alias("x")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # nothing is broadcast by guess
    try:
        for made in (models.class_weights(rows, "label", keys=["symbol"]), frame.apply_scaler(rows, frame.fit_scaler(rows, ["x"]), ["x"]), folds.keep_large_folds(rows)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        many = small(spark.range(50), rows=10)
        assert "BroadcastHashJoin" not in spark.range(10).join(many, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
