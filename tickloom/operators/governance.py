"""Audit records with checksums, governance summary, and the model-version ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schemas import AUDIT, AUDIT_COLUMNS

THRESHOLD = 0.55


def _exact(x: Column) -> Column:
    """All bits of a number as text: two whole numbers in the usual range, where any engine gives the same, else as Spark prints it."""
    scaled = x * float(2**26)
    usual = (x == 0) | F.abs(x).between(2.0**-33, 2.0**36)
    low = (scaled - F.floor(scaled)) * float(2**60)
    return F.when(usual, F.concat_ws("/", F.floor(scaled).cast("string"), low.cast("bigint").cast("string"))).otherwise(x.cast("string"))


def _digest(columns: dict[str, Column]) -> Column:
    """SHA-256 over columns in name order, such that different records have different input.

    Every part carries its length and NULL is not empty text, so no text can move between columns; numbers keep all their
    digits and times their microseconds.
    """
    parts = []
    for name in sorted(columns):
        kind = AUDIT[name].dataType.typeName()
        if kind == "timestamp":
            text = F.date_format(columns[name], "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "double":
            text = _exact(columns[name])
        else:
            text = columns[name].cast("string")
        parts.append(F.when(columns[name].isNull(), "N").otherwise(F.concat(F.lit("V"), F.char_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _record(rows: DataFrame, run_id: str, **values: Column) -> DataFrame:
    """One audit row per input row; `values` name every schema column but the ids.

    The id is a digest of all other columns: records of another time, run or score have other ids.
    """
    kinds = {f.name: f.dataType for f in AUDIT.fields}
    filled = {c: v.cast(kinds[c]) for c, v in {**values, "run_id": F.lit(run_id)}.items()}
    filled["audit_id"] = _digest(filled)
    return rows.select(*[filled[c].cast(kinds[c]).alias(c) for c in AUDIT_COLUMNS])


def prediction_records(scored: DataFrame, model_version: Column, at: Column, run_id: str = "run") -> DataFrame:
    return _record(
        scored, run_id, timestamp=at, entry_type=F.lit("prediction"), model_version=model_version, ticker=F.col("symbol"),
        signal_date=F.col("bar_date").cast("string"), score=F.col("score"), decision=F.lit("prediction_served"),
        reason=F.lit("model inference"), probability=F.col("score"), threshold=F.lit(THRESHOLD),
        position_size=F.lit(0.0), operator_id=F.lit("system"),
    )


def alert_records(decided: DataFrame, model_version: Column, at: Column, run_id: str = "run") -> DataFrame:
    ok = F.col("approved")
    return _record(
        decided, run_id, timestamp=at, entry_type=F.when(ok, "alert_approved").otherwise("alert_rejected"),
        model_version=model_version, ticker=F.col("symbol"), signal_date=F.col("bar_date").cast("string"),
        score=F.col("score"), decision=F.when(ok, "approved").otherwise("rejected"), reason=F.col("reason"),
        probability=F.col("score"), threshold=F.lit(THRESHOLD), position_size=F.col("position_size"),
        operator_id=F.lit("system"),
    )


def promotion_records(promotions: DataFrame, run_id: str = "run") -> DataFrame:
    """From (version, promoted_at, promoted_by, rationale)."""
    why = F.when(F.coalesce("rationale", F.lit("")) == "", "model promotion").otherwise(F.col("rationale"))
    zero = F.lit(0.0)
    return _record(
        promotions, run_id, timestamp=F.col("promoted_at"), entry_type=F.lit("model_promoted"),
        model_version=F.col("version"), ticker=F.lit("all"), signal_date=F.col("promoted_at").cast("string"), score=zero,
        decision=F.lit("promoted"), reason=why, probability=zero, threshold=zero, position_size=zero,
        operator_id=F.col("promoted_by"),
    )


def risk_records(checks: DataFrame, run_id: str = "run") -> DataFrame:
    """From (symbol, checked_at, check_name, passed, details)."""
    value = F.col("passed").cast("double")
    return _record(
        checks, run_id, timestamp=F.col("checked_at"), entry_type=F.lit("risk_check"), model_version=F.lit("N/A"),
        ticker=F.col("symbol"), signal_date=F.col("checked_at").cast("string"), score=value,
        decision=F.when(F.col("passed"), "passed").otherwise("failed"),
        reason=F.concat(F.col("check_name"), F.lit(": "), F.col("details")), probability=value, threshold=F.lit(1.0),
        position_size=F.lit(0.0), operator_id=F.lit("system"),
    )


def decision_log(*records: DataFrame) -> DataFrame:
    log = records[0]
    for more in records[1:]:
        log = log.unionByName(more)
    return log


def checksum() -> Column:
    """SHA-256 of the whole record, its id included."""
    return _digest({c: F.col(c) for c in AUDIT_COLUMNS})


def with_checksum(records: DataFrame) -> DataFrame:
    return records.withColumn("checksum", checksum())


def tampered(records: DataFrame) -> DataFrame:
    """Records whose stored checksum does not match their content."""
    return records.filter(~F.col("checksum").eqNullSafe(checksum()))


def audit_range(records: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive time range in time order."""
    if start is not None:
        records = records.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        records = records.filter(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    return records.orderBy("timestamp")


def governance_summary(records: DataFrame) -> DataFrame:
    """(metric, key, value): totals, approval rate, predictions per model, risk checks by reason."""
    kind = F.col("entry_type")
    predicted, approved, rejected = (kind == k for k in ("prediction", "alert_approved", "alert_rejected"))
    totals = records.agg(
        F.count_if(predicted).cast("double").alias("predictions"),
        F.count_if(approved).cast("double").alias("approvals"),
        F.count_if(rejected).cast("double").alias("rejections"),
        F.coalesce(F.try_divide(F.count_if(approved), F.count_if(approved | rejected)), F.lit(0.0)).alias("approval_rate"),
        F.avg(F.when(predicted, F.col("probability"))).alias("average_probability"),
    )
    names = totals.columns
    wide = totals.withColumn("key", F.lit("all")).unpivot(["key"], names, "metric", "value")
    counted = records.filter(predicted | (kind == "risk_check")).groupBy(
        F.when(predicted, "predictions_by_model").otherwise("risk_checks_by_reason").alias("metric"),
        F.when(predicted, F.col("model_version")).otherwise(F.col("reason")).alias("key"),
    ).agg(F.count("*").cast("double").alias("value"))
    return wide.select("metric", "key", "value").unionByName(counted)


def latest_versions(registrations: DataFrame) -> DataFrame:
    """The last registration of every version from an append-only table."""
    others = [c for c in registrations.columns if c not in ("version", "registered_at")]
    newest = F.max(F.struct("registered_at", *others)).alias("r")
    return registrations.groupBy("version").agg(newest).select("version", "r.registered_at", *[f"r.{c}" for c in others])


def champion(promotions: DataFrame) -> DataFrame:
    """The version promoted last; a rollback is a later promotion of an older version."""
    return promotions.agg(F.max(F.struct("promoted_at", "version")).alias("p")).select(
        F.col("p.version").alias("version"), F.col("p.promoted_at").alias("promoted_at")
    ).filter("version IS NOT NULL")


def list_versions(registrations: DataFrame, promotions: DataFrame) -> DataFrame:
    """All versions with exactly one promoted (none before the first promotion)."""
    top = champion(promotions).select("version", F.lit(True).alias("promoted"))
    # The champion table has at most one row.
    return latest_versions(registrations).join(F.broadcast(top), "version", "left").na.fill({"promoted": False})


def delete_versions(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Versions left after deleting the requested ones; the promoted one stays."""
    removable = requests.select("version").distinct().join(versions.filter("promoted").select("version"), "version", "left_anti")
    return versions.join(removable, "version", "left_anti")


def refused_deletes(versions: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.select("version").distinct().join(versions.filter("promoted").select("version"), "version", "left_semi")
