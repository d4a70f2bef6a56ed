"""Streaming alert decisions with positions that expire by event time.

`decide` keeps the positions of a book in streaming state.  `decide_batches` keeps them in a stored table, one version for
each micro-batch, and decides with the rounds of `operators.alerts.decide_by_date`: every alert gets its row, also one
that comes too late, and no task walks all alerts of a book.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tickloom.functions.lineage import cut
from tickloom.functions.scalars import attach_row
from tickloom.operators.alerts import (
    CAPACITY, CROWDED, FULL, LOW_ADJUSTED, LOW_SCORE, MIN_SCORE, PER_SYMBOL, SECTOR_PENALTY, WINDOW_DAYS, decide_by_date,
)
from tickloom.streaming.runs import run_foreach

OUTPUT = "book string, symbol string, bar_date date, score double, approved boolean, reason string, adjusted_score double"
STATE = "symbols array<string>, sectors array<string>, days array<int>"
_EPOCH, _DAY_MS = pd.Timestamp("1970-01-01"), 86_400_000


def decide(alerts: DataFrame, capacity: int = CAPACITY, hold_days: int = 5, lateness: str = "30 days") -> DataFrame:
    """(book, symbol, sector, bar_date, score) stream to decisions per book, one row per alert.

    Alerts of one date are taken in score order.  A position leaves the state
    when the watermark (`lateness` behind the newest date) is hold_days past
    its date, so a book keeps the approvals of that span only, and a book
    without any loses its state.  A late alert is decided against positions
    that were open at its own date.  Low scores get their row before the
    shuffle.
    """

    def update(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["bar_date", "score", "symbol"], ascending=[True, False, True])
        positions = list(zip(*state.get)) if state.exists else []
        out = []
        for symbol, sector, day, score in zip(rows["symbol"], rows["sector"], rows["bar_date"], rows["score"]):
            number = (pd.Timestamp(day) - _EPOCH).days
            held = [h for h in positions if 0 <= number - h[2] < hold_days]
            same = sum(h[0] == symbol and h[2] > number - WINDOW_DAYS for h in held)
            overlap = sum(h[1] == sector for h in held)
            adjusted = score - SECTOR_PENALTY * overlap
            if len(held) >= capacity:
                reason = FULL % capacity
            elif same >= PER_SYMBOL:
                reason = CROWDED % (same, WINDOW_DAYS, PER_SYMBOL)
            elif adjusted < MIN_SCORE:
                reason = LOW_ADJUSTED % (adjusted, MIN_SCORE, overlap)
            else:
                reason = "approved"
                positions.append((symbol, sector, number))
            ok = reason == "approved"
            out.append((key[0], symbol, pd.Timestamp(day).date(), score, ok, reason, adjusted if ok else score))
        # A position stays while an alert that is not yet too late could meet it.
        until = [h for h in positions if (h[2] + hold_days) * _DAY_MS > state.getCurrentWatermarkMs()]
        if until:
            state.update(tuple(list(c) for c in zip(*until)))
            state.setTimeoutTimestamp(max(h[2] + hold_days for h in until) * _DAY_MS)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["book", "symbol", "bar_date", "score", "approved", "reason", "adjusted_score"])

    low = alerts.filter(F.col("score") < MIN_SCORE).select(
        "book", "symbol", "bar_date", "score", F.lit(False).alias("approved"),
        F.format_string(LOW_SCORE, "score", F.lit(MIN_SCORE)).alias("reason"), F.col("score").alias("adjusted_score"),
    )
    high = alerts.filter(F.col("score") >= MIN_SCORE).withColumn("_at", F.col("bar_date").cast("timestamp")).withWatermark("_at", lateness)
    decided = high.groupBy("book").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return decided.unionByName(low)


TOO_LATE = "Too late (before %s)"
_POSITION = "book string, symbol string, sector string, bar_date date"


def batch_decider(folder: str, capacity: int = CAPACITY, hold_days: int = 5, lateness_days: int = 30):
    """A `foreachBatch` handler that writes `decisions/batch=<id>` and the positions and newest date after it.

    A batch reads what the batch before it left and overwrites only its own folders, so a repeated batch gives the same
    result.  An alert more than `lateness_days` behind the newest date of the earlier batches is too late; positions are
    kept as long as an alert that is not too late could meet them.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        alerts = cut(batch.select("book", "symbol", "sector", "bar_date", "score"))
        held, newest = _left_by(spark, folder, batch_id - 1)
        dated = attach_row(alerts, newest)
        bound = F.date_sub("newest", lateness_days)
        late = F.coalesce(F.col("bar_date") < bound, F.lit(False))
        refused = dated.filter(late).select(
            "book", "symbol", "bar_date", "score", F.lit(False).alias("approved"),
            F.format_string(TOO_LATE, bound.cast("string")).alias("reason"), F.col("score").alias("adjusted_score"))
        decided = cut(decide_by_date(dated.filter(~late).select(*alerts.columns), held, capacity, hold_days))
        rows = decided.drop("sector").unionByName(refused)
        rows.write.mode("overwrite").parquet(f"{folder}/decisions/batch={batch_id}")
        now = newest.unionByName(alerts.agg(F.max("bar_date").alias("newest"))).agg(F.max("newest").alias("newest"))
        kept = held.unionByName(decided.filter("approved").select("book", "symbol", "sector", "bar_date"))
        until = F.date_add("bar_date", hold_days) > F.date_sub("newest", lateness_days)
        attach_row(kept, now).filter(F.coalesce(until, F.lit(True))).drop("newest").write.mode("overwrite").parquet(f"{folder}/positions/batch={batch_id}")
        now.write.mode("overwrite").parquet(f"{folder}/newest/batch={batch_id}")

    return handle


def _left_by(spark: SparkSession, folder: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """Positions and newest date after a batch; none before the first."""
    if batch_id < 0:
        return spark.createDataFrame([], _POSITION), spark.createDataFrame([(None,)], "newest date")
    return (spark.read.schema(_POSITION).parquet(f"{folder}/positions/batch={batch_id}"), spark.read.schema("newest date").parquet(f"{folder}/newest/batch={batch_id}"))


def decide_batches(alerts: DataFrame, spark: SparkSession, folder: str, **params) -> DataFrame:
    """Decide all available input of a stream; the table of decisions, one row per alert."""
    run_foreach(alerts, spark, batch_decider(folder, **params))
    return spark.read.schema(OUTPUT).parquet(f"{folder}/decisions/batch=*")
