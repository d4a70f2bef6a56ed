"""Alert approval under portfolio limits, sizing, open positions and symbol ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.lineage import cut
from tickloom.functions.scalars import attach_row

# Decision limits (fixed values).
MIN_SCORE = 0.55
CAPACITY = 10
PER_SYMBOL = 3
WINDOW_DAYS = 5
SECTOR_PENALTY = 0.15
MAX_POSITION = 0.10


def alert_size(score: Column) -> Column:
    """Share of the account: the score's position between the minimum and 1, times 10 %."""
    share = (score - MIN_SCORE) / (1 - MIN_SCORE)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * MAX_POSITION


# Alerts per book walked in one round.
_SHORTLIST = 64
_APPROVED = "array<struct<place:struct<s:double,symbol:string,d:date>,sector:string>>"


def _place() -> Column:
    """Position in the decision order: score descending, then symbol and date."""
    return F.struct((-F.col("score")).alias("s"), F.col("symbol").alias("symbol"), F.col("bar_date").alias("d"))


def _same_symbol(approved: Column, symbol: Column, day: Column) -> Column:
    cutoff = F.date_sub(day, WINDOW_DAYS)
    return F.size(F.filter(approved, lambda a: (a["place"]["symbol"] == symbol) & (a["place"]["d"] > cutoff)))


def _same_sector(approved: Column, sector: Column) -> Column:
    return F.size(F.filter(approved, lambda a: a["sector"] == sector))


def _passes(approved: Column, symbol: Column, day: Column, sector: Column, score: Column) -> Column:
    penalty = SECTOR_PENALTY * _same_sector(approved, sector)
    return (_same_symbol(approved, symbol, day) < PER_SYMBOL) & (score - penalty >= MIN_SCORE)


# Reasons (fixed values).
LOW_SCORE = "Score %.3f < min %.3f"
FULL = "Portfolio at capacity (%d)"
CROWDED = "%d alerts in %dd window (max %d)"
LOW_ADJUSTED = "Adjusted score %.3f < min %.3f (sector_overlap_%d)"


def decide_alerts(alerts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Greedy approval in score order, one decision list per `book`.

    Limits only tighten as approvals are added, so an alert that fails once
    fails for good.  A round therefore keeps the alerts that still pass, takes
    the first few of each book (a row-number limit, which Spark applies before
    the shuffle) and walks that short list.  A book is done when it is full or
    its list was not; every other round approves at least one alert, so there
    are at most `capacity` rounds, usually one or two.  No task holds a book.

    Input: (book, symbol, sector, bar_date, score), one row per book, symbol and
    date.  Adds `approved`, `reason`, `adjusted_score` and `position_size`.
    """
    alerts = cut(alerts)
    candidates = alerts.filter(F.col("score") >= MIN_SCORE).withColumn("place", _place())
    state = candidates.select("book").distinct().withColumns(
        {"approved": F.array().cast(_APPROVED), "open": F.lit(True)}
    )
    for _ in range(capacity):
        state = cut(_walk_shortlists(candidates, state, capacity))
        if state.filter("open").isEmpty():
            break
    return _explain(alerts, state.drop("open"), capacity)


def _walk_shortlists(candidates: DataFrame, state: DataFrame, capacity: int) -> DataFrame:
    """One round: extend the approvals of every open book by its short list."""
    approved = F.col("approved")
    after = (F.size(approved) == 0) | (F.col("place") > F.try_element_at(approved, F.lit(-1))["place"])
    passing = candidates.join(state.filter("open"), "book").filter(
        after & _passes(approved, F.col("symbol"), F.col("bar_date"), F.col("sector"), F.col("score"))
    )
    first = passing.withColumn("_n", F.row_number().over(Window.partitionBy("book").orderBy("place"))).filter(
        F.col("_n") <= _SHORTLIST
    )
    lists = first.groupBy("book").agg(
        F.sort_array(F.collect_list(F.struct("place", "sector", "score"))).alias("_list")
    )

    def step(held, alert):
        place, sector = alert["place"], alert["sector"]
        ok = (F.size(held) < capacity) & _passes(held, place["symbol"], place["d"], sector, alert["score"])
        longer = F.concat(held, F.array(F.struct(place.alias("place"), sector.alias("sector"))).cast(_APPROVED))
        return F.when(ok, longer).otherwise(held)

    walked = F.aggregate("_list", approved, step)
    more = F.coalesce(F.size("_list") == _SHORTLIST, F.lit(False))
    joined = state.join(lists, "book", "left").withColumn("_more", more)
    return joined.select(
        "book", F.when(F.col("_list").isNull(), approved).otherwise(walked).alias("approved"), "_more"
    ).select("book", "approved", (F.col("_more") & (F.size("approved") < capacity)).alias("open"))


def _explain(alerts: DataFrame, state: DataFrame, capacity: int) -> DataFrame:
    """Replay each alert against the approvals that came before it."""
    rows = alerts.withColumn("place", _place()).join(state, "book", "left")
    rows = rows.withColumn("_mine", F.exists("approved", lambda a: a["place"] == F.col("place")))
    before = F.coalesce(
        F.filter("approved", lambda a: a["place"] < F.col("place")), F.array().cast(_APPROVED)
    )
    rows = rows.withColumn("_before", before)
    rows = rows.withColumns({
        "_symbol": _same_symbol(F.col("_before"), F.col("symbol"), F.col("bar_date")),
        "_sector": _same_sector(F.col("_before"), F.col("sector")),
    })
    adjusted = F.col("score") - SECTOR_PENALTY * F.col("_sector")
    ok = F.coalesce("_mine", F.lit(False))
    reason = (
        F.when(F.col("score") < MIN_SCORE, F.format_string(LOW_SCORE, "score", F.lit(MIN_SCORE)))
        .when(F.size("_before") >= capacity, F.lit(FULL % capacity))
        .when(
            F.col("_symbol") >= PER_SYMBOL,
            F.format_string(CROWDED, "_symbol", F.lit(WINDOW_DAYS), F.lit(PER_SYMBOL)),
        )
        .when(ok, "approved")
        .otherwise(F.format_string(
            LOW_ADJUSTED, adjusted, F.lit(MIN_SCORE), F.col("_sector")
        ))
    )
    return rows.select(
        *alerts.columns, ok.alias("approved"), reason.alias("reason"),
        F.when(ok, adjusted).otherwise(F.col("score")).alias("adjusted_score"),
        F.when(ok, alert_size(F.col("score"))).otherwise(0.0).alias("position_size"),
    )


# --- decisions in the order of dates, with positions that expire ------------------------

_HELD = "array<struct<d:date,s:double,symbol:string,sector:string>>"
_STOP = "struct<d:date,s:double,symbol:string>"


def _in_time() -> Column:
    """Position in the order of dates: date, then score descending, then symbol."""
    return F.struct(F.col("bar_date").alias("d"), (-F.col("score")).alias("s"), F.col("symbol").alias("symbol"))


def _open_at(held: Column, day: Column, hold_days: int) -> Column:
    return F.filter(held, lambda a: (F.datediff(day, a["d"]) >= 0) & (F.datediff(day, a["d"]) < hold_days))


def _crowd(held: Column, symbol: Column, day: Column) -> Column:
    return F.size(F.filter(held, lambda a: (a["symbol"] == symbol) & (a["d"] > F.date_sub(day, WINDOW_DAYS))))


def decide_by_date(alerts: DataFrame, positions: DataFrame, capacity: int = CAPACITY, hold_days: int = 5) -> DataFrame:
    """Approval in the order of dates, by score within a date, against positions that are open for `hold_days`.

    Input: (book, symbol, sector, bar_date, score), and open positions (book, symbol, sector, bar_date) from before.
    Adds `approved`, `reason` and `adjusted_score`.

    Positions open at an alert's date only grow while it waits, so an alert that fails once fails for good.  A round takes
    the first few alerts of each book and date that still pass (a row-number limit, which Spark applies before the shuffle)
    and walks these lists date by date, up to a date whose list was cut off before the book was full; the next round goes
    on there.  A list's first alert always passes, so every round makes progress; usually one or two are enough.
    """
    alerts = cut(alerts)
    candidates = alerts.filter(F.col("score") >= MIN_SCORE).withColumn("place", _in_time())
    before = positions.groupBy("book").agg(F.sort_array(F.collect_list(
        F.struct(F.col("bar_date").alias("d"), F.lit(float("-inf")).alias("s"), "symbol", "sector"))).cast(_HELD).alias("held"))
    state = cut(candidates.select("book").distinct().join(before, "book", "left").select(
        "book", F.coalesce("held", F.array().cast(_HELD)).alias("held"), F.lit(None).cast(_STOP).alias("done"), F.lit(True).alias("open")))
    while True:
        state = cut(_walk_dates(candidates, state, capacity, hold_days))
        if state.filter("open").isEmpty():
            return _explain_by_date(alerts, state, capacity, hold_days)


def _walk_dates(candidates: DataFrame, state: DataFrame, capacity: int, hold_days: int) -> DataFrame:
    """One round: extend the positions of every open book by the lists of its dates."""
    after = F.col("done").isNull() | (F.col("place") > F.col("done"))
    there = _open_at(F.col("held"), F.col("bar_date"), hold_days)
    passing = candidates.join(state.filter("open"), "book").filter(after).withColumn("there", there).filter(
        (F.size("there") < capacity) & (_crowd(F.col("there"), F.col("symbol"), F.col("bar_date")) < PER_SYMBOL)
        & (F.col("score") - SECTOR_PENALTY * _same_sector(F.col("there"), F.col("sector")) >= MIN_SCORE))
    rank = F.row_number().over(Window.partitionBy("book", "bar_date").orderBy("place"))
    first = passing.select("book", "bar_date", "place", "sector", "score", rank.alias("n")).filter(F.col("n") <= _SHORTLIST)
    lists = first.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("place", "sector", "score", "n"))).alias("list"))

    def step(acc, alert):
        place, sector = alert["place"], alert["sector"]
        near = _open_at(acc["near"], place["d"], hold_days)
        fits = (
            (F.size(near) < capacity) & (_crowd(near, place["symbol"], place["d"]) < PER_SYMBOL)
            & (alert["score"] - SECTOR_PENALTY * _same_sector(near, sector) >= MIN_SCORE))
        ok = acc["stop"].isNull() & fits
        new = F.array(F.struct(place["d"].alias("d"), place["s"].alias("s"), place["symbol"].alias("symbol"), sector.alias("sector"))).cast(_HELD)
        room = F.size(near) + F.when(ok, 1).otherwise(0) < capacity
        stops = acc["stop"].isNull() & (alert["n"] == _SHORTLIST) & room
        # Dates ascend: what has expired at one date stays expired.
        kept = F.filter(acc["near"], lambda a: F.datediff(place["d"], a["d"]) < hold_days)
        return F.struct(
            F.when(ok, F.concat(kept, new)).otherwise(kept).alias("near"),
            F.when(ok, F.concat(acc["added"], new)).otherwise(acc["added"]).alias("added"),
            F.when(stops, place.cast(_STOP)).otherwise(acc["stop"]).alias("stop"))

    start = F.struct(F.col("held").alias("near"), F.array().cast(_HELD).alias("added"), F.lit(None).cast(_STOP).alias("stop"))
    walked = state.join(lists, "book", "left").withColumn("walked", F.aggregate(F.coalesce("list", F.array().cast(lists.schema["list"].dataType)), start, step))
    stop = F.col("walked.stop")
    return walked.select("book", F.concat("held", "walked.added").alias("held"), F.coalesce(stop, "done").alias("done"), (F.col("open") & stop.isNotNull()).alias("open"))


def _explain_by_date(alerts: DataFrame, state: DataFrame, capacity: int, hold_days: int) -> DataFrame:
    """Each alert beside the positions open at its date that were taken before it: at most `capacity`, and those of its date."""
    taken = state.select("book", F.explode("held").alias("a"))
    open_on = taken.select("book", "a", F.explode(F.sequence(F.lit(0), F.lit(hold_days - 1))).alias("age")).groupBy(
        "book", F.date_add(F.col("a.d"), F.col("age")).alias("bar_date")).agg(F.collect_list("a").alias("there"))
    rows = alerts.withColumn("place", _in_time()).join(open_on, ["book", "bar_date"], "left")
    mine = F.exists("there", lambda a: F.struct(a["d"].alias("d"), a["s"].alias("s"), a["symbol"].alias("symbol")) == F.col("place"))
    earlier = F.filter("there", lambda a: F.struct(a["d"].alias("d"), a["s"].alias("s"), a["symbol"].alias("symbol")) < F.col("place"))
    rows = rows.withColumns({"ok": F.coalesce(mine, F.lit(False)), "near": F.coalesce(earlier, F.array().cast(_HELD))})
    rows = rows.withColumns({"_crowd": _crowd(F.col("near"), F.col("symbol"), F.col("bar_date")), "_sector": _same_sector(F.col("near"), F.col("sector"))})
    adjusted = F.col("score") - SECTOR_PENALTY * F.col("_sector")
    reason = (
        F.when(F.col("score") < MIN_SCORE, F.format_string(LOW_SCORE, "score", F.lit(MIN_SCORE)))
        .when(F.size("near") >= capacity, F.lit(FULL % capacity))
        .when(F.col("_crowd") >= PER_SYMBOL, F.format_string(CROWDED, "_crowd", F.lit(WINDOW_DAYS), F.lit(PER_SYMBOL)))
        .when(F.col("ok"), "approved")
        .otherwise(F.format_string(LOW_ADJUSTED, adjusted, F.lit(MIN_SCORE), F.col("_sector"))))
    return rows.select(*alerts.columns, F.col("ok").alias("approved"), reason.alias("reason"), F.when(F.col("ok"), adjusted).otherwise(F.col("score")).alias("adjusted_score"))


def open_positions(decided: DataFrame, day, hold_days: int = 5) -> DataFrame:
    """Approved alerts younger than hold_days at a date."""
    return decided.filter("approved").filter(F.datediff(F.lit(day).cast("date"), "bar_date") < hold_days)


def rank_symbols(metrics: DataFrame) -> DataFrame:
    """Composite score from average precision, F1 and lift; best first."""
    lift = F.least(F.col("lift_1pct") / 20, F.lit(1.0))
    return metrics.withColumn("rank_score", 0.4 * F.col("pr_auc") + 0.4 * F.col("f1") + 0.2 * lift).orderBy(
        F.desc("rank_score"), "symbol"
    )


def allocation_weights(ranked: DataFrame) -> DataFrame:
    """Share of the total score; equal shares when the total is zero."""
    total = ranked.agg(F.sum("rank_score").alias("_total"), F.count("*").alias("_n"))
    weight = F.when(F.col("_total") == 0, 1 / F.col("_n")).otherwise(F.try_divide("rank_score", "_total"))
    return attach_row(ranked, total).withColumn("weight", weight).drop("_total", "_n")
