"""Views that turn the sample tables into bars, chains and scored labels.

Each view exists twice: as a DataFrame built with the library and as the SQL
text (DuckDB dialect) that the correctness check runs.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.blocks import spread, time_bucket
from tickloom.functions.lineage import cut
from tickloom.functions.prefix import number_rows
from tickloom.operators.evaluate import fold_summary
from tickloom.operators.factors import market_returns
from tickloom.operators.labels import current_state, stack_horizons, transition_target, transition_targets
from tickloom.sources.bars import trades_to_bars


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars, aggregated from the trades once and stored.

    The window layout reads its input twice (rows and row counts), and most
    queries read bars more than once, so the aggregation is not repeated.
    """
    lines = table(spark, sf, "lineitem")
    return cut(trades_to_bars(
        lines,
        symbol=F.concat("l_returnflag", "l_linestatus"),
        bucket=F.to_date("l_shipdate"),
        price=F.col("l_extendedprice"),
        sequence=F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"),
        volume=F.col("l_quantity"),
    ))


def price_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ticks; the value is floored so that logarithms exist."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.greatest("value", F.lit(0.01)).alias("price"),
    )


def bars_intraday(spark: SparkSession, sf: str) -> DataFrame:
    return cut(trades_to_bars(
        price_events(spark, sf), F.col("symbol"), F.date_trunc("HOUR", "ts"), F.col("price"),
        F.col("ts"), F.lit(1.0), time="bar_start",
    ))


def spots(spark: SparkSession, sf: str) -> DataFrame:
    """Last price per symbol and day."""
    return price_events(spark, sf).groupBy("symbol", F.to_date("ts").alias("as_of")).agg(
        F.max_by("price", "ts").alias("spot")
    )


def chain(spark: SparkSession, sf: str) -> DataFrame:
    """Three weekly expiries, 96 strikes, calls and puts for every spot."""
    friday = F.pmod(3 - F.weekday("as_of"), F.lit(7)) + 1
    grid = (
        spots(spark, sf)
        .withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2))))
        .withColumn("expiration_date", F.date_add("as_of", (friday + 7 * F.col("n")).cast("int")))
        .withColumn("k", F.explode(F.sequence(F.lit(25), F.lit(500), F.lit(5))))
        .withColumn("option_type", F.explode(F.array(F.lit("call"), F.lit("put"))))
    )
    base = F.greatest(F.datediff("expiration_date", "as_of") / F.lit(10.0), F.lit(0.5))
    smile = 0.15 + 0.01 * ((F.col("k") / 5).cast("int") % 10)
    return grid.select(
        "symbol", "as_of", "spot", "expiration_date", F.col("k").cast("double").alias("strike"),
        "option_type", F.round(base, 2).alias("bid"), F.round(base + 0.20, 2).alias("ask"),
        (smile + F.when(F.col("option_type") == "put", 0.02).otherwise(0.0)).alias("implied_volatility"),
    )


def market(spark: SparkSession, sf: str) -> DataFrame:
    return market_returns(bars_daily(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with returns, volatility, transition label and row number."""
    frame = spread(bars_daily(spark, sf), 252 + 22, 1)
    frame = transition_target(frame)
    keep = frame.filter("home")
    return keep.select(
        "symbol", "bar_date", "close", "returns", "Volatility_20d",
        F.col("transition").alias("label"), "rn",
    )


def pseudo_score():
    first, second = F.ascii(F.substring("symbol", 1, 1)), F.ascii(F.substring("symbol", 2, 1))
    mixed = F.col("rn") * 7919 + first.cast("long") * 104729 + second.cast("long") * 1299709
    return (mixed % 10007).cast("double") / 10007.0


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Known labels with a deterministic score; no model is involved.

    Stored, like the output of a scoring job: every rank metric reads it twice.
    """
    rows = labelled(spark, sf).filter(F.col("label").isNotNull())
    return cut(rows.withColumn("score", pseudo_score()).withColumn("pred", F.col("score") >= 0.9))


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).filter("score >= 0.55").select(
        "symbol", "bar_date", "score", "label", F.substring("symbol", 1, 1).alias("sector"),
        F.year("bar_date").cast("string").alias("book"),
    )


def dirty_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with damage at fixed row numbers."""
    rows = with_row_number(bars_daily(spark, sf))
    rn = F.col("rn")
    swapped = rn % 89 == 0
    damaged = rows.select(
        "symbol", "bar_date", "open",
        F.when(swapped, F.col("low")).otherwise(F.col("high")).alias("high"),
        F.when(swapped, F.col("high")).otherwise(F.col("low")).alias("low"),
        F.when(rn % 97 != 0, F.col("close")).alias("close"),
        F.when(rn % 83 == 0, F.lit(0.0)).otherwise(F.col("volume")).alias("volume"),
        "rn",
    )
    copies = F.when(rn % 101 == 0, 2).otherwise(1)
    return damaged.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def with_row_number(bars: DataFrame) -> DataFrame:
    return number_rows(bars, ["symbol"], time_bucket(bars, "bar_date"), [F.col("bar_date")])


# --- the same views as SQL ----------------------------------------------------

BARS_SQL = """
bars AS (
  SELECT concat(l_returnflag, l_linestatus) AS symbol, CAST(l_shipdate AS DATE) AS bar_date,
         min_by(l_extendedprice, k) AS open, max(l_extendedprice) AS high,
         min(l_extendedprice) AS low, max_by(l_extendedprice, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) t
  GROUP BY 1, 2)
"""

TICKS_SQL = """
ticks AS (SELECT event_type AS symbol, ts, greatest(value, 0.01) AS price FROM events)
"""

INTRADAY_SQL = TICKS_SQL + """,
ibars AS (
  SELECT symbol, date_trunc('hour', ts) AS bar_start, min_by(price, ts) AS open, max(price) AS high,
         min(price) AS low, max_by(price, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM ticks GROUP BY 1, 2)
"""

SPOT_SQL = TICKS_SQL + """,
spot AS (SELECT symbol, CAST(ts AS DATE) AS as_of, max_by(price, ts) AS spot FROM ticks GROUP BY 1, 2)
"""

CHAIN_SQL = SPOT_SQL + """,
chain AS (
  SELECT symbol, as_of, spot, expiration_date, CAST(k AS DOUBLE) AS strike, option_type,
         CAST(round(greatest(date_diff('day', as_of, expiration_date) / 10.0, 0.5), 2) AS DOUBLE) AS bid,
         CAST(round(greatest(date_diff('day', as_of, expiration_date) / 10.0, 0.5) + 0.20, 2) AS DOUBLE) AS ask,
         0.15::DOUBLE + 0.01::DOUBLE * ((k // 5) % 10)
           + CASE WHEN option_type = 'put' THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END AS implied_volatility
  FROM (SELECT *, as_of + CAST(1 + ((3 - (isodow(as_of) - 1) + 7) % 7) + 7 * n AS INTEGER) AS expiration_date
        FROM spot, range(0, 3) r(n)) s,
       range(25, 501, 5) g(k), (VALUES ('call'), ('put')) o(option_type))
"""

VOL_SQL = BARS_SQL + """,
ret AS (
  SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS returns,
         row_number() OVER w AS rn
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)),
vol AS (
  SELECT *, CASE WHEN count(returns) OVER w20 >= 20 THEN stddev_samp(returns) OVER w20 END AS vol
  FROM ret WINDOW w20 AS (PARTITION BY symbol ORDER BY bar_date ROWS 19 PRECEDING))
"""


def thresholds_sql(*percentiles: float) -> str:
    """Rolling 252-row quantiles of the volatility, NULL until 252 are known."""
    columns = ", ".join(
        f"CASE WHEN count(vol) OVER w252 >= 252 THEN quantile_cont(vol, {p}) OVER w252 END AS q{round(p * 100)}"
        for p in percentiles
    )
    return f""",
thr AS (
  SELECT *, {columns}
  FROM vol WINDOW w252 AS (PARTITION BY symbol ORDER BY bar_date ROWS 251 PRECEDING))
"""


LABEL_SQL = VOL_SQL + thresholds_sql(0.75) + """,
hi AS (SELECT *, coalesce(vol > q75, false) AS is_high FROM thr),
lab AS (
  SELECT *, CASE WHEN q75 IS NOT NULL AND lead(is_high) OVER w IS NOT NULL
                 THEN CAST(NOT is_high AND lead(is_high) OVER w AS INTEGER) END AS label
  FROM hi WINDOW w AS (PARTITION BY symbol ORDER BY bar_date))
"""

SCORED_SQL = LABEL_SQL + """,
scored AS (
  SELECT *, score >= 0.9 AS pred FROM (
    SELECT symbol, bar_date, close, returns, vol, label, rn,
           CAST((rn * 7919 + ascii(substr(symbol, 1, 1)) * 104729 + ascii(substr(symbol, 2, 1)) * 1299709) % 10007 AS DOUBLE) / 10007.0 AS score
    FROM lab WHERE label IS NOT NULL) t)
"""

ALERTS_SQL = SCORED_SQL + """,
alerts AS (SELECT symbol, bar_date, score, label, substr(symbol, 1, 1) AS sector,
                  CAST(year(bar_date) AS VARCHAR) AS book FROM scored WHERE score >= 0.55)
"""

DIRTY_SQL = BARS_SQL + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS rn FROM bars),
dirty AS (
  SELECT symbol, bar_date, open,
         CASE WHEN rn % 89 = 0 THEN low ELSE high END AS high,
         CASE WHEN rn % 89 = 0 THEN high ELSE low END AS low,
         CASE WHEN rn % 97 <> 0 THEN close END AS close,
         CASE WHEN rn % 83 = 0 THEN 0.0 ELSE volume END AS volume, rn
  FROM numbered, range(1, 3) c(copy) WHERE copy = 1 OR rn % 101 = 0)
"""


# --- scored rows by period, and fold metrics -----------------------------------


def scored_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows keyed like experiment output: model = symbol, period = year."""
    return scored(spark, sf).withColumns({"model": F.col("symbol"), "period": F.year("bar_date")})


PERIODS_SQL = SCORED_SQL + """,
sp AS (SELECT *, symbol AS model, CAST(year(bar_date) AS INTEGER) AS period FROM scored)
"""


def metrics_sql(source: str, keys: str, name: str) -> str:
    """CTE `name` with classification and rank metrics per key."""
    return f""",
{name}_c AS (
  SELECT {keys}, count(*) FILTER (WHERE label = 0 AND NOT pred) AS tn, count(*) FILTER (WHERE label = 0 AND pred) AS fp,
         count(*) FILTER (WHERE label = 1 AND NOT pred) AS fn, count(*) FILTER (WHERE label = 1 AND pred) AS tp,
         avg(pow(score - label, 2)) AS brier
  FROM {source} GROUP BY {keys}),
{name}_h AS (SELECT {keys}, score, count(*) AS n, sum(label) AS pos FROM {source} GROUP BY {keys}, score),
{name}_r AS (
  SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY score DESC) AS n_ge,
         sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC) AS pos_ge,
         sum(n) OVER (PARTITION BY {keys} ORDER BY score) - n / 2.0 + 0.5 AS avg_rank,
         sum(n) OVER (PARTITION BY {keys}) AS total, sum(pos) OVER (PARTITION BY {keys}) AS p
  FROM {name}_h),
{name}_k AS (
  SELECT {keys}, CAST(max(total) AS BIGINT) AS rows, CAST(max(p) AS BIGINT) AS positives,
         CASE WHEN max(p) > 0 AND max(total) > max(p)
              THEN (sum(pos * avg_rank) - max(p) * (max(p) + 1) / 2.0) / (max(p) * (max(total) - max(p))) ELSE 0.0 END AS roc_auc,
         CASE WHEN max(p) > 0 AND max(total) > max(p) THEN sum(pos * pos_ge / n_ge) / max(p) ELSE 0.0 END AS pr_auc
  FROM {name}_r GROUP BY {keys}),
{name} AS (
  SELECT *, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0.0) AS "precision",
         coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0.0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0.0) AS f1
  FROM {name}_c JOIN {name}_k USING ({keys}))
"""


def state_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows with the current state flags."""
    frame = spread(bars_daily(spark, sf), 252 + 23, 1)
    frame = current_state(transition_target(frame)).filter("home")
    rows = frame.select(
        "symbol", "bar_date", "close", "returns", "Volatility_20d", "current_transition",
        F.col("transition").alias("label"), "rn",
    ).filter("label IS NOT NULL")
    return cut(rows.withColumn("score", pseudo_score()).withColumns({
        "pred": F.col("score") >= 0.9, "model": F.col("symbol"), "period": F.year("bar_date"),
    }))


STATE_SQL = PERIODS_SQL + """,
st AS (SELECT symbol, bar_date, coalesce(greatest(CAST(is_high AS INTEGER) - lag(CAST(is_high AS INTEGER)) OVER (PARTITION BY symbol ORDER BY bar_date), 0), 0) AS state FROM hi),
ss AS (SELECT sp.*, st.state FROM sp JOIN st USING (symbol, bar_date))
"""


def top_sql(source: str, keys: str, size: str) -> str:
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, symbol, bar_date) AS place, "
        f"count(*) OVER (PARTITION BY {keys}) AS n FROM {source}) t WHERE place <= {size})"
    )


def fold_metrics(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    rows = state_scored(spark, sf) if rows is None else rows
    return cut(fold_summary(rows, ["model", "period"]).withColumn("horizon", F.lit(1)))


FOLD_METRICS_SQL = (
    STATE_SQL
    + metrics_sql("ss", "model, period", "m")
    + ", ps AS (SELECT model, period, symbol, label, CAST(state AS DOUBLE) AS score, state = 1 AS pred FROM ss)"
    + metrics_sql("ps", "model, period", "pb")
    + f""",
t5 AS (SELECT model, period, avg(label) AS precision_at_5pct FROM {top_sql('ss', 'model, period', 'greatest(1, ceil(n * 0.05))')} x GROUP BY 1, 2),
t1 AS (SELECT model, period, avg(label) AS p1 FROM {top_sql('ss', 'model, period', 'greatest(1, ceil(n * 0.01))')} x GROUP BY 1, 2),
fm AS (
  SELECT m.*, 1 AS horizon, precision_at_5pct, coalesce(p1 / nullif(m.positives / m.rows::DOUBLE, 0), 0.0) AS lift_1pct,
         m.positives / m.rows::DOUBLE AS positive_rate, pb.f1 AS baseline_f1
  FROM m JOIN t5 USING (model, period) JOIN t1 USING (model, period) JOIN pb USING (model, period))
"""
)


# --- the same with the horizon as a dimension --------------------------------------

HORIZONS = (1, 5)


def horizon_scored(spark: SparkSession, sf: str) -> DataFrame:
    """`state_scored` with one row per horizon whose label is known."""
    frame = spread(bars_daily(spark, sf), 252 + 23, max(HORIZONS))
    frame = current_state(transition_targets(frame, HORIZONS)).filter("home")
    rows = stack_horizons(frame.select(
        "symbol", "bar_date", "close", "returns", "Volatility_20d", "current_transition", "rn", *[f"transition_{h}" for h in HORIZONS]), HORIZONS)
    return cut(rows.withColumn("score", pseudo_score()).withColumns({
        "pred": F.col("score") >= 0.9, "model": F.col("symbol"), "period": F.year("bar_date"),
    }))


def horizon_metrics(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    return cut(fold_summary(horizon_scored(spark, sf) if rows is None else rows, ["model", "horizon", "period"]))


_EACH_HORIZON = " UNION ALL ".join(
    f"SELECT *, {h} AS horizon, CASE WHEN q75 IS NOT NULL AND lead(is_high, {h}) OVER w IS NOT NULL THEN CAST(NOT is_high AND lead(is_high, {h}) OVER w AS INTEGER) END AS label "
    "FROM hi WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)" for h in HORIZONS
)
HORIZON_SQL = VOL_SQL + thresholds_sql(0.75) + f""",
hi AS (SELECT *, coalesce(vol > q75, false) AS is_high FROM thr),
lab AS MATERIALIZED ({_EACH_HORIZON}),
sp AS (
  SELECT *, score >= 0.9 AS pred, symbol AS model, CAST(year(bar_date) AS INTEGER) AS period FROM (
    SELECT symbol, bar_date, close, returns, vol, horizon, label, rn,
           CAST((rn * 7919 + ascii(substr(symbol, 1, 1)) * 104729 + ascii(substr(symbol, 2, 1)) * 1299709) % 10007 AS DOUBLE) / 10007.0 AS score
    FROM lab WHERE label IS NOT NULL) t),
st AS (SELECT symbol, bar_date, coalesce(greatest(CAST(is_high AS INTEGER) - lag(CAST(is_high AS INTEGER)) OVER (PARTITION BY symbol ORDER BY bar_date), 0), 0) AS state FROM hi),
ss AS MATERIALIZED (SELECT sp.*, st.state FROM sp JOIN st USING (symbol, bar_date)),
ps AS (SELECT model, horizon, period, symbol, label, CAST(state AS DOUBLE) AS score, state = 1 AS pred FROM ss)""" + metrics_sql("ss", "model, horizon, period", "m") + metrics_sql("ps", "model, horizon, period", "pb") + f""",
t5 AS (SELECT model, horizon, period, avg(label) AS precision_at_5pct FROM {top_sql('ss', 'model, horizon, period', 'greatest(1, ceil(n * 0.05))')} x GROUP BY 1, 2, 3),
t1 AS (SELECT model, horizon, period, avg(label) AS p1 FROM {top_sql('ss', 'model, horizon, period', 'greatest(1, ceil(n * 0.01))')} x GROUP BY 1, 2, 3),
fm AS MATERIALIZED (
  SELECT m.*, precision_at_5pct, coalesce(p1 / nullif(m.positives / m.rows::DOUBLE, 0), 0.0) AS lift_1pct,
         m.positives / m.rows::DOUBLE AS positive_rate, pb.f1 AS baseline_f1
  FROM m JOIN t5 USING (model, horizon, period) JOIN t1 USING (model, horizon, period) JOIN pb USING (model, horizon, period))
"""
