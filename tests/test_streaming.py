"""Streams fed in several steps, so that state crosses micro-batches."""

import datetime as dt

from pyspark.sql import functions as F

from tickloom.operators import governance
from tickloom.sources.audit_log import read_audit
from tickloom.streaming import alerts, audit, drift
from tickloom.streaming.bars import stream_bars


def steps(spark, tmp_path, schema, batches, name):
    """A stream that reads one file per micro-batch, in order."""
    import os

    folder = str(tmp_path / name)
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        part = str(tmp_path / f"{name}-{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        file = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        target = f"{folder}/{i:03d}.parquet"
        with open(f"{part}/{file}", "rb") as source, open(target, "wb") as sink:
            sink.write(source.read())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def collect(stream, spark, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_late_ticks_inside_the_watermark_count(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 10, m)
    batches = [[("A", t(1), 10.0), ("A", t(9), 12.0)], [("A", t(2), 8.0), ("A", t(30), 9.0)], [("A", t(45), 9.0)], [("A", t(3), 99.0), ("A", t(59), 9.0)]]
    source = steps(spark, tmp_path, "symbol string, ts timestamp, price double", batches, "ticks")
    got = {r.bar_start.minute: r for r in collect(stream_bars(source), spark, "bars")}
    assert got[0].low == 8.0 and got[0].high == 10.0 and got[0].volume == 2.0
    assert 55 not in got


def test_drift_state_crosses_batches(spark, tmp_path):
    d = lambda m: dt.datetime(2024, m, 1)
    batches = [[("m", d(1), 10, 5)], [("m", d(2), 10, 0)], [("m", d(3), 10, 1)], [("m", d(4), 0, 0), ("n", d(4), 10, 9)]]
    source = steps(spark, tmp_path, "model string, batch timestamp, predicted long, hits long", batches, "batches")
    got = {(r.model, r.batch.month): (r.degraded, r.severity) for r in collect(drift.performance_drift(source, 0.5), spark, "drift")}
    assert got == {("m", 1): (0, "low"), ("m", 2): (1, "low"), ("m", 3): (2, "moderate"), ("m", 4): (3, "high"), ("n", 4): (0, "low")}


def test_alert_positions_expire(spark, tmp_path):
    d = lambda n: dt.date(2024, 1, n)
    row = lambda s, n, v: ("b", s, "tech", d(n), v)
    batches = [[row("A", 1, 0.9), row("B", 1, 0.6)], [row("C", 2, 0.65), row("D", 2, 0.75)], [row("B", 8, 0.6), row("E", 8, 0.4)]]
    source = steps(spark, tmp_path, "book string, symbol string, sector string, bar_date date, score double", batches, "alerts")
    got = {(r.symbol, r.bar_date.day): r.approved for r in collect(alerts.decide(source), spark, "decisions")}
    assert got == {("A", 1): True, ("B", 1): False, ("D", 2): True, ("C", 2): False, ("B", 8): True, ("E", 8): False}


ALERTS = "book string, symbol string, sector string, bar_date date, score double"


def walk(rows, capacity=10, hold=5):
    """The plain sequential walk: date, then score descending, then symbol."""
    held, out = {}, {}
    for book, symbol, sector, day, score in sorted(rows, key=lambda r: (r[0], r[3], -r[4], r[1])):
        near = [h for h in held.get(book, []) if 0 <= (day - h[2]).days < hold]
        same, overlap = sum(h[0] == symbol and (day - h[2]).days < 5 for h in near), sum(h[1] == sector for h in near)
        ok = score >= 0.55 and len(near) < capacity and same < 3 and score - 0.15 * overlap >= 0.55
        if ok:
            held.setdefault(book, []).append((symbol, sector, day))
        out[book, symbol, day] = ok
    return out


def random_alerts(seed, days=12):
    import random

    rng = random.Random(seed)
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    return [(b, f"S{k}", f"sec{k % 12}", d(n), round(rng.uniform(0.4, 1.0), 3)) for b in "xy" for n in range(days) for k in rng.sample(range(60), 25)]


def test_batches_decide_like_the_sequential_walk(spark, tmp_path, monkeypatch):
    from tickloom.operators import alerts as batch

    rows = random_alerts(1)
    monkeypatch.setattr(batch, "_SHORTLIST", 8)  # many rounds
    split = [[r for r in rows if lo <= r[3].toordinal() - dt.date(2024, 1, 1).toordinal() < lo + 6] for lo in (0, 6)]
    for name, batches in (("one", [rows]), ("two", split)):
        table = alerts.decide_batches(steps(spark, tmp_path, ALERTS, batches, name), spark, str(tmp_path / f"{name}-out"))
        got = table.collect()
        assert len(got) == len(rows) and {(r.book, r.symbol, r.bar_date): r.approved for r in got} == walk(rows)
        assert all((r.reason == "approved") == r.approved and r.approved == (r.adjusted_score != r.score or r.approved) for r in got)


def test_late_alerts_get_a_row_and_repeated_batches_change_nothing(spark, tmp_path):
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    batches = [[("b", "A", "s", d(60), 0.9)], [("b", "B", "t", d(20), 0.9), ("b", "C", "s", d(58), 0.9), ("b", "D", "u", d(20), 0.1), ("b", "E", "s", d(61), 0.6)]]
    folder = str(tmp_path / "out")
    decider = alerts.batch_decider(folder)
    for k in (0, 1, 1):
        decider(spark.createDataFrame(batches[k], ALERTS), k)
    got = {r.symbol: (r.approved, r.reason) for r in spark.read.parquet(f"{folder}/decisions/batch=*").collect()}
    assert got == {"A": (True, "approved"), "B": (False, "Too late (before 2024-01-31)"), "C": (True, "approved"), "D": (False, "Too late (before 2024-01-31)"), "E": (False, "Adjusted score 0.300 < min 0.550 (sector_overlap_2)")}
    assert spark.read.parquet(f"{folder}/positions/batch=1").count() == 2
    decider(spark.createDataFrame([], ALERTS), 2)
    assert spark.read.parquet(f"{folder}/positions/batch=2").count() == 2 and spark.read.parquet(f"{folder}/newest/batch=2").first()[0] == d(61)


def test_audit_append_is_sealed_and_repeatable(spark, tmp_path):
    rows = spark.createDataFrame([("X", dt.date(2024, 1, 2), 0.7)], "symbol string, bar_date date, score double")
    records = governance.prediction_records(rows, F.lit("v1"), F.col("bar_date").cast("timestamp"))
    path = str(tmp_path / "log")
    write = audit.audit_writer(path, "test")
    write(records, 0)
    write(records, 0)
    write(records, 1)
    with open(f"{path}/stream=test/batch=1/extra.json", "w") as f:
        f.write('{"timestamp": broken\n')
    back = read_audit(spark, path)
    assert back.count() == 2 and governance.tampered(back).count() == 0
    forged = back.withColumn("score", F.col("score") + 0.1)
    assert governance.tampered(forged).count() == 2
