"""Distributed prefix helpers against plain numpy and plain windows, with hot keys and ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.blocks import gather, rolling, spread
from tickloom.functions.prefix import average_ranks, exact_percentiles, fine_cells, number_rows, order_cell, running, top_rows
from tickloom.functions.rolling import mean_n


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one key, a third of those with one value."""
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 40, n).astype(str))
    value = np.where(rng.random(n) < 0.3, 0.25, rng.normal(0, 1, n) * 10.0 ** rng.integers(-6, 6, n))
    pdf = pd.DataFrame({"key": key, "value": value, "id": np.arange(n)})
    return pdf, spark.createDataFrame(pdf)


def test_order_cell_is_monotone(spark):
    rng = np.random.default_rng(1)
    values = np.unique(np.concatenate([rng.normal(0, 1, 2000) * 10.0 ** rng.integers(-9, 9, 2000), [0.0], 2.0 ** np.arange(-20, 20)]))
    cells = [r.c for r in spark.createDataFrame(pd.DataFrame({"v": values})).orderBy("v").select(order_cell(F.col("v")).alias("c")).collect()]
    assert cells == sorted(cells)


def test_exact_percentiles(skewed):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.333, 0.5, 0.75, 0.9, 1.0]
    got = {r.key: r.q for r in exact_percentiles(df, ["key"], "value", probs).collect()}
    want = pdf.groupby("key")["value"].apply(lambda v: np.quantile(v, probs))
    assert set(got) == set(want.index)
    for key, q in got.items():
        np.testing.assert_allclose(q, want[key], rtol=1e-12, atol=1e-15)
    whole = exact_percentiles(df, [], "value", [0.5]).collect()
    assert len(whole) == 1 and np.isclose(whole[0].q[0], pdf["value"].median())
    assert exact_percentiles(df.filter("id < 0"), [], "value", [0.5]).count() == 0


def test_running_equals_plain_window(skewed):
    _, df = skewed
    plain = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "id", F.sum("value").over(plain).alias("s"), F.max("value").over(plain).alias("m"), F.count("*").over(plain).alias("n")
    )
    got = running(df, ["key"], F.floor(F.col("id") / 100), [F.col("id")], sums={"s": F.col("value")}, maxima={"m": F.col("value")})
    got = number_rows(got, ["key"], F.floor(F.col("id") / 64), [F.col("id")], "n")
    a, b = got.select("id", "s", "m", "n").toPandas().sort_values("id"), want.toPandas().sort_values("id")
    np.testing.assert_allclose(a["s"], b["s"], rtol=1e-6, atol=1e-6)
    assert (a["m"].to_numpy() == b["m"].to_numpy()).all() and (a["n"].to_numpy() == b["n"].to_numpy()).all()


def test_average_ranks(skewed):
    pdf, df = skewed
    table = average_ranks(df, ["key"], "value", {"w": F.lit(1)}).toPandas()
    want = pdf.assign(r=pdf.groupby("key")["value"].rank()).drop_duplicates(["key", "value"])
    merged = table.merge(want, on=["key", "value"])
    assert len(merged) == len(table) and (merged["avg_rank"] == merged["r"]).all()


@pytest.mark.parametrize("fraction", [0.01, 0.1, 0.5, 1.0])
def test_top_rows_with_hot_ties(skewed, fraction):
    pdf, df = skewed
    rows = df.select("key", F.round("value", 1).alias("value"), "id")
    limits = {"top": F.greatest(F.lit(1), F.ceil(F.col("group_size") * F.lit(fraction)))}
    got = top_rows(rows, ["key"], "value", limits, F.floor(F.col("id") / 50), [F.col("id")]).toPandas()
    ranked = rows.toPandas().sort_values(["value", "id"], ascending=[False, True])
    want = ranked.groupby("key", group_keys=False)[["key", "id"]].apply(lambda g: g.head(max(1, int(np.ceil(len(g) * fraction)))))
    assert set(got["id"]) == set(want["id"])


@rolling(lookback=30, order="day")
def _mean30(bars):
    return bars.withColumn("m", mean_n(F.col("x"), 30, "day"))


@pytest.mark.parametrize("block_rows", [16, 64, 5000])
def test_blocks_equal_one_window(spark, block_rows):
    """Blocks smaller than the look-back, and one hot series."""
    rng = np.random.default_rng(3)
    pdf = pd.concat([
        pd.DataFrame({"symbol": s, "day": pd.date_range("2000-01-01", periods=n).date, "x": rng.normal(size=n)})
        for s, n in (("hot", 900), ("b", 31), ("c", 7))
    ])
    df = spark.createDataFrame(pdf)
    got = gather(_mean30(spread(df, 30, order="day", block_rows=block_rows))).toPandas().sort_values(["symbol", "day"])
    want = pdf.sort_values(["symbol", "day"]).groupby("symbol")["x"].rolling(30).mean().to_numpy()
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got["m"].astype(float), want, rtol=1e-9, atol=1e-12)


# --- cells that hold very many values ---------------------------------------------------


@pytest.fixture(scope="module")
def crowded(spark):
    """Distinct values that share one cell of a 1024th of an octave, most of them close to its lower end, and some others."""
    rng = np.random.default_rng(5)
    near = 1.0 + 2.0**-11 * 10.0 ** rng.uniform(-9, 0, 4000)
    values = np.unique(np.concatenate([near, rng.normal(0, 1, 300), -near, [1e308, -1e308, 0.0]]))
    rng.shuffle(values)
    pdf = pd.DataFrame({"key": np.where(rng.random(len(values)) < 0.7, "hot", "other"), "value": values, "label": (rng.random(len(values)) < 0.2).astype(int)})
    pdf = pd.concat([pdf, pdf.sample(500, random_state=1)], ignore_index=True)
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def test_full_cells_are_split_until_none_is_full(crowded):
    _, df = crowded
    distinct = df.select("key", "value").distinct()
    assert distinct.groupBy("key", order_cell(F.col("value"))).count().agg(F.max("count")).first()[0] > 1_000
    cells = fine_cells(distinct, ["key"], "value", rows=100)
    assert cells.groupBy("key", "_cell").count().agg(F.max("count")).first()[0] <= 100
    assert cells.count() == distinct.count()
    for rows in cells.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("value", "_cell"))).alias("r")).collect():
        paths = [tuple(x._cell) for x in rows.r]
        assert paths == sorted(paths)
    same = df.select(F.lit("k").alias("key"), F.lit(2.5).alias("value"))
    assert fine_cells(same, ["key"], "value", rows=10).select(F.size("_cell")).distinct().count() == 1


def test_results_do_not_depend_on_the_bound(crowded, monkeypatch):
    from tickloom.functions import prefix

    pdf, df = crowded
    monkeypatch.setattr(prefix, "CELL_ROWS", 50)
    probs = [0.0, 0.2, 0.45, 0.5, 0.55, 0.9, 1.0]
    want = pdf.groupby("key")["value"].apply(lambda v: np.quantile(v, probs))
    for r in exact_percentiles(df, ["key"], "value", probs).collect():
        np.testing.assert_allclose(r.q, want[r.key], rtol=1e-15)
    ranks = pdf.groupby("key")["value"].rank()
    got = {(r.key, r.value): r.avg_rank for r in average_ranks(df, ["key"], "value", {"pos": F.col("label")}).collect()}
    assert all(got[k, v] == n for k, v, n in zip(pdf.key, pdf.value, ranks))
    top = top_rows(df, ["key"], "value", {"ten": F.lit(10), "tenth": F.ceil(F.col("group_size") / 10)}, F.col("label"), [F.col("label")])
    sizes = pdf.key.value_counts()
    found = top.groupBy("key", "list").agg(F.count("*").alias("n"), F.min("value").alias("low")).collect()
    assert len(found) == 4
    for r in found:
        k = 10 if r.list == "ten" else -(-sizes[r.key] // 10)
        assert r.n == k and r.low == pdf.value[pdf.key == r.key].nlargest(k).min()
