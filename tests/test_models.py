"""What the registered model queries ask of the library."""

from tickloom.operators import models
from tickloom.plans import model_queries
from tickloom.plans.catalog import QUERIES


class Asked(Exception):
    pass


def asked(monkeypatch, name):
    """(kind, rounds, calibrate) that a query hands to walk_forward_scores."""
    monkeypatch.setattr(model_queries, "assigned", lambda spark, sf: (None, [1]))

    def scores(assigned, fold_ids, names, kind, rounds=300, calibrate=True):
        raise Asked(kind, rounds, calibrate)

    monkeypatch.setattr(models, "walk_forward_scores", scores)
    try:
        QUERIES[name](None, "")
    except Asked as e:
        return e.args


def test_boosted_queries_fit_all_rounds(spark, monkeypatch):
    for name in ("model_boosted_fixed_weight", "model_boosted_auto_weight"):
        kind, rounds, _ = asked(monkeypatch, name)
        assert models.make_model(kind, 0, rounds).getMaxIter() == 300


def test_all_kinds_and_the_ledger_are_calibrated(monkeypatch):
    names = ("model_random_forest", "model_boosted_fixed_weight", "model_boosted_auto_weight", "model_calibrated_logistic", "walk_forward_ledger")
    assert all(asked(monkeypatch, n)[2] for n in names)
    assert not asked(monkeypatch, "model_logistic")[2]


# --- calibrated models ---------------------------------------------------------------


def labelled(spark, n=240, seed=3):
    import datetime as dt
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.gauss(3, 2), rng.gauss(-1, 0.1)
        rows.append((rng.choice("AB"), dt.date(2020, 1, 1) + dt.timedelta(days=i), x, y, int(rng.random() < 1 / (1 + 2.7 ** (3 - x)))))
    return spark.createDataFrame(rows, "symbol string, bar_date date, x double, y double, label int")


def test_saved_model_scores_tables_and_streams_alike(spark, tmp_path):
    from pyspark.sql import functions as F

    from tickloom.operators.calibrated import CalibratedModel
    from tickloom.streaming.runs import run_to_table

    rows = labelled(spark)
    for kind in ("logistic", "random_forest", "boosted_b"):
        path = str(tmp_path / kind)
        made = models.fit_final(rows, ["x", "y"], kind, path, rounds=3)
        loaded = CalibratedModel.load(path)
        assert (loaded.kind, loaded.names, loaded.means, loaded.deviations, loaded.sigmoids, len(loaded.bases)) == ("%s" % kind, ["x", "y"], made.means, made.deviations, made.sigmoids, 3)
        first = {(r.symbol, r.bar_date): r.score for r in models.score_batch(made, rows).collect()}
        again = {(r.symbol, r.bar_date): r.score for r in models.score_batch(loaded, rows).collect()}
        assert first == again and all(0 < s < 1 for s in first.values())
    source = str(tmp_path / "rows")
    rows.write.parquet(source)
    streamed = run_to_table(models.score_batch(loaded, spark.readStream.schema(rows.schema).parquet(source)), spark)
    assert {(r.symbol, r.bar_date): r.score for r in streamed.collect()} == first
    assert streamed.columns == [*rows.columns, "score"]
    # a stage like any other
    from pyspark.ml import PipelineModel

    PipelineModel([loaded]).write().overwrite().save(str(tmp_path / "pipeline"))
    piped = PipelineModel.load(str(tmp_path / "pipeline")).transform(rows)
    assert piped.agg(F.round(F.sum("score"), 9)).first() == models.score_batch(loaded, rows).agg(F.round(F.sum("score"), 9)).first()


def test_final_model_equals_the_walk_forward_one(spark):
    from pyspark.sql import functions as F

    rows = labelled(spark)
    split = F.when(F.dayofyear("bar_date") <= 160, "train").otherwise("test")
    folds = rows.withColumn("fold_id", F.lit(1)).withColumn("split", split)
    scored = models.walk_forward_scores(folds, [1], ["x", "y"], "logistic")
    final = models.fit_final(folds.filter("split = 'train'"), ["x", "y"], "logistic")
    both = scored.join(models.score_batch(final, rows).withColumnRenamed("score", "own"), ["symbol", "bar_date"])
    assert both.count() == 240 and both.filter("abs(score - own) > 1e-12").count() == 0
    # the scaler knows train rows only
    assert abs(final.means[0] - folds.filter("split = 'train'").agg(F.avg("x")).first()[0]) < 1e-12
    assert set(scored.columns) == {"symbol", "bar_date", "label", "fold_id", "split", "score", "model"}


def test_coefficients_are_means_over_the_base_models(spark):
    rows = labelled(spark)
    model = models.fit_final(rows, ["x", "y"], "logistic")
    table = {r.feature: r.coefficient for r in models.coefficients({1: model}, spark).collect()}
    for i, n in enumerate(["x", "y"]):
        assert abs(table[n] - sum(b.coefficients[i] for b in model.bases) / 3) < 1e-12
    assert table["x"] > 0 and models.fit_final(rows, ["x"], "random_forest").coefficients() == {}


def test_side_by_side_keeps_order_and_raises(spark):
    import pytest

    from tickloom.functions.parallel import side_by_side

    assert side_by_side(spark, [lambda i=i: spark.range(i).count() for i in range(12)], workers=4) == list(range(12))
    assert side_by_side(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1, lambda: 1 // 0])


def test_the_ledger_sizes_trades_by_unscaled_volatility(spark, monkeypatch):
    import datetime as dt
    import random

    rng = random.Random(5)
    rows = []
    for symbol in "AB":
        for i in range(4 * 53):
            x = rng.gauss(0, 1)
            rows.append((symbol, dt.date(2020, 1, 1) + dt.timedelta(days=7 * i), 100.0 + 20 * (i % 2), int(x + rng.gauss(0, 0.3) > 0), x, 0.01 + 0.001 * (i % 3)))
    built = spark.createDataFrame(rows, "symbol string, bar_date date, close double, label int, x double, Volatility_20d double")
    monkeypatch.setattr(model_queries, "dataset", lambda spark, sf: built)
    monkeypatch.setattr(model_queries, "NAMES", ["x", "Volatility_20d"])
    got = {r.symbol: r for r in QUERIES["walk_forward_ledger"](spark, "").collect()}
    assert sorted(got) == ["A", "B"]
    for r in got.values():
        # Closes move by 16 to 20 % each week, far above volatility and costs: every trade wins.
        assert r.model == "logistic" and r.fold_id == 1 and 10 < r.total_trades <= 52
        assert r.win_rate == 1.0 and r.total_return > 0 and r.max_drawdown == 0


def test_models_score_in_a_session_that_has_observed_a_table(spark):
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    rows = labelled(spark)
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 240
    folds = rows.withColumn("fold_id", F.lit(1)).withColumn("split", F.when(F.dayofyear("bar_date") <= 160, "train").otherwise("test"))
    for kind, calibrate in (("logistic", True), ("logistic", False), ("random_forest", True)):
        scored = models.walk_forward_scores(folds, [1], ["x", "y"], kind, calibrate=calibrate)
        assert scored.filter("score BETWEEN 0 AND 1").count() == 240


def test_parts_of_a_fold_are_fitted_on_rows_without_their_plan(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tickloom.operators import calibrated

    plans = []
    fit = calibrated.fit_base

    def seen(train, *rest):
        plans.append((train._jdf.queryExecution().executedPlan().toString(), train.rdd.getNumPartitions(), train.count()))
        return fit(train, *rest)

    monkeypatch.setattr(calibrated, "fit_base", seen)
    model = models.fit_final(labelled(spark).withColumn("x", F.col("x") * 2), ["x", "y"], "boosted_a", rounds=2)
    assert [n for n, _ in model.trees()] == [2, 2, 2] and len(plans) == 3
    for plan, partitions, rows in plans:
        assert "Scan ExistingRDD" in plan and "InMemoryTableScan" not in plan and "FileScan" not in plan
        assert partitions == 1
    assert sum(rows for _, _, rows in plans) == 2 * 240  # each row is left out of one part's fit
