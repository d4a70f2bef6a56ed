"""Physical plans: pushdown, pruning and shared exchanges."""

import re

from pyspark.sql import functions as F

from tickloom.functions.lineage import cut
from tickloom.operators import evaluate, frame
from tickloom.plans import views
from tickloom.sources.bars import load_bars, write_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bar_filters_reach_the_scan(spark, sf, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    path = str(tmp_path / "bars")
    write_table(views.bars_daily(spark, sf), path)
    text = plan(load_bars(spark, path, ["AF", "RF"], "1996-01-01", "1997-12-31").select("symbol", "close"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "In(symbol" in pushed and "GreaterThanOrEqual(bar_date" in pushed and "LessThanOrEqual(bar_date" in pushed
    assert re.search(r"ReadSchema: struct<symbol:string,bar_date:date,close:double>", text)


def test_trades_read_only_needed_columns(spark, sf):
    text = plan(views.price_events(spark, sf).groupBy("symbol").agg(F.max("price")))
    assert "user_id" not in text and "props" not in text


def test_feature_groups_share_one_layout(spark, sf):
    """Every window of the frame runs on one exchange by (symbol, block)."""
    bars = views.bars_daily(spark, sf)
    groups = [g for g in frame.ALL_GROUPS if g not in ("regime_persistence",)]
    text = plan(frame.build_features(bars, groups))
    assert len(re.findall(r"Exchange hashpartitioning\(symbol#\d+, block#", text)) == 1
    assert not re.search(r"Exchange SinglePartition", text)


def test_rank_metrics_never_gather_a_group(spark, sf):
    scored = cut(views.scored_periods(spark, sf).select("model", "label", "score", "pred"))
    text = plan(evaluate.ranking(scored, ["model"]))
    for spec in re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", text):
        assert "_bucket" in spec
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
