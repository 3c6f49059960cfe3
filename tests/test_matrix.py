"""Cross-section and feature matrix: sessions are dealt once, wide rows never, and no row is left out."""

import pandas as pd
from panels import to_spark, wavy
from pyspark.sql import functions as F

from barsift import plans
from barsift.functions.fixed import FEATURE_GROUPS
from barsift.operators import matrix
from barsift.session import staged


def _panel(spark):
    return to_spark(spark, wavy("000001", 90, 1), wavy("000002", 75, 2), wavy("000003", 3, 3))


def _same(a, b):
    a, b = (t.toPandas().sort_values(["code", "date"]).reset_index(drop=True) for t in (a, b))
    pd.testing.assert_frame_equal(a, b)


def test_sessions_are_dealt_once(spark):
    price = staged(matrix.with_price_features(_panel(spark)))
    whole, split = matrix.cross_section(price), matrix.cross_section(price, split_rows=1)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    # Rows without any known value stay, in both ways.
    assert whole.count() == split.count() == 168
    _same(whole, split)


def test_matrix_is_the_features_side_by_side(spark):
    panel = _panel(spark)
    got = matrix.feature_matrix(panel)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert all("dist_ma250" not in line for line in plan.splitlines() if "Exchange" in line) and got.count() == 168
    names = ["code", "date", *FEATURE_GROUPS["market"], *FEATURE_GROUPS["cross"], *FEATURE_GROUPS["momentum"]]
    price = staged(matrix.with_price_features(panel))
    _same(got.select(names), matrix.with_cross_section(matrix.with_market_features(price), source=price).select(names))
    strided = matrix.feature_matrix(panel, stride=5)
    assert [r.row_no for r in strided.select("row_no").orderBy("row_no").collect()] == list(range(0, 168, 5))


def test_the_matrix_query_keeps_every_bar(spark):
    assert "row_no" not in plans.checks()["m14_feature_matrix"]
    folder = "/root/testdata/sf0.001"
    bars = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_suppkey", F.date_trunc("week", "l_shipdate")).distinct().count()
    assert plans.load()["m14_feature_matrix"](spark, folder).count() == bars
