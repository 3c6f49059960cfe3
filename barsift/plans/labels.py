"""Queries on panels, grids and forward outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6, wilson
from ..functions.fixed import REGIMES
from ..operators.grid import scan_grid
from ..operators.outcomes import forward_outcomes
from ..sources.tables import bars
from . import sqltext as q
from .registry import query


def labelled(spark, folder, regime: str, panel: DataFrame | None = None) -> DataFrame:
    h, ret, floor = REGIMES[regime]
    panel = bars(spark, folder) if panel is None else panel
    return forward_outcomes(panel, h, target_return=ret, floor_ratio=floor)


def _label_report(df: DataFrame) -> DataFrame:
    return df.select(
        "code", "date", "entry_open", F.col("future_bars").cast("bigint").alias("future_bars"),
        r6(F.col("forward_max_return")).alias("forward_max_return"),
        r6(F.col("forward_min_return")).alias("forward_min_return"),
        F.col("bars_to_target").cast("bigint").alias("bars_to_target"),
        "label_bull", "label_strict_low", "label_joint", "label_resolved")


def _label_sql(name: str) -> str:
    return f"""select code, date, entry_open, future_bars, {q.r6('forward_max_return')} forward_max_return,
  {q.r6('forward_min_return')} forward_min_return, bars_to_target, label_bull, label_strict_low,
  case when label_bull is not null then least(label_bull,label_strict_low) end label_joint,
  label_resolved from {name}"""


@query("l01_forward_outcomes", q.with_(q.BARS, q.SEQ, q.label_cte("webpro")) + _label_sql("lab_webpro"))
def _l01(spark, folder):
    return _label_report(labelled(spark, folder, "webpro"))


#: The long horizon with a target that prices of these tables can reach.
LONG = (504, 0.30, 0.80)


@query("l01_forward_outcomes_504", q.with_(q.bars_cte("day"), q.SEQ, q.label_cte("low504", spec=LONG)) + _label_sql("lab_low504"))
def _l01_504(spark, folder):
    h, ret, floor = LONG
    return _label_report(forward_outcomes(bars(spark, folder, "day"), h, target_return=ret, floor_ratio=floor))


_BASE = """select count(*) evaluated_points, sum(label_bull)::bigint bull,
  sum(least(label_bull,label_strict_low))::bigint joint, {rate} bull_rate, {lo} wilson_low, {hi} wilson_high,
  min(date) date_min, max(date) date_max from lab_webpro where label_resolved and seq>=60 and seq%5=0""".format(
    rate=q.r6("avg(label_bull)"), lo=q.r6(q.wilson_sql("sum(label_bull)", "count(*)")[0]),
    hi=q.r6(q.wilson_sql("sum(label_bull)", "count(*)")[1]))


@query("l07_base_rate_wilson", q.with_(q.BARS, q.SEQ, q.label_cte("webpro")) + _BASE)
def _l07(spark, folder):
    grid = scan_grid(labelled(spark, folder, "webpro")).filter("label_resolved")
    got = grid.agg(
        F.count(F.lit(1)).alias("evaluated_points"), F.sum("label_bull").alias("bull"),
        F.sum("label_joint").alias("joint"), F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    low, high = wilson(F.col("bull"), F.col("evaluated_points"))
    return got.select(
        "*", r6(F.col("bull") / F.col("evaluated_points")).alias("bull_rate"),
        r6(low).alias("wilson_low"), r6(high).alias("wilson_high"))
