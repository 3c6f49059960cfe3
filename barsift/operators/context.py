"""Causal per-code indicators: KDJ, rolling context, true range, RSI, volume balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import over_eps
from ..functions.fixed import EPS
from ..functions.windows import back, ewm, roll, span

CONTEXT_WINDOWS = (5, 10, 20, 60, 120, 250)


def with_kdj(panel: DataFrame, bars: int = 9, k_alpha: float = 1 / 3, d_alpha: float = 1 / 3) -> DataFrame:
    """Stochastic K, D and J. A flat window counts as 50; the state never restarts inside a code."""
    low, high = roll("low", bars, "min"), roll("high", bars, "max")
    df = panel.withColumns({"_lo": low, "_span": high - low})
    df = df.withColumn("_rsv", F.when(
        F.col("_span") > EPS, (F.col("close") - F.col("_lo")) / F.col("_span") * 100.0).otherwise(50.0))
    df = ewm(df, {"kdj_k": ("_rsv", k_alpha, 50.0, 1)})
    df = ewm(df, {"kdj_d": ("kdj_k", d_alpha, 50.0, 1)})
    return df.withColumn("kdj_j", 3.0 * F.col("kdj_k") - 2.0 * F.col("kdj_d")).drop("_lo", "_span", "_rsv")


def with_kdj_first_value(panel: DataFrame, bars: int = 9, alpha: float = 1 / 3) -> DataFrame:
    """KDJ variant that needs a full window and starts each mean at its first known value."""
    df = panel.withColumns({
        "_lo": roll("low", bars, "min", least=bars), "_hi": roll("high", bars, "max", least=bars)})
    df = df.withColumn("_rsv", 100.0 * (F.col("close") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + EPS))
    df = ewm(df, {"kdj_k": ("_rsv", alpha, None, 1)}, gaps=True)
    df = ewm(df, {"kdj_d": ("kdj_k", alpha, None, 1)}, gaps=True)
    df = df.withColumns({
        "kdj_j": 3.0 * F.col("kdj_k") - 2.0 * F.col("kdj_d"),
        "kdj_k_minus_d": F.col("kdj_k") - F.col("kdj_d"),
        "kdj_k_chg5": F.col("kdj_k") - back("kdj_k", 5)})
    return df.drop("_lo", "_hi", "_rsv")


def true_range() -> Column:
    """Largest of the bar's range and its distances to the previous close; skips unknown parts."""
    prev = back("close", 1)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def with_context(panel: DataFrame) -> DataFrame:
    """Returns, extremes, means, position, drawdown, volume ratios and ATR over six windows."""
    df = panel.withColumn("_tr", true_range())
    cols = {}
    for w in CONTEXT_WINDOWS:
        past = back("close", w)
        cols[f"ret_{w}"] = F.when(past != 0, F.col("close") / past - 1.0)
        cols[f"high_{w}"] = roll("high", w, "max")
        cols[f"low_{w}"] = roll("low", w, "min")
        cols[f"ma_{w}"] = roll("close", w)
        cols[f"vol_ma_{w}"] = roll("volume", w)
    cols["_prior_vol"] = F.avg("volume").over(span(-20, -5))
    cols["atr_14"] = roll("_tr", 14)
    df = df.withColumns(cols)
    more = {}
    for w in (60, 120, 250):
        width = F.col(f"high_{w}") - F.col(f"low_{w}")
        more[f"pos_{w}"] = F.when(
            width > EPS, (F.col("close") - F.col(f"low_{w}")) / width).otherwise(0.5)
    for w in (120, 250):
        more[f"dd_{w}"] = over_eps(F.col("close"), F.col(f"high_{w}")) - 1.0
    more["vol_ratio_5_20"] = over_eps(F.col("vol_ma_5"), F.col("vol_ma_20"))
    # The five recent bars against the sixteen before them: the windows do not overlap.
    more["volume_ratio"] = over_eps(F.col("vol_ma_5"), F.col("_prior_vol"))
    return df.withColumns(more).drop("_tr", "_prior_vol")


def prepared(panel: DataFrame) -> DataFrame:
    """KDJ, context and the turnover stand-in (traded volume, marked as such)."""
    return with_context(with_kdj(panel)).withColumns({
        "turnover": F.col("volume"), "turnover_is_proxy": F.lit(True)})
