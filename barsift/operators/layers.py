"""Low-zone layers: causal features and a nested tier from base to trend turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import both, guarded
from ..functions.fixed import EPS
from ..functions.windows import back, blocked, by_code, ewm, in_blocks, roll
from .context import true_range

LAYER_FEATURES = (
    "ret1", "ret3", "ret5", "ret10", "ret20", "ret60", "low_gap60", "close_gap60", "drawdown60",
    "close_position", "lower_wick", "body_ratio", "range_pct", "range_contract5", "range_contract20",
    "atr_pct", "vol_ratio20", "vol_contract5", "vol_contract10", "vol_expand", "down_vol_ratio5",
    "obv_slope10", "ema5_gap", "ema10_gap", "ema20_gap", "ema60_gap", "ema20_slope10", "ema60_slope20",
    "rsi2", "rsi14", "adx14", "di_spread")


def with_ema(df: DataFrame, source: str = "close", spans: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    """Exponential means by span, known once a full span has passed."""
    return ewm(df, {f"ema{w}": (source, 2.0 / (w + 1), None, w) for w in spans})


def with_adx(df: DataFrame, window: int = 14) -> DataFrame:
    """Wilder's directional index ``adx14`` and the spread of the two directional lines."""
    up = F.col("high") - back("high", 1)
    down = back("low", 1) - F.col("low")
    df = df.withColumns({"_up": up, "_down": down, "_dtr": true_range()})
    rises = (F.col("_up") > F.col("_down")) & (F.col("_up") > 0)
    falls = (F.col("_down") > F.col("_up")) & (F.col("_down") > 0)
    df = df.withColumns({
        "_pdm": F.when(rises, F.col("_up")).otherwise(0.0),
        "_ndm": F.when(falls, F.col("_down")).otherwise(0.0)})
    a = 1.0 / window
    df = ewm(df, {"_atr": ("_dtr", a, None, window), "_ps": ("_pdm", a, None, window),
                  "_ns": ("_ndm", a, None, window)})
    rng = F.when(F.col("_atr") != 0, F.col("_atr"))
    df = df.withColumns({"_pdi": 100.0 * F.col("_ps") / rng, "_ndi": 100.0 * F.col("_ns") / rng})
    total = F.col("_pdi") + F.col("_ndi")
    df = df.withColumns({
        "di_spread": F.col("_pdi") - F.col("_ndi"),
        "_dx": 100.0 * F.abs(F.col("_pdi") - F.col("_ndi")) / F.when(total != 0, total)})
    df = ewm(df, {"adx14": ("_dx", a, None, window)}, gaps=True)
    return df.drop("_up", "_down", "_dtr", "_pdm", "_ndm", "_atr", "_ps", "_ns", "_pdi", "_ndi", "_dx")


def rsi_simple(gain: str, loss: str, window: int) -> Column:
    """RSI from simple means; unknown when the window holds no loss."""
    rs = guarded(roll(gain, window, least=window), roll(loss, window, least=window))
    return 100.0 - 100.0 / (1.0 + rs)


def with_layers(panel: DataFrame) -> DataFrame:
    """Panel with the layer features, the stabilization flag, ``recall_tier`` 0..5 and the year.

    Rows get wide, so the means and all windows share one sort of narrow rows.
    """
    panel = blocked(panel)
    with in_blocks():
        return _layers(panel)


def _layers(panel: DataFrame) -> DataFrame:
    df = with_adx(with_ema(panel))
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    df = df.withColumns({"_c1": back("close", 1), "_day": F.greatest(h - lo, F.lit(1e-12))})
    prior, day = F.col("_c1"), F.col("_day")
    known = prior.isNotNull()
    change = c - prior
    df = df.withColumns({
        "close_position": (c - lo) / day,
        "lower_wick": (F.least(o, c) - lo) / day,
        "body_ratio": F.abs(c - o) / day,
        "range_pct": day / F.greatest(c, F.lit(EPS)),
        "_tr": F.when(known, true_range()),
        "_signed": F.coalesce(F.signum(change), F.lit(0.0)) * v,
        "_dn": F.when(c < prior, v), "_up": F.when(c >= prior, v),
        "_gain": F.when(known, F.greatest(change, F.lit(0.0))),
        "_loss": F.when(known, F.greatest(-change, F.lit(0.0)))})
    running = by_code().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({
        **{f"_p{n}": back("close", n) for n in (3, 5, 10, 20, 60)},
        "_rl": roll("low", 60, "min", 60), "_rh": roll("high", 60, "max", 60),
        **{f"_v{w}": roll("volume", w, least=w) for w in (5, 10, 20)},
        **{f"_r{w}": roll("range_pct", w, least=w) for w in (5, 20, 60)},
        "_atr14": roll("_tr", 14, least=14), "_obv": F.sum("_signed").over(running),
        "_dn5": roll("_dn", 5, least=3), "_up5": roll("_up", 5, least=3),
        "rsi2": rsi_simple("_gain", "_loss", 2), "rsi14": rsi_simple("_gain", "_loss", 14),
        "_e20_10": back("ema20", 10), "_e60_20": back("ema60", 20)})
    df = df.withColumn("_obv10", back("_obv", 10))
    g = F.col
    df = df.withColumns({
        "ret1": guarded(c, prior) - 1.0,
        **{f"ret{n}": guarded(c, g(f"_p{n}")) - 1.0 for n in (3, 5, 10, 20, 60)},
        "low_gap60": guarded(lo, g("_rl")) - 1.0, "close_gap60": guarded(c, g("_rl")) - 1.0,
        "drawdown60": guarded(c, g("_rh")) - 1.0,
        "range_contract5": guarded(g("_r5"), g("_r20")), "range_contract20": guarded(g("_r20"), g("_r60")),
        "atr_pct": guarded(g("_atr14"), c), "vol_ratio20": guarded(v, g("_v20")),
        "vol_contract5": guarded(g("_v5"), g("_v20")), "vol_contract10": guarded(g("_v10"), g("_v20")),
        "vol_expand": guarded(v, g("_v5")), "down_vol_ratio5": guarded(g("_dn5"), g("_up5")),
        "obv_slope10": (g("_obv") - g("_obv10")) / F.greatest(F.abs("_obv10"), F.lit(1.0)),
        **{f"ema{w}_gap": guarded(c, g(f"ema{w}")) - 1.0 for w in (5, 10, 20, 60)},
        "ema20_slope10": guarded(g("ema20"), g("_e20_10")) - 1.0,
        "ema60_slope20": guarded(g("ema60"), g("_e60_20")) - 1.0})
    base = both(g("low_gap60") <= 0.15, g("close_gap60") <= 0.28, g("drawdown60") <= -0.15,
                g("close_position") >= 0.30)
    steady = (g("ret5") > -0.12) & (g("_r5") <= g("_r20") * 1.25)
    turns = both(c >= o, c > prior, g("lower_wick") >= 0.12, g("close_position") >= 0.45)
    volume = (g("vol_contract5") <= 1.35) & (g("vol_expand") >= 0.85)
    trend = (g("ema20_slope10") >= -0.03) & (c >= g("ema5"))
    layers, met = [base, steady, turns, volume, trend], F.lit(True)
    tier = F.lit(0)
    for k, layer in enumerate(layers, 1):
        met = met & F.coalesce(layer, F.lit(False))
        tier = tier + met.cast("int")
    df = df.withColumns({
        "stabilization": F.coalesce(steady, F.lit(False)).cast("int"), "recall_tier": tier,
        "year": F.year("date")})
    return df.select("code", "date", "open", "high", "low", "close", "volume", *LAYER_FEATURES,
                     "stabilization", "recall_tier", "year")
