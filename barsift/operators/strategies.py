"""Rule strategies as columns of one windowed panel.

``with_primitives`` adds what the rules read, in a few passes over one partitioning; each rule
is then a plain projection. Unused primitives are pruned from the plan when only some rules run.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import both, clip, flag, over_eps
from ..functions.fixed import CARD_BARS, EPS, SELECTORS, STRATEGIES
from ..functions.windows import BLOCK_NO, back, blocked, history_keys, history_order, in_blocks, roll, seq, span
from .context import true_range, with_kdj

LAGS = (1, 2, 3, 5, 6, 9, 10, 15, 19, 20, 21, 25, 34, 35, 39, 40, 41)


def _ret(n: int, skip: int = 0) -> Column:
    """Close-to-close return over ``n`` bars ending ``skip`` bars ago."""
    now = F.col("close") if skip == 0 else F.col(f"c{skip}")
    return over_eps(now, F.col(f"c{skip + n}")) - 1.0


def _slope(w: int) -> Column:
    first = F.col(f"c{w - 1}")
    return (F.col("close") - first) / (F.abs(first) + EPS)


def close_location() -> Column:
    width = F.col("high") - F.col("low")
    return F.when(width <= EPS, F.lit(0.5)).otherwise(clip((F.col("close") - F.col("low")) / width))


def with_primitives(panel: DataFrame) -> DataFrame:
    """All inputs of the rules. Volume stands in for turnover unless the panel has turnover."""
    if "turnover" not in panel.columns:
        panel = panel.withColumn("turnover", F.col("volume"))
    if "kdj_k" in panel.columns:
        return _staged_primitives(panel)
    # The means and all windows share one sort.
    panel = blocked(panel)
    with in_blocks():
        return _staged_primitives(with_kdj(panel)).drop(BLOCK_NO)


def _staged_primitives(panel: DataFrame) -> DataFrame:
    for stage in _primitive_stages(history_keys(), history_order()):
        panel = panel.withColumns(stage)
    return panel


@lru_cache(maxsize=None)
def _primitive_stages(keys: tuple[str, ...], order: tuple[str, ...]) -> tuple[dict[str, Column], ...]:
    """Columns of each pass over histories of ``keys`` in an ``order``; a later pass reads the earlier ones."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    usable = both(*[x.isNotNull() for x in (o, h, lo, c, v, F.col("turnover"))])
    bar = {
        "cl": close_location(),
        "upper_wick": F.greatest(F.lit(0.0), h - F.greatest(o, c)) / (F.abs(o) + EPS),
        "lower_wick": F.greatest(F.lit(0.0), F.least(o, c) - lo) / (F.abs(o) + EPS),
        "hl_span": (h - lo) / (F.abs(o) + EPS),
        "kd": F.col("kdj_k") - F.col("kdj_d"),
        "_usable": usable.cast("int"),
    }
    raw = {f"c{n}": back("close", n) for n in LAGS}
    raw |= {
        "seq": seq(), "o1": back("open", 1), "tr": true_range(),
        "_usable_yet": F.sum("_usable").over(span(Window.unboundedPreceding, 0)),
        "vr_now": roll("volume", 5), "_vol16": roll("volume", 16),
        "vol_sum10": roll("volume", 10, "sum"), "vol_mean20": roll("volume", 20),
        "tm5": roll("turnover", 5), "tm10": roll("turnover", 10), "ts10": roll("turnover", 10, "pstd"), "_tm20": roll("turnover", 20),
        "_top5": roll("close", 5, "max"), "top20": roll("close", 20, "max"), "_bot20": roll("close", 20, "min"),
        "top10": roll("close", 10, "max"), "bot10": roll("close", 10, "min"),
        "hi10": roll("high", 10, "max"), "lo10": roll("low", 10, "min"),
        "mean20": roll("close", 20), "std20": roll("close", 20, "pstd"),
        "std5": roll("close", 5, "pstd"), "_std15": roll("close", 15, "pstd"),
        "cl_new": roll("cl", 5), "kd_2": back("kd", 2), "kd_4": back("kd", 4), "k_min5": roll("kdj_k", 5, "min"),
    }
    # A window that ends some bars ago is the value that its statistic had then.
    earlier = {
        "card_bars": F.col("_usable_yet") - F.coalesce(back("_usable_yet", CARD_BARS), F.lit(0)),
        "vr_base": back("_vol16", 5), "vr1_now": back("vr_now", 1), "vr1_base": back("_vol16", 6),
        "vr5_now": back("vr_now", 5), "vr5_base": back("_vol16", 10), "tm20_5": back("_tm20", 5),
        "top5_1": back("_top5", 1), "top20_1": back("top20", 1), "top20_2": back("top20", 2), "low20_1": back("_bot20", 1),
        "top40_1": F.greatest(back("top20", 1), back("top20", 21)),
        "top20_10": back("top20", 10), "bot20_10": back("_bot20", 10), "top20_21": back("top20", 21), "bot20_21": back("_bot20", 21),
        "base_close": back("_bot20", 15), "base_low": back("lo10", 5), "hi10_10": back("hi10", 10), "lo10_10": back("lo10", 10),
        "std15_5": back("_std15", 5), "cl_old": back("cl_new", 5),
    }
    c1 = F.col("c1")
    change = c - c1
    moves = {
        "r1": over_eps(c, c1) - 1.0,
        "up_vol": F.when(c > c1, v).when(c1.isNotNull(), F.lit(0.0)),
        "signed_vol": F.when(c1.isNotNull(), F.signum(change) * v),
        "gain": F.greatest(change, F.lit(0.0)),
        "loss": F.greatest(-change, F.lit(0.0)),
    }
    sums = earlier | {
        "r_1": back("r1", 1), "r_2": back("r1", 2), "r_7": back("r1", 7), "r_8": back("r1", 8),
        "r_9": back("r1", 9), "r_max5": roll("r1", 5, "max"),
        "r_up10": F.sum(flag(F.col("r1") > 0)).over(span(-9, 0)),
        "events": F.sum(flag(F.col("r1") >= 0.085)).over(span(-19, 0)),
        "event_close": F.last(F.when(F.col("r1") >= 0.085, c), ignorenulls=True).over(span(-19, 0)),
        "up_vol10": roll("up_vol", 10, "sum"), "obv_move": roll("signed_vol", 19, "sum"),
        "gain14": roll("gain", 14, "sum"), "loss14": roll("loss", 14, "sum"), "atr14": roll("tr", 14),
    }
    vr = over_eps(F.col("vr_now"), F.col("vr_base"))
    avg_gain, avg_loss = F.col("gain14") / 14, F.col("loss14") / 14
    ratios = {
        "vr": vr,
        "vr_1": over_eps(F.col("vr1_now"), F.col("vr1_base")),
        "vr_5": over_eps(F.col("vr5_now"), F.col("vr5_base")),
        "dph5": over_eps(c, F.col("top5_1")) - 1.0,
        "dph20": over_eps(c, F.col("top20_1")) - 1.0,
        "dph20_1": over_eps(c1, F.col("top20_2")) - 1.0,
        "dph40": over_eps(c, F.col("top40_1")) - 1.0,
        "range10": (F.col("top10") - F.col("bot10")) / (F.abs("bot10") + EPS),
        "range20_1": (F.col("top20_1") - F.col("low20_1")) / (F.abs("low20_1") + EPS),
        "range20_10": (F.col("top20_10") - F.col("bot20_10")) / (F.abs("bot20_10") + EPS),
        "range20_21": (F.col("top20_21") - F.col("bot20_21")) / (F.abs("bot20_21") + EPS),
        "dd20": over_eps(c, F.col("top20")) - 1.0,
        "dd20_1": over_eps(c1, F.col("top20_1")) - 1.0,
        "pos20_1": (c1 - F.col("low20_1")) / (F.col("top20_1") - F.col("low20_1") + EPS),
        "pvs10": over_eps(F.col("up_vol10"), F.col("vol_sum10")),
        "obv_slope": over_eps(F.col("obv_move"), F.col("vol_mean20")),
        "rsi14": F.when(avg_loss <= EPS, F.when(avg_gain > EPS, 100.0).otherwise(50.0)).otherwise(
            100.0 - 100.0 / (1.0 + avg_gain / avg_loss)),
        "atr_pct": over_eps(F.col("atr14"), c),
        "dkd3": F.col("kd") - F.col("kd_2"),
        "dkd5": F.col("kd") - F.col("kd_4"),
        "vol_up": clip((vr - 1.0) / 1.0),
        "turn_ratio": over_eps(F.col("tm5"), F.col("tm20_5")),
    }
    return bar, raw, moves, sums, ratios


def _parts(name: str) -> list[Column]:
    """Component columns of a rule, in the order of its weights."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    g = F.col
    cl, vr, kd = g("cl"), g("vr"), g("kd")
    near = [clip(g(x) / 0.08) for x in ("r_2", "r_1", "r1")]
    event_hold = F.when(g("events") > 0, clip((c / (g("event_close") + EPS) - 0.98) / 0.12)).otherwise(0.0)
    support = (g("base_low") - g("base_close")) / (F.abs("base_close") + EPS)
    gap = o / (g("c1") + EPS) - 1.0
    pullback = over_eps(c, g("c5")) - 1.0
    atr = g("atr_pct")
    q = g("turn_ratio")
    rules = {
        "leader_momentum": lambda: [
            (near[0] + near[1] + near[2]) / 3.0, cl, g("r_up10") / 10,
            clip(g("tm5") / 4.0), clip(vr / 2.0)],
        "first_board_breakout": lambda: [
            flag(g("r_max5") < 0.09), flag((g("dph20") >= 0.01) & (g("dph20_1") <= 0.0)), cl,
            flag((vr >= 1.2) & (vr <= 2.5))],
        "reversal_engulf": lambda: [
            clip(-_ret(4, 1) / 0.08), clip(-_ret(1, 1) / 0.04),
            clip(F.greatest(F.lit(0.0), c - o) / (F.greatest(F.lit(0.0), g("o1") - g("c1")) + EPS)),
            clip(g("dph5") / 0.03), clip(g("lower_wick") / 0.03), clip((vr - 1.0) / 0.5)],
        "washout_complete": lambda: [
            0.5 * clip((_ret(35) + 0.04) / 0.20) + 0.5 * clip((_slope(35) + 0.02) / 0.16),
            0.55 * clip(-_ret(4, 5) / 0.06) + 0.45 * clip((1.10 - g("vr_5")) / 0.60),
            clip(support / 0.05),
            0.5 * clip((kd + 4.0) / 18.0) + 0.5 * clip(g("dkd5") / 20.0),
            0.55 * cl + 0.45 * clip((_ret(3) + 0.01) / 0.07)],
        "accumulation_base": lambda: [
            clip((g("range20_10") - g("range10")) / (0.50 * g("range20_10") + EPS)),
            clip((g("pvs10") - 0.50) / 0.25),
            clip((0.20 - over_eps(g("ts10"), g("tm10"))) / 0.20),
            0.70 * clip((g("cl_new") - g("cl_old")) / 0.25) + 0.30 * cl],
        "platform_breakout": lambda: [
            flag(g("range20_1") <= 0.70 * g("range20_21")),
            flag((g("dph20") >= 0.01) & (g("dph40") >= 0.01)), g("vol_up"),
            clip((0.30 - _ret(20, 1)) / 0.30)],
        "main_wave_acceleration": lambda: [
            flag(both(_ret(5) >= 0.03, _ret(10) >= 0.05, _ret(20) >= 0.10)),
            flag(both(*[_slope(w) > 0.0 for w in (10, 20, 40)])),
            flag((g("hi10") > g("hi10_10")) & (g("lo10") > g("lo10_10"))),
            flag(((g("r_2") + g("r_1") + g("r1")) / 3.0 > (g("r_9") + g("r_8") + g("r_7")) / 3.0)
                 & (g("r1") > 0.0)),
            F.when(_ret(20) <= 0.20, F.lit(1.0)).otherwise(clip((0.40 - _ret(20)) / 0.20))],
        "oversold_rebound": lambda: [
            clip(-g("dd20_1") / 0.15), clip(1.0 - g("pos20_1")),
            0.55 * clip(-_ret(4, 1) / 0.05) + 0.45 * clip((1.10 - g("vr_1")) / 0.70),
            0.40 * clip((30.0 - g("k_min5")) / 20.0) + 0.35 * clip(g("dkd5") / 15.0) + 0.25 * clip(kd / 5.0),
            clip(g("lower_wick") / 0.06),
            0.55 * cl + 0.45 * clip(_ret(3) / 0.06)],
        "turnover_weak_to_strong": lambda: [
            clip(-_ret(20, 5) / 0.15), F.least(clip(q - 1.0), clip(_ret(5) / 0.10)), cl,
            clip(g("hl_span") / 0.12), g("vol_up")],
        "high_level_consensus": lambda: [
            flag((_ret(20, 1) >= 0.08) & (_ret(40, 1) >= 0.12)),
            flag(both(_ret(5, 1) >= -0.08, _ret(5, 1) <= 0.05, kd >= -8.0, g("dkd3") >= 0.0)),
            flag(both(_ret(3) >= 0.04, cl >= 0.75, vr >= 1.25)),
            flag(both(g("dph20") >= 0.02, g("upper_wick") <= 0.10, g("hl_span") <= 0.08))],
        "donchian_turtle": lambda: [
            clip((g("dph20") + 0.01) / 0.04), clip(_slope(20) / 0.12), g("vol_up"),
            F.when((atr >= 0.015) & (atr <= 0.08), F.lit(1.0)).otherwise(
                clip(F.when(atr < 0.015, atr / 0.015).otherwise((0.12 - atr) / 0.04)))],
        "bollinger_squeeze": lambda: [
            clip((0.12 - over_eps(g("std20"), g("mean20"))) / 0.06),
            clip((c - g("mean20")) / (2.0 * g("std20") + EPS) + 0.5),
            clip((g("std5") / (g("std15_5") + EPS) - 1.0) / 1.0), g("vol_up"), cl],
        "rsi_mean_reversion": lambda: [
            clip((45.0 - g("rsi14")) / 20.0), clip(-g("dd20") / 0.20),
            clip(0.65 * g("lower_wick") / 0.08 + 0.35 * cl), clip(g("dkd3") / 8.0), clip((3.0 - vr) / 1.5)],
        "gap_follow_through": lambda: [
            F.when(gap > 0, clip((gap - 0.005) / 0.055)).otherwise(0.0), cl, g("vol_up"),
            flag((c > g("c1")) & (lo >= g("c1") * 0.985)), clip(1.0 - g("upper_wick") / 0.12)],
        "pullback_retest": lambda: [
            clip((g("c5") / (g("c15") + EPS) - 1.0) / 0.12),
            F.when(pullback <= 0.02, clip((0.02 - pullback) / 0.10)).otherwise(0.0),
            clip((g("dph20") + 0.08) / 0.06), clip((1.5 - vr) / 0.75), cl],
        "obv_volume_price": lambda: [
            clip(_slope(20) / 0.12), clip(g("obv_slope") / 2.0), clip((g("pvs10") - 0.35) / 0.45),
            g("vol_up"), cl],
        "turnover_regime_switch": lambda: [
            F.least(clip((q - 1.0) / 1.0), clip(_ret(5) / 0.10)),
            F.least(clip(-_ret(3) / 0.08), clip((1.5 - q) / 1.0)), clip(g("dkd3") / 8.0),
            clip(F.abs(q - 1.0) / 0.75)],
        "relative_strength_rank": lambda: [
            clip(_ret(5) / 0.12), clip(_ret(20) / 0.25), clip(_ret(40) / 0.50),
            clip((_slope(20) + _slope(40)) / 2.0 / 0.15), cl],
        "atr_trend_follow": lambda: [
            clip((g("dph20") + 0.02) / 0.05), clip(_slope(20) / 0.15),
            F.when(atr < 0.02, clip((atr - 0.01) / 0.01)).otherwise(clip((0.12 - atr) / 0.04)), cl,
            clip((c - g("lo10")) / (1.5 * g("atr14") + EPS))],
        "limit_up_retest": lambda: [
            clip(F.least(g("events"), F.lit(2.0)) / 2.0), event_hold, clip(g("r_max5") / 0.08), g("vol_up"),
            0.65 * cl + 0.35 * clip(1.0 - g("upper_wick") / 0.12)],
    }
    return rules[name]()


def components(name: str) -> dict[str, Column]:
    """Named components of a base rule over a panel with primitives."""
    return dict(zip(STRATEGIES[name][1], _parts(name), strict=True))


@lru_cache(maxsize=None)
def score(name: str) -> Column:
    """Weighted score of a base rule; unknown unless the last 60 bars are complete."""
    weights = STRATEGIES[name][1].values()
    total = reduce(lambda a, b: a + b, [F.lit(w) * p for w, p in zip(weights, _parts(name), strict=True)])
    return F.when(F.col("card_bars") == CARD_BARS, total)


def rule(name: str) -> tuple[str, float]:
    """Base rule and cutoff of any strategy."""
    if name in STRATEGIES:
        return name, STRATEGIES[name][0]
    return SELECTORS[name]


def all_names() -> list[str]:
    return [*STRATEGIES, *SELECTORS]


def registry(spark: SparkSession) -> DataFrame:
    """One row per strategy: id, base, cutoff, kind and how its cutoff compares with the base."""
    rows = []
    for n in all_names():
        base, cut = rule(n)
        at = STRATEGIES[base][0]
        kind = "base" if n == base else "selector"
        versus = "same" if n == base else "subset" if cut > at else "superset"
        rows.append((n, base, float(cut), kind, versus, len(STRATEGIES[base][1])))
    return spark.createDataFrame(
        rows, "strategy_id string, base string, threshold double, kind string, versus_base string, components int")


class Strategies:
    """Extensible set of rules: a rule is a function of the windowed panel returning a score column."""

    def __init__(self, names: list[str] | None = None):
        self._rules = {}
        for n in all_names() if names is None else names:
            base, cut = rule(n)
            self._rules[n] = (base, lambda b=base: score(b), cut)

    def add(self, name: str, score_of, threshold: float) -> "Strategies":
        if not name or name in self._rules:
            raise ValueError(f"strategy name missing or taken: {name!r}")
        if not callable(score_of) or not 0.0 <= threshold <= 1.0:
            raise ValueError("a strategy needs a score function and a cutoff in [0, 1]")
        self._rules[name] = (name, score_of, threshold)
        return self

    def scores(self) -> dict[str, Column]:
        """One score column per distinct rule; selectors share their base rule's score."""
        return {f"_score_{key}": fn() for key, fn, _ in self._rules.values()}

    def cutoffs(self) -> list[tuple[str, str, float]]:
        """Strategy, its score column and its cutoff."""
        return [(n, f"_score_{key}", float(cut)) for n, (key, _, cut) in self._rules.items()]
