"""Queries on the rule strategies, the scan and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..functions.fixed import REGIMES, SELECTORS, STRATEGIES
from ..operators import scan, scoring
from ..operators.grid import scan_grid
from ..session import staged
from ..operators.outcomes import long_outcomes, outcomes_by_regime
from ..operators.strategies import all_names, registry, rule, score
from ..sources.tables import bars
from . import rulesql as rs
from . import sqltext as q
from .registry import query


def _strategy_query(name: str, key: str) -> None:
    base, cut = rule(name)
    sql = q.with_(rs.PRIMS) + (
        f"select code, date, {q.r6('sc')} score, (sc>={cut}::double)::int prediction "
        f"from (select code, date, {rs.score_sql(base)} sc from p)")

    def run(spark, folder) -> DataFrame:
        rows = scan.grid_rows(bars(spark, folder)).select("code", "date", score(base).alias("_s"))
        return rows.select("code", "date", r6(F.col("_s")).alias("score"),
                           (F.col("_s") >= cut).cast("int").alias("prediction"))

    query(key, sql)(run)


for _i, _n in enumerate([*STRATEGIES, *SELECTORS], 1):
    _strategy_query(_n, f"b{_i:02d}_{_n}")


def _columns_query(key: str, pairs: list[tuple[str, object, str]]) -> None:
    """Primitive columns on the grid beside their SQL."""
    sql = q.with_(rs.PRIMS) + "select code, date, " + ", ".join(
        f"{q.r6(x)} {n}" for n, _, x in pairs) + " from p"

    def run(spark, folder) -> DataFrame:
        rows = scan.grid_rows(bars(spark, folder))
        return rows.select("code", "date", *[r6(c() if callable(c) else F.col(c)).alias(n) for n, c, _ in pairs])

    query(key, sql)(run)


_columns_query("k01_returns", [(f"ret_{n}", lambda n=n: F.col("close") / (F.col(f"c{n}") + 1e-12) - 1, rs.ret(n))
                               for n in (1, 3, 5, 10, 20, 40)])
_columns_query("k02_means", [("volume_mean5", "tm5", "v5"), ("volume_mean10", "tm10", "vm10"),
                             ("volume_mean20_prior", "tm20_5", "vm20_5"), ("close_mean20", "mean20", "a20")])
_columns_query("k03_population_std", [("std20", "std20", "s20"), ("std5", "std5", "s5"),
                                      ("std15_prior", "std15_5", "s15"), ("turnover_std10", "ts10", "vsd10")])
_columns_query("k04_slopes", [
    (f"slope_{w}", lambda w=w: (F.col("close") - F.col(f"c{w - 1}")) / (F.abs(f"c{w - 1}") + 1e-12), rs.slope(w))
    for w in (10, 20, 35, 40)])
_columns_query("k05_close_location", [("close_location", "cl", "cl")])
_columns_query("k06_wicks", [("upper_wick", "upper_wick", "uw"), ("lower_wick", "lower_wick", "lw"),
                             ("high_low_span", "hl_span", "hls")])
_columns_query("k07_volume_ratio", [("volume_ratio", "vr", "vr"), ("volume_ratio_1", "vr_1", "vr1"),
                                    ("volume_ratio_5", "vr_5", "vr5")])
_columns_query("k08_average_true_range", [("atr14", "atr14", "atr"), ("atr_pct", "atr_pct", "ap")])
_columns_query("k09_relative_strength_index", [("rsi14", "rsi14", "rsi")])
_columns_query("k10_obv_slope", [("obv_slope", "obv_slope", "os")])
_columns_query("k11_kdj_turn", [("kdj_turn", "kd", "kd"), ("cross_change3", "dkd3", "dk3"),
                                ("cross_change5", "dkd5", "dk5")])
_columns_query("k12_range_position", [("range10", "range10", "g10"), ("range20", "range20_1", "g20b"),
                                      ("position20", "pos20_1", "(c1-n20p)/(m20p-n20p+1e-12)"),
                                      ("drawdown20", "dd20", "close/(m20+1e-12)-1")])
_columns_query("k13_prior_high_distance", [("dist5", "dph5", "p5"), ("dist20", "dph20", "p20"), ("dist40", "dph40", "p40")])
_columns_query("k14_recent_returns", [("return_max5", "r_max5", "rm5"), ("positive_share10", lambda: F.col("r_up10") / 10, "ru10/10e0"),
                                      ("events20", lambda: F.col("events").cast("double"), "ev")])
_columns_query("k15_positive_volume_share", [("positive_volume_share", "pvs10", "pv")])


@query("k16_incomplete_cards", q.with_(q.BARS, q.SEQ) + """select seq>=59 full_card, seq>=59 scored, count(*) bars
  from s group by all""")
def _k16(spark, folder):
    rows = scan.with_primitives(bars(spark, folder)).select(
        (F.col("card_bars") == 60).alias("full_card"), score("donchian_turtle").isNotNull().alias("scored"))
    return rows.groupBy("full_card", "scored").agg(F.count(F.lit(1)).alias("bars"))


# Regimes of the weekly panel: its prices stay within [20, 30.5], so the 60-bar target is lower.
PANEL_REGIMES = {"webpro": REGIMES["webpro"], "low60": (60, 0.45, 0.80), "low504": REGIMES["low504"]}

_LABELS = ("label_bull", "label_strict_low", "label_joint", "label_resolved", "forward_max_return")


def decided(spark, folder, keep: tuple[str, ...] = ()) -> DataFrame:
    return scan.decisions(scan.grid_rows(bars(spark, folder)), keep=keep)


def signals(spark, folder, regimes: dict | None = None) -> DataFrame:
    """Emitted signals with the labels of each regime; labels ride along in the same windows."""
    regimes = regimes or {"webpro": REGIMES["webpro"]}
    panel = outcomes_by_regime(bars(spark, folder), regimes)
    keep = tuple(f"{c}__{r}" for r in regimes for c in _LABELS)
    return scan.signals(scan.grid_rows(panel), keep=keep)


def webpro_signals(spark, folder) -> DataFrame:
    got = signals(spark, folder)
    return got.withColumnsRenamed({f"{c}__webpro": c for c in _LABELS})


@query("k40_decision_errors", q.with_(rs.PRIMS, rs.decisions_cte(all_names())) + """
  select strategy_id, count(*) cards, count(score) scored, sum((score is null)::int)::bigint errors,
    sum(prediction)::bigint signals from dec group by 1""")
def _k40(spark, folder):
    return scan.decision_errors(decided(spark, folder))


@query("k41_scan", q.with_(rs.PRIMS, rs.decisions_cte(all_names())) + f"""
  select code, date, strategy_id, {q.r6('score')} score, threshold, prediction from dec""")
def _k41(spark, folder):
    return decided(spark, folder).withColumn("score", r6(F.col("score")))


SIG = q.with_(rs.PRIMS, q.label_cte("webpro"), rs.decisions_cte(all_names()), """sig as (
  select d.code, d.date, d.strategy_id, d.score, d.prediction, l.label_bull, l.label_strict_low,
    least(l.label_bull, l.label_strict_low) label_joint, l.label_resolved, l.forward_max_return
  from dec d join lab_webpro l using (code, date) where d.prediction=1)""")


@query("k42_scan_signals", SIG + f"""select code, date, strategy_id, {q.r6('score')} score, label_bull,
  label_strict_low, label_joint, label_resolved, {q.r6('forward_max_return')} forward_max_return from sig""")
def _k42(spark, folder):
    return webpro_signals(spark, folder).select(
        "code", "date", "strategy_id", r6(F.col("score")).alias("score"), "label_bull", "label_strict_low",
        "label_joint", "label_resolved", r6(F.col("forward_max_return")).alias("forward_max_return"))


@query("p06_emit_filter", SIG + "select strategy_id, count(*) signals, min(date) first_date, max(date) last_date from sig group by 1")
def _p06(spark, folder):
    return scan.emitted(decided(spark, folder)).groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("signals"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


_META = ", ".join(
    f"('{n}','{rule(n)[0]}',{rule(n)[1]}::double,'{'base' if n in STRATEGIES else 'selector'}')" for n in all_names())


@query("k43_strategy_registry", q.with_(rs.PRIMS, rs.decisions_cte(all_names())) + f"""
  select r.*, count(d.code) decisions, coalesce(sum(d.prediction),0)::bigint signals
  from (values {_META}) r(strategy_id, base, threshold, kind) left join dec d using (strategy_id) group by all""")
def _k43(spark, folder):
    counted = decided(spark, folder).groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("decisions"), F.sum("prediction").alias("signals"))
    return registry(spark).select("strategy_id", "base", "threshold", "kind").join(
        counted, "strategy_id", "left").na.fill(0, ["decisions", "signals"])


@query("e05_strategies_without_signals", q.with_(rs.PRIMS, rs.decisions_cte(all_names())) + f"""
  select r.strategy_id from (values {_META}) r(strategy_id, base, threshold, kind)
  where r.strategy_id not in (select strategy_id from dec where prediction=1)""")
def _e05(spark, folder):
    return registry(spark).select("strategy_id").join(
        scan.emitted(decided(spark, folder)).select("strategy_id"), "strategy_id", "left_anti")


_HIT_ALL = q.with_(
    rs.PRIMS, *[q.label_cte(r, spec=v) for r, v in PANEL_REGIMES.items()], rs.decisions_cte(all_names()),
    "labs as (" + " union all ".join(
        f"select '{r}' regime, code, date, seq, label_bull, label_strict_low, least(label_bull,label_strict_low) "
        f"label_joint, label_resolved from lab_{r}" for r in PANEL_REGIMES) + ")",
    """sg as (select d.strategy_id, l.* from dec d join labs l using (code, date) where d.prediction=1)""",
    "live as (select * from sg where label_resolved)",
    q.dedupe_cte("live", "ded", ["strategy_id", "regime"], 60),
    "cens as (select strategy_id, regime, count(*) filter (not label_resolved) censored_signals from sg group by all)",
    """rw as (select strategy_id, regime, count(*) signals_raw, sum(label_bull)::bigint bull_hits_raw from live group by all)""",
    """dd as (select strategy_id, regime, count(*) signals_deduped, sum(label_bull)::bigint bull_hits_deduped,
      sum(label_joint)::bigint joint_hits_deduped, sum(label_strict_low)::bigint low,
      count(distinct code) distinct_stocks, count(distinct date) distinct_dates from ded group by all)""",
    """hh as (select strategy_id, regime, sum(n*n)/(sum(n)::double*sum(n)) hhi from
      (select strategy_id, regime, date, count(*)::double n from ded group by all) group by all)""",
    """base as (select regime, avg(label_bull) baseline from labs where label_resolved and seq>=60 and seq%5=0 group by 1)""")

_BL, _BH = q.wilson_sql("coalesce(bull_hits_deduped,0)", "coalesce(signals_deduped,0)")
_JL, _JH = q.wilson_sql("coalesce(joint_hits_deduped,0)", "coalesce(signals_deduped,0)")


@query("a05_hit_rate_table", _HIT_ALL + f"""select strategy_id, regime, coalesce(signals_raw,0) signals_raw,
  coalesce(bull_hits_raw,0) bull_hits_raw, {q.r6('bull_hits_raw/signals_raw::double')} bull_precision_raw,
  coalesce(signals_deduped,0) signals_deduped, coalesce(bull_hits_deduped,0) bull_hits_deduped,
  {q.r6('bull_hits_deduped/signals_deduped::double')} bull_precision_deduped,
  coalesce(joint_hits_deduped,0) joint_hits_deduped, {q.r6('joint_hits_deduped/signals_deduped::double')} joint_precision_deduped,
  {q.r6('low/signals_deduped::double')} strict_low_rate_deduped, coalesce(distinct_stocks,0) distinct_stocks,
  coalesce(distinct_dates,0) distinct_dates, censored_signals, {q.r6('hhi')} hhi_date_concentration,
  {q.r6(_BL)} bull_wilson_low, {q.r6(_BH)} bull_wilson_high, {q.r6(_JL)} joint_wilson_low, {q.r6(_JH)} joint_wilson_high,
  'scanned_stride5_minhist60' population_id, {q.r6('baseline')} baseline,
  {q.r6('case when baseline<>0 then bull_hits_deduped/signals_deduped::double/baseline end')} lift
  from cens left join rw using (strategy_id, regime) left join dd using (strategy_id, regime)
  left join hh using (strategy_id, regime) left join base using (regime)""")
def hit_rate_table(spark, folder):
    """Per strategy and regime: raw and de-duplicated hits, intervals, base rate and lift."""
    keys = ["strategy_id", "regime"]
    panel = outcomes_by_regime(bars(spark, folder), PANEL_REGIMES)
    cols = ("label_bull", "label_strict_low", "label_joint", "label_resolved")
    keep = tuple(f"{c}__{r}" for r in PANEL_REGIMES for c in cols)
    grid = staged(scan.scored(scan.grid_rows(panel), keep=keep))
    got = scan.signals(grid, keep=keep)
    long = long_outcomes(got, ["strategy_id", "code", "date"], PANEL_REGIMES, cols)
    report = scoring.hit_rates(long, keys).withColumn("population_id", F.lit(scoring.population_id("scanned")))
    base = scoring.base_rates(long_outcomes(grid, ["code", "date"], PANEL_REGIMES, cols), ["regime"])
    out = scoring.with_lift(report, base, ["regime"])
    rates = [c for c in out.columns if "precision" in c or "wilson" in c or "_rate" in c or c in (
        "hhi_date_concentration", "baseline", "lift")]
    return out.withColumns({c: r6(F.col(c)) for c in rates})


@query("a03_population_baselines", _HIT_ALL + f"""select regime, count(*) evaluated_points,
  {q.r6('avg(label_bull)')} bull_rate, {q.r6('avg(label_joint)')} joint_rate, {q.r6('avg(label_strict_low)')} strict_low_rate,
  min(date) date_min, max(date) date_max, 'scanned_stride5_minhist60' population_id
  from labs where label_resolved and seq>=60 and seq%5=0 group by 1""")
def _a03(spark, folder):
    cols = ("label_bull", "label_strict_low", "label_joint", "label_resolved")
    grid = scan_grid(outcomes_by_regime(bars(spark, folder), PANEL_REGIMES))
    got = scoring.base_rates(long_outcomes(grid, ["code", "date"], PANEL_REGIMES, cols), ["regime"])
    return got.select("regime", "evaluated_points", *[r6(F.col(c)).alias(c) for c in (
        "bull_rate", "joint_rate", "strict_low_rate")], "date_min", "date_max", "population_id")


@query("l02_outcomes_by_regime", _HIT_ALL + """select regime, code, date, label_bull, label_strict_low,
  case when label_resolved then label_joint end label_joint, label_resolved from labs""")
def _l02(spark, folder):
    cols = ("label_bull", "label_strict_low", "label_joint", "label_resolved")
    return long_outcomes(outcomes_by_regime(bars(spark, folder), PANEL_REGIMES), ["code", "date"], PANEL_REGIMES, cols)
