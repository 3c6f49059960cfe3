"""Cooldown, scoring and strategy rules."""

import pandas as pd
import pytest
from panels import steady, to_spark, wavy
from pyspark.sql import functions as F

from barsift.functions.columns import wilson
from barsift.operators import scan
from barsift.operators.context import with_kdj, with_kdj_first_value
from barsift.operators.layers import with_ema
from barsift.operators.cooldown import dedupe, dedupe_on_calendar, first_per_year
from barsift.operators.grid import row_stride, scan_grid, scan_targets
from barsift.operators.scoring import concentration, hit_rates, spearman
from barsift.operators.strategies import Strategies, all_names, components, rule, score, with_primitives

DAYS = pd.bdate_range("2024-01-01", periods=130).date


def signals(spark, rows):
    return spark.createDataFrame([(c, DAYS[i]) for c, i in rows], "code string, date date")


def kept(df):
    return sorted((r.code, list(DAYS).index(r.date)) for r in df.collect())


def test_cluster_keeps_its_first_signal(spark):
    assert kept(dedupe(signals(spark, [("000001", i) for i in range(10)]))) == [("000001", 0)]


def test_cooldown_counts_sessions_from_the_last_kept(spark):
    filler = [("999999", i) for i in range(130)]
    got = dedupe(signals(spark, filler + [("000001", i) for i in (0, 30, 59, 60, 61, 119, 121)]))
    assert [k for k in kept(got) if k[0] == "000001"] == [("000001", i) for i in (0, 60, 121)]


def test_codes_are_independent(spark):
    got = dedupe(signals(spark, [(c, i) for i in range(5) for c in ("000001", "000002", "000003")]))
    assert kept(got) == [("000001", 0), ("000002", 0), ("000003", 0)]


def test_market_clock_needs_no_filler_and_refuses_unknown_dates(spark):
    calendar = spark.createDataFrame([(d,) for d in DAYS], "date date")
    got = dedupe_on_calendar(signals(spark, [("000001", 0), ("000001", 59), ("000001", 60)]), calendar)
    assert kept(got) == [("000001", 0), ("000001", 60)]
    with pytest.raises(Exception, match="absent from the calendar"):
        dedupe_on_calendar(signals(spark, [("000001", 0)]), calendar.filter(F.col("date") > F.lit(DAYS[3]))).collect()


def test_first_signal_of_a_year_is_a_whole_row(spark):
    rows = spark.createDataFrame([("000001", pd.Timestamp(d).date(), s) for d, s in (
        ("2023-03-01", None), ("2023-05-01", 2.0), ("2024-01-05", 3.0))], "code string, date date, score double")
    assert [(str(r.date), r.score) for r in first_per_year(rows).orderBy("date").collect()] == [
        ("2023-03-01", None), ("2024-01-05", 3.0)]


@pytest.mark.parametrize("hits, n, low, high", [(79, 100, (0.69, 0.71), (0.855, 0.862)), (0, 50, (0, 0), (0.05, 0.1)), (50, 50, (0.9, 0.95), (1, 1))])
def test_wilson(spark, hits, n, low, high):
    lo, hi = wilson(F.lit(hits), F.lit(n))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert low[0] - 1e-12 <= r.lo <= low[1] + 1e-12 and high[0] - 1e-12 <= r.hi <= high[1] + 1e-12


def test_grid_counts(spark):
    panel = to_spark(spark, steady("000001", 65), steady("000002", 65))
    assert [scan_targets(panel, s).count() for s in (1, 2, 5)] == [10, 6, 2]
    assert scan_targets(panel).exceptAll(scan_grid(panel).select("code", "date")).count() == 0


def test_row_stride_numbers_across_codes(spark):
    panel = to_spark(spark, steady("000001", 13), steady("000002", 13))
    got = [(r.code, r.row_no) for r in row_stride(panel, 5).orderBy("row_no").collect()]
    assert got == [("000001", 0), ("000001", 5), ("000001", 10), ("000002", 15), ("000002", 20), ("000002", 25)]


def _kdj(f):
    k = d = 50.0
    out = []
    for i in range(len(f)):
        w = f.iloc[max(0, i - 8): i + 1]
        lo, hi = w["low"].min(), w["high"].max()
        rsv = (f["close"].iloc[i] - lo) / (hi - lo) * 100 if hi - lo > 1e-12 else 50.0
        k = 2 / 3 * k + rsv / 3
        d = 2 / 3 * d + k / 3
        out.append((k, d))
    return out


def test_kdj_matches_the_recursion_past_a_block_edge(spark):
    # 1,480 bars is where the weighted sum opens a second block.
    f = wavy("000001", 3100, 8)
    got = with_kdj(to_spark(spark, f)).orderBy("date").collect()
    for r, (k, d) in zip(got, _kdj(f), strict=True):
        assert abs(r.kdj_k - k) < 1e-8 and abs(r.kdj_d - d) < 1e-8


def test_flat_window_is_neutral(spark):
    got = with_kdj(to_spark(spark, steady(n=30))).collect()
    assert all(abs(r.kdj_k - 50) < 1e-9 and abs(r.kdj_d - 50) < 1e-9 for r in got)


def test_first_value_variant_matches_pandas(spark):
    f = wavy("000001", 60, 2)
    got = with_kdj_first_value(to_spark(spark, f)).orderBy("date").toPandas()
    lo, hi = f["low"].rolling(9, min_periods=9).min(), f["high"].rolling(9, min_periods=9).max()
    k = (100 * (f["close"] - lo) / (hi - lo + 1e-12)).ewm(alpha=1 / 3, adjust=False).mean()
    pd.testing.assert_series_equal(got["kdj_k"], k, check_names=False, rtol=1e-9)


def test_every_strategy_scores_complete_cards_only(spark):
    panel = to_spark(spark, wavy("000001", 75, 1), wavy("000002", 59, 2))
    got = scan.decisions(scan.grid_rows(panel, 1, 0)).groupBy("strategy_id").agg(
        F.count("score").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    assert len(got) == 36 and {r.n for r in got} == {16}
    assert all(-1e-9 <= r.lo and r.hi <= 1 + 1e-9 for r in got)


def test_unknown_volume_makes_the_score_unknown(spark):
    f = wavy("000001", 70, 1)
    f.loc[40, "volume"] = None
    got = scan.decision_errors(scan.decisions(scan.grid_rows(to_spark(spark, f), 1, 0), Strategies(["obv_volume_price"]))).first()
    assert (got.cards, got.scored, got.errors) == (11, 0, 11)


@pytest.mark.parametrize("name", ["turnover_weak_to_strong", "turnover_regime_switch", "accumulation_base", "donchian_turtle"])
def test_ratio_strategies_ignore_the_volume_scale(spark, name):
    f = wavy("000001", 90, 5)
    g = f.assign(volume=f["volume"] * 1000)
    a, b = ([r.s for r in scan.grid_rows(to_spark(spark, x), 1, 0).select(score(name).alias("s"), "date").orderBy("date").collect()]
            for x in (f, g))
    assert max(abs(x - y) for x, y in zip(a, b, strict=True)) < 1e-9


def test_selectors_share_their_base_score(spark):
    panel = to_spark(spark, wavy("000001", 120, 4))
    got = scan.decisions(scan.grid_rows(panel, 1, 60)).select("date", "strategy_id", "score", "threshold", "prediction")
    rows = {(r.strategy_id, r.date): r for r in got.collect()}
    for n in all_names():
        base, cut = rule(n)
        for (s, d), r in rows.items():
            if s == n:
                assert r.score == rows[(base, d)].score and r.prediction == int(r.score >= cut)


def test_components_rebuild_the_score(spark):
    rows = with_primitives(to_spark(spark, wavy("000001", 70, 9))).filter("seq >= 60")
    parts = components("washout_complete")
    assert len(parts) == 5
    got = scan.decision(to_spark(spark, wavy("000001", 70, 9)), "washout_complete", 1, 60).collect()
    assert len(got) == rows.count() and all(set(r.components) == set(parts) for r in got)


def test_custom_strategy(spark):
    s = Strategies(["donchian_turtle"]).add("always", lambda: F.when(F.col("card_bars") == 60, F.lit(1.0)), 0.5)
    got = scan.emitted(scan.decisions(scan.grid_rows(to_spark(spark, wavy("000001", 70, 1)), 1, 60), s))
    assert got.filter("strategy_id = 'always'").count() == 10
    with pytest.raises(ValueError):
        s.add("always", lambda: F.lit(1.0), 0.5)


def test_unresolved_signals_are_counted_not_scored(spark):
    rows = spark.createDataFrame(
        [("s", "000001", DAYS[0], 1, 1, 1, True), ("s", "000002", DAYS[0], 0, 0, 1, True), ("s", "000003", DAYS[1], None, None, None, False)],
        "strategy_id string, code string, date date, label_bull int, label_joint int, label_strict_low int, label_resolved boolean")
    r = hit_rates(rows, ["strategy_id"]).first()
    assert (r.signals_raw, r.signals_deduped, r.censored_signals, r.bull_precision_deduped) == (2, 2, 1, 0.5)
    assert r.hhi_date_concentration == 1.0


def test_concentration_names_the_busiest_date(spark):
    rows = spark.createDataFrame([(DAYS[0], "a", 1), (DAYS[0], "b", 0), (DAYS[1], "a", 1)], "date date, code string, hit int")
    r = concentration(rows, []).first()
    assert r.busiest_date == DAYS[0] and r.precision_drop_busiest_date == 1.0 and r.n_distinct_stocks == 2


def test_spearman_with_ties(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (3.0, 4.0)], "a double, b double")
    want = pd.DataFrame({"a": [1, 2, 3, 3], "b": [2, 2, 5, 4]}).corr("spearman").iloc[0, 1]
    assert abs(spearman(rows, [], "a", "b").first().rho - want) < 1e-12


def test_slow_and_fast_means_of_one_call_keep_their_history(spark):
    f = wavy("000001", 2500, 5)
    got = with_ema(to_spark(spark, f), spans=(2, 500)).orderBy("date").toPandas()
    for w in (2, 500):
        want = f["close"].ewm(span=w, adjust=False, min_periods=w).mean()
        pd.testing.assert_series_equal(got[f"ema{w}"], want, check_names=False, rtol=1e-9)
