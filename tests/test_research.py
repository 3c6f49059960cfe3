"""Layers, long-horizon events, volume impact, calendars and storage."""

import numpy as np
import pandas as pd
import pytest
from panels import steady, to_spark, wavy
from pyspark.sql import functions as F

from barsift.functions.windows import ewm
from barsift.operators import audits as au
from barsift.operators import horizon as hz
from barsift.operators import layers, matrix, research as rsr
from barsift.sources import panel as src


def series(df, column):
    return df.orderBy("code", "date").toPandas()[column].astype(float)


def test_ewm_with_gaps_matches_pandas(spark):
    f = wavy("000001", 120, 3)
    f.loc[[0, 1, 17, 18, 19, 60], "close"] = None
    got = series(ewm(to_spark(spark, f), {"e": ("close", 1 / 14, None, 5)}, gaps=True), "e")
    want = f["close"].ewm(alpha=1 / 14, adjust=False, min_periods=5).mean()
    pd.testing.assert_series_equal(got, want, check_names=False, rtol=1e-9)


def test_ema_and_adx_match_pandas(spark):
    f = wavy("000001", 200, 5)
    got = layers.with_adx(layers.with_ema(to_spark(spark, f))).orderBy("date").toPandas()
    for w in (5, 60):
        want = f["close"].ewm(span=w, adjust=False, min_periods=w).mean()
        assert np.allclose(got[f"ema{w}"].astype(float), want, equal_nan=True)
    up, down = f["high"].diff(), -f["low"].diff()
    pdm = pd.Series(np.where((up > down) & (up > 0), up, 0.0))
    ndm = pd.Series(np.where((down > up) & (down > 0), down, 0.0))
    pc = f["close"].shift()
    tr = pd.concat([f["high"] - f["low"], (f["high"] - pc).abs(), (f["low"] - pc).abs()], axis=1).max(axis=1)

    def smooth(s):
        return s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()

    p, n = 100 * smooth(pdm) / smooth(tr), 100 * smooth(ndm) / smooth(tr)
    assert np.allclose(got["adx14"].astype(float), smooth(100 * (p - n).abs() / (p + n)), equal_nan=True)
    assert np.allclose(got["di_spread"].astype(float), p - n, equal_nan=True)


def test_tiers_nest_and_ignore_the_future(spark):
    panel = to_spark(spark, *[wavy(f"{i:06d}", 150, i) for i in range(6)])
    lay = layers.with_layers(panel)
    assert lay.filter("recall_tier > 0 and drawdown60 > -0.15").count() == 0
    cut = "2020-06-01"
    prefix = hz.candidates(layers.with_layers(panel.filter(F.col("date") <= cut)))
    assert hz.prefix_differences(prefix, hz.candidates(lay), cut).count() == 0
    assert hz.repeated_candidates(hz.candidates(lay)).count() == 0


def horizon_panel(n=510):
    f = steady("000001", n)
    f["high"], f["low"] = 10.1, 9.9
    return f


def outcome(spark, f, calendar=None, h=504):
    picks = to_spark(spark, f).orderBy("date").limit(1).select("code", "date")
    cal = None if calendar is None else spark.createDataFrame(pd.DataFrame({"date": calendar}), "date date")
    return hz.label_events(to_spark(spark, f), picks, cal, h).first()


@pytest.mark.parametrize("change, want", [
    ({"high": 41.0, "close": 39.0}, "timeout"), ({"close": 40.00}, "timeout"), ({"close": 40.01}, "success"),
    ({"close": 41.0, "low": 7.99}, "risk")])
def test_event_classes(spark, change, want):
    f = horizon_panel()
    for c, v in change.items():
        f.loc[7, c] = v
    r = outcome(spark, f)
    assert r.outcome_class == want and r.training_eligible
    assert r.bars_scanned == (504 if want == "timeout" else 7)


def test_missing_bars_and_prices(spark):
    f = horizon_panel()
    days = list(f["date"])
    assert outcome(spark, f.drop(index=1), days).outcome_class == "no_entry"
    r = outcome(spark, f.drop(index=9), days)
    assert (r.outcome_class, r.first_missing_session, r.bars_scanned) == ("unknown_missing_bar", days[9], 8)
    g = f.copy()
    g.loc[9, "close"] = None
    assert outcome(spark, g, days).outcome_class == "unknown_missing_price"
    early = f.drop(index=9).copy()
    early.loc[4, "low"] = 7.0
    assert outcome(spark, early, days).outcome_class == "risk"
    assert outcome(spark, f.head(100)).outcome_class == "pending_maturity"
    assert outcome(spark, f.head(1)).outcome_class == "pending_entry_calendar"
    # Sessions after the last bar of any code aren't observed yet; those with another code's bars are.
    short = f.head(60).drop(index=range(50, 60))
    assert outcome(spark, short, days[:60]).outcome_class == "pending_maturity"
    both = to_spark(spark, short, f.head(60).assign(code="000002"))
    picks = both.filter("code = '000001'").orderBy("date").limit(1).select("code", "date")
    assert hz.label_events(both, picks).first().outcome_class == "unknown_missing_bar"


def test_split_support(spark):
    def splits(n, h=504):
        cal = spark.createDataFrame(pd.DataFrame({"date": pd.bdate_range("2020-01-01", periods=n).date}), "date date")
        return hz.mature_splits(cal, cal, h)

    assert splits(887).count() == 0 and splits(1200).count() > 0
    assert splits(hz.minimum_sessions(20), 20).count() == 1 and splits(hz.minimum_sessions(20) - 1, 20).count() == 0


def impact_frame(n=90):
    t = np.arange(n)
    close = 20 * np.exp(np.cumsum(np.where(t % 2 == 0, 0.02, -0.018)))
    f = steady("000001", n)
    f["close"], f["open"] = close, close
    f["high"], f["low"] = close * 1.01, close * 0.99
    f["volume"] = 1000 + 200 * np.sin(t)
    return f


def vir(spark, f):
    return rsr.with_volume_impact(src.with_session_id(to_spark(spark, f))).orderBy("date").toPandas()


def test_volume_impact_scale_prefix_and_gaps(spark):
    f = impact_frame()
    base = vir(spark, f)
    assert base["vir"].notna().sum() > 30
    scaled = vir(spark, f.assign(volume=f["volume"] * 7))
    assert np.allclose(base["vir"].astype(float), scaled["vir"].astype(float), equal_nan=True)
    assert np.allclose(vir(spark, f.head(60))["vir"].astype(float), base["vir"].head(60).astype(float), equal_nan=True)
    other = steady("000002", 90)
    gap = rsr.with_volume_impact(src.with_session_id(to_spark(spark, f.drop(index=70), other)))
    rows = gap.filter("code = '000001'").orderBy("date").toPandas()
    assert rows["vir"].iloc[70:88].isna().all() and rows["vir"].iloc[60] == pytest.approx(base["vir"].iloc[60])


def test_family_ecdf_is_frozen(spark):
    rng = np.random.default_rng(2)
    f = pd.DataFrame({"code": [str(i) for i in range(200)], "date": pd.Timestamp("2024-01-01").date(),
                      "a": np.round(rng.random(200), 2), "b": rng.random(200)})
    rows = spark.createDataFrame(f, "code string, date date, a double, b double")
    train = rows.filter("cast(code as int) < 120")
    got = rsr.family_ecdf(train, rows, {"one": "a", "two": "b"}, split_rows=15).toPandas().set_index("code").loc[f["code"]]
    for fam, c in (("one", "a"), ("two", "b")):
        t = np.sort(f[c][:120])
        assert np.allclose(got[f"family_q__{fam}"], np.searchsorted(t, f[c], side="right") / 120)
    q = got[["family_q__one", "family_q__two"]]
    assert np.allclose(got["family_dominance"], q.max(axis=1) - q.median(axis=1))


def test_densify_inserts_unknown_bars_inside_the_span(spark):
    f = steady("000001", 10)
    cal = spark.createDataFrame(pd.DataFrame({"date": list(f["date"]) + list(pd.bdate_range("2025-01-01", periods=3).date)}), "date date")
    got = src.densify(to_spark(spark, f.drop(index=4)), cal)
    assert got.count() == 10 and [str(r.date) for r in got.filter("close is null").collect()] == [str(f["date"][4])]


def test_truncation_finds_only_the_leak(spark):
    panel = to_spark(spark, *[wavy(f"{i:06d}", 120, i) for i in range(3)])
    clean = au.truncation_test(panel, matrix.with_price_features, ["ret5", "vol20", "kdj_k"], "2020-04-01")
    assert {r.differing for r in clean.collect()} == {0}
    for kind in ("max_high", "last_close"):
        assert au.truncation_test(panel, lambda p, k=kind: au.with_leak(p, k), ["leak"], "2020-04-01").first().differing > 0


def test_cards_round_trip_and_violations(spark):
    from barsift.operators.context import with_kdj
    cards = au.make_cards(with_kdj(to_spark(spark, wavy("000001", 65, 1))).withColumn("turnover", F.col("volume")))
    assert cards.count() == 6 and au.card_violations(cards).count() == 0
    bad = cards.withColumn("observation_date", F.date_add("observation_date", 1))
    assert {r.violation for r in au.card_violations(bad).collect()} == {"last_bar_not_observed"}
    assert au.explode_cards(cards).count() == 360


def test_storage_round_trips(spark, tmp_path):
    panel = to_spark(spark, wavy("000001", 30, 1))
    path = str(tmp_path / "panel")
    assert src.load_panel(spark, path, lambda: panel).exceptAll(panel).count() == 0
    assert src.load_panel(spark, path).count() == 30
    with pytest.raises(FileNotFoundError):
        src.load_panel(spark, str(tmp_path / "none"))
    src.write_matrix(panel, str(tmp_path / "m"), 10, 0.3, 5)
    src.write_matrix(panel, str(tmp_path / "m"), 10, 0.3, 1)
    assert {r.stride for r in src.load_matrix(spark, str(tmp_path / "m"), 10, 0.3).select("stride").distinct().collect()} == {1}
    src.write_bucketed(panel, "bars_by_code", 4)
    plan = spark.table("bars_by_code").groupBy("code").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("drop table bars_by_code")


def test_label_like_feature_names_are_refused(spark):
    df = to_spark(spark, steady()).withColumn("forward_max", F.lit(1.0))
    with pytest.raises(ValueError):
        matrix.checked_features(df, ["forward_max"])
    assert matrix.group_membership(spark, ["ret1", "odd"]).filter("state = 'unmapped'").count() == 1


def test_events_fail_closed_on_keys_and_ids(spark):
    panel = to_spark(spark, wavy("000001", 30, 2))
    picks = panel.limit(3).select("code", "date")
    calendar = panel.select("date").filter("dayofweek(date) <> 4")
    with pytest.raises(Exception, match="off the calendar"):
        hz.label_events(panel, picks.join(calendar, "date"), calendar, 5).collect()
    with pytest.raises(Exception, match="repeated candidate"):
        hz.label_events(panel, picks.unionByName(picks), None, 5).collect()


def test_cards_of_a_grid_and_their_scores_move_nothing(spark):
    """Only grid bars get a card, and a card is scored where it lies: no exchange above the one on code."""
    from barsift.functions.windows import histories
    from barsift.operators import grid, scan
    from barsift.operators.context import with_kdj

    flat = to_spark(spark, wavy("000001", 90, 1), wavy("000002", 75, 2))
    panel = with_kdj(flat.repartition(5, "code")).withColumn("turnover", F.col("volume"))
    cards = au.make_cards(panel, rows=grid.scan_grid)
    assert sorted(tuple(r) for r in cards.groupBy("code").count().collect()) == [("000001", 6), ("000002", 3)]
    assert au.card_violations(cards).count() == 0
    rows = au.explode_cards(cards)
    with histories("code", "observation_date"):
        rows = scan.with_primitives(rows)
    rows = rows.filter("date = observation_date")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    # The card alone gives what the whole history gives, where sixty bars are enough.
    whole = {(r.code, r.date): (r.top20, r.std20, r.card_bars) for r in scan.grid_rows(panel).collect()}
    got = {(r.code, r.date): (r.top20, r.std20, r.card_bars) for r in rows.collect()}
    assert got.keys() == whole.keys() and all(
        g[0] == w[0] and abs(g[1] - w[1]) < 1e-9 and g[2] == w[2] == 60 for g, w in ((got[k], whole[k]) for k in got))


def test_market_and_session_statistics_move_no_rows(spark):
    """Rows meet one row per session, or per feature and session, without a shuffle of their own."""
    flat = to_spark(spark, wavy("000001", 90, 1), wavy("000002", 75, 2))
    price = matrix.with_price_features(flat)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = price.select("code", "date", "ret1", "_up")
        assert matrix.with_market_features(plain)._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0
        cross = matrix.with_cross_section(price)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [feature" in cross
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_asked_rows_keep_their_ranks_among_all(spark):
    rows = matrix.with_price_features(to_spark(spark, wavy("000001", 70, 1), wavy("000002", 66, 2), wavy("000003", 68, 3)))
    asked = F.dayofmonth("date") % 5 == 0
    names = ["code", "date", "cs_ret5_rank", "cs_ret5_z", "cs_pos60_rank"]
    got = matrix.with_cross_section(rows, asked=asked).select(*names).toPandas()
    want = matrix.with_cross_section(rows).filter(asked).select(*names).toPandas()
    assert 0 < len(got) < 70
    pd.testing.assert_frame_equal(*[t.sort_values(["code", "date"]).reset_index(drop=True) for t in (got, want)])
