"""Table jobs that check data, features, labels and reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import Z_EXACT
from ..functions.columns import wilson
from ..functions.windows import back, seq, span, spread
from .crosssec import melt
from .ranking import quantiles
from .scoring import ratio



def _count(cond: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("int")), F.lit(0))


def verify_panel(panel: DataFrame) -> DataFrame:
    """One row of counts: repeated keys, unusable closes, broken brackets, empty bars, date order."""
    keys = panel.agg(F.countDistinct("code", "date").alias("_keys"), F.countDistinct("code").alias("codes"))
    checks = panel.agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        _count(F.col("close").isNull()).alias("null_close"), _count(F.col("close") <= 0).alias("nonpositive_close"),
        _count(F.col("high") < F.col("low")).alias("bad_hl_bracket"),
        _count((F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))).alias("close_outside_bracket"),
        _count(F.col("volume") == 0).alias("zero_volume_rows"))
    order = panel.withColumn("_prev", back("date", 1)).agg(
        (_count(F.col("date") <= F.col("_prev")) == 0).alias("monotonic_dates_per_code"))
    return checks.join(F.broadcast(keys)).join(F.broadcast(order)).withColumn(
        "duplicate_code_date", F.col("rows") - F.col("_keys")).drop("_keys")


def source_mismatches(panel: DataFrame, raw: DataFrame, columns: tuple[str, ...] = ("close", "volume"),
                      keep_one_in: int = 1) -> DataFrame:
    """Keys of both tables whose values differ at six digits; a hash of the key may thin the check."""
    side = raw.select("code", "date", *[F.col(c).alias(f"_raw_{c}") for c in columns])
    pick = F.pmod(F.xxhash64("code", "date"), F.lit(keep_one_in)) == 0
    both = (panel.filter(pick) if keep_one_in > 1 else panel).join(side, ["code", "date"])
    return both.agg(F.count(F.lit(1)).alias("checked"), *[
        _count(F.round(c, 6) != F.round(f"_raw_{c}", 6)).alias(f"{c}_mismatch") for c in columns])


def bar_violations(panel: DataFrame) -> DataFrame:
    """One row per bar and broken rule."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    rules = {
        "not_finite": reduce(lambda a, b: a | b, [x.isNull() | F.isnan(x) for x in (o, h, lo, c, v)]),
        "not_positive": (o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0),
        "high_below_body": h < F.greatest(o, c, lo), "low_above_body": lo > F.least(o, c, h),
        "negative_volume": v < 0}
    found = F.filter(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]),
                     lambda x: x.isNotNull())
    return panel.select("code", "date", F.explode(found).alias("violation"))


def make_cards(panel: DataFrame, bars: int = 60, rows: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Nested card of each bar that has a full window: its bars and indicator series.

    Only for consumers that want the nested object; the scan itself uses windows. ``rows`` picks the bars that get a card,
    by a filter on windows of a code, so that cards nobody asks for are never moved.
    """
    frame = span(-(bars - 1), 0)
    bar = F.struct("date", "open", "high", "low", "close", "volume", "turnover")
    df = panel.withColumns({
        "bars": F.collect_list(bar).over(frame), "_k": F.collect_list("kdj_k").over(frame),
        "_d": F.collect_list("kdj_d").over(frame)})
    df = df.filter(F.size("bars") == bars) if rows is None else rows(df).filter(F.size("bars") == bars)
    return df.select(
        F.concat_ws("|", "code", F.date_format("date", "yyyy-MM-dd")).alias("sample_id"), "code",
        F.col("date").alias("observation_date"), "bars",
        F.create_map(F.lit("kdj_k"), F.col("_k"), F.lit("kdj_d"), F.col("_d")).alias("indicators"))


def card_violations(cards: DataFrame, bars: int = 60) -> DataFrame:
    """One row per card and broken rule: length, date order, last bar, series length."""
    dates = F.transform("bars", lambda b: b["date"])
    rules = {
        "wrong_length": F.size("bars") != bars,
        "dates_not_increasing": dates != F.array_sort(F.array_distinct(dates)),
        "last_bar_not_observed": F.element_at(dates, -1) != F.col("observation_date"),
        "series_length": F.exists(F.map_values("indicators"), lambda s: F.size(s) != bars)}
    found = F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    return cards.select("sample_id", F.explode(found).alias("violation"))


def explode_cards(cards: DataFrame) -> DataFrame:
    """Cards back to bars; each card is its own history, keyed by code and observation date."""
    rows = cards.select("sample_id", "code", "observation_date", F.posexplode("bars").alias("_i", "_b"), "indicators")
    return rows.select(
        "sample_id", "code", "observation_date", "_b.*",
        F.element_at(F.element_at("indicators", "kdj_k"), F.col("_i") + 1).alias("kdj_k"),
        F.element_at(F.element_at("indicators", "kdj_d"), F.col("_i") + 1).alias("kdj_d"))


def differences(left: DataFrame, right: DataFrame, columns: list[str], keys: tuple[str, ...] = ("code", "date"),
                tolerance: float = 1e-6) -> DataFrame:
    """Per column: rows compared, largest absolute difference, rows beyond the tolerance or unknown on one side."""
    a, b = melt(left, list(keys), columns), melt(right, list(keys), columns).withColumnRenamed("x", "_y")
    d = F.abs(F.col("x") - F.col("_y"))
    one = F.col("x").isNull() != F.col("_y").isNull()
    return a.join(b, [*keys, "feature"]).groupBy("feature").agg(
        F.count(F.lit(1)).alias("compared"), F.max(d).alias("max_abs_diff"), _count((d > tolerance) | one).alias("differing"))


def key_differences(left: DataFrame, right: DataFrame, only_left: str, only_right: str, keys: tuple[str, ...] = ("code", "date")) -> DataFrame:
    """Keys of one side that the other lacks, as often as they are missing there, with their ``side``.

    Both sides are counted in one aggregate over all shuffle partitions, as keys alone shuffle as few bytes.
    """
    both = left.select(*keys, F.lit(1).alias("_n")).unionByName(right.select(*keys, F.lit(-1).alias("_n")))
    gap = spread(both, *keys).groupBy(*keys).agg(F.sum("_n").alias("_gap")).filter("_gap <> 0")
    side = F.when(F.col("_gap") > 0, only_left).otherwise(only_right)
    return gap.select(*keys, side.alias("side"), F.explode(F.sequence(F.lit(1), F.abs("_gap"))).alias("_i")).drop("_i")


def truncation_test(panel: DataFrame, build, columns: list[str], cutoff: str, tolerance: float = 1e-6) -> DataFrame:
    """Features rebuilt on data up to the cutoff against the full build: a difference means look-ahead."""
    day = F.lit(cutoff).cast("date")
    full = build(panel).filter(F.col("date") <= day)
    cut = build(panel.filter(F.col("date") <= day))
    return differences(full, cut, columns, tolerance=tolerance)


def with_leak(panel: DataFrame, kind: str = "max_high") -> DataFrame:
    """Feature that looks ahead on purpose: the control every look-ahead audit must flag."""
    if kind == "max_high":
        return panel.withColumn("leak", F.max("high").over(span(1, 5)))
    if kind == "last_close":
        return panel.withColumn("leak", F.last("close", ignorenulls=True).over(span(1, 5)))
    raise ValueError(f"unknown leak: {kind}")


def beta_by_join(rows: DataFrame, window: int = 60, least: int = 20) -> DataFrame:
    """Beta from an explicit join of each bar to its own past window, a second way to the rolling one.

    Bars meet through buckets of the window's size.
    """
    idx = rows.select("code", "date", "ret1", "mkt_ret1", seq().alias("_i"))
    mine = idx.select("code", "date", "_i", F.explode(F.array_distinct(F.array(
        F.floor(F.col("_i") / window), F.floor((F.col("_i") - window + 1) / window)))).alias("_bucket"))
    past = idx.select("code", F.col("_i").alias("_j"), F.floor(F.col("_i") / window).alias("_bucket"), "ret1", "mkt_ret1")
    met = mine.join(past, ["code", "_bucket"]).filter(
        (F.col("_j") <= F.col("_i")) & (F.col("_j") > F.col("_i") - window))
    x, y = F.col("ret1"), F.col("mkt_ret1")
    got = met.groupBy("code", "date").agg(
        F.count(x).alias("_n"), F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.avg(x * y).alias("_xy"), F.avg(y * y).alias("_yy"))
    beta = (F.col("_xy") - F.col("_x") * F.col("_y")) / (F.col("_yy") - F.col("_y") * F.col("_y") + 1e-12)
    return got.select("code", "date", F.when(
        F.col("_n") >= least, F.greatest(F.lit(-5.0), F.least(F.lit(5.0), beta))).alias("beta_60"))


def labels_by_join(panel: DataFrame, horizon: int, target_return: float) -> DataFrame:
    """Label rebuilt by a bucketed range join, a second way to the window version."""
    idx = panel.withColumn("_i", seq())
    entry = idx.select("code", (F.col("_i") - 1).alias("_i"), F.col("open").alias("_e"))
    probe = idx.select("code", "date", "_i").join(entry, ["code", "_i"]).withColumn(
        "_bucket", F.explode(F.array_distinct(F.array(
            F.floor((F.col("_i") + 1) / horizon), F.floor((F.col("_i") + horizon) / horizon)))))
    bars = idx.select("code", F.floor(F.col("_i") / horizon).alias("_bucket"), F.col("_i").alias("_j"), "high")
    met = probe.join(bars, ["code", "_bucket"]).filter(
        (F.col("_j") > F.col("_i")) & (F.col("_j") <= F.col("_i") + horizon))
    got = met.groupBy("code", "date").agg(
        F.count("high").alias("_n"), F.max((F.col("high") > F.col("_e") * F.lit(1.0 + target_return)).cast("int")).alias("_hit"))
    return got.filter(F.col("_n") >= horizon).select("code", "date", F.col("_hit").alias("label_rebuilt"))


def census(rows: DataFrame, stride: int, min_history: int) -> DataFrame:
    """Rate of every overlapping population in one pass: full, early, late, scanned and each residue."""
    i = F.col("seq")
    groups = {"panel": F.lit(True), "early": i < min_history, "late": i >= min_history,
              "scanned": (i >= min_history) & (i % stride == 0)}
    groups |= {f"late_residue_{r}": (i >= min_history) & (i % stride == r) for r in range(stride)}
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]), lambda x: x.isNotNull())
    return rows.filter("label_resolved").select(
        F.explode(names).alias("population"), "date", "seq", "label_bull").groupBy("population").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label_bull").alias("hits"), F.avg("label_bull").alias("rate"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.min("seq").alias("seq_min"), F.max("seq").alias("seq_max"))


def standardised_rates(rows: DataFrame, arm: str, label: str = "y", stratum: Column | None = None) -> DataFrame:
    """Rates of two arms, each re-weighted to the other's mix of strata."""
    s = F.date_trunc("month", "date").cast("date") if stratum is None else stratum
    m = F.col(arm).cast("int")
    per = rows.groupBy(s.alias("_s")).agg(
        F.sum(m).cast("double").alias("na"), F.sum(m * F.col(label)).cast("double").alias("ha"),
        F.sum(1 - m).cast("double").alias("nb"), F.sum((1 - m) * F.col(label)).cast("double").alias("hb"))
    common = per.filter("na > 0 and nb > 0")
    ra, rb = F.col("ha") / F.col("na"), F.col("hb") / F.col("nb")
    return common.agg(
        F.count(F.lit(1)).alias("strata"), (F.sum("ha") / F.sum("na")).alias("rate_a"), (F.sum("hb") / F.sum("nb")).alias("rate_b"),
        (F.sum(ra * F.col("nb")) / F.sum("nb")).alias("a_at_b_mix"), (F.sum(rb * F.col("na")) / F.sum("na")).alias("b_at_a_mix"))


def inclusion_by(rows: DataFrame, keep: str, by: Column, name: str) -> DataFrame:
    """Share of rows a sampling rule keeps, per value of ``by``."""
    return rows.groupBy(by.cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(keep).cast("int")).alias("kept_share")).withColumn("by", F.lit(name))


def decile_of(rows: DataFrame, column: str, out: str = "decile", **kw) -> DataFrame:
    """Decile by exact quantile edges; a value on an edge belongs below it."""
    edges = quantiles(rows, [], column, {f"e{i}": i / 10 for i in range(1, 10)}, **kw)
    at = reduce(lambda a, b: a + b, [(F.col(column) > F.col(f"e{i}")).cast("int") for i in range(1, 10)])
    return rows.join(F.broadcast(edges)).withColumn(out, at).drop(*[f"e{i}" for i in range(1, 10)])


def mean_differences(rows: DataFrame, keep: str, columns: list[str]) -> DataFrame:
    """Mean of the kept rows against all rows, in standard deviations of all rows."""
    long = melt(rows, ["code", keep], columns)
    k = F.when(F.col(keep), F.col("x"))
    got = long.groupBy("feature").agg(F.avg("x").alias("full_mean"), F.avg(k).alias("kept_mean"), F.stddev_pop("x").alias("_sd"))
    return got.withColumn("smd", (F.col("kept_mean") - F.col("full_mean")) / (F.col("_sd") + 1e-12)).drop("_sd")


def stride_structure(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Sessions a sample keeps and the range of names per kept session."""
    per = kept.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    a = per.agg(F.count(F.lit(1)).alias("sessions_kept"), F.sum("_n").alias("rows_kept"), F.avg("_n").alias("names_per_session"),
                F.min("_n").alias("names_min"), F.max("_n").alias("names_max"))
    return a.join(F.broadcast(rows.agg(F.countDistinct("date").alias("sessions"), F.count(F.lit(1)).alias("rows"))))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free hash of a table's rows and its row count; the sum tells doubled rows, which cancel in the xor."""
    h = F.xxhash64(*columns)
    total = F.sum(h.cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.xxhash64(F.bit_xor(h), total).alias("fingerprint"))


def report_violations(report: DataFrame, base: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Identities a hit-rate report must obey, as one row per broken identity.

    Precision is hits over signals, lift is precision over the same population's base rate, the
    interval brackets the precision, and emitted signals are the resolved and the censored ones.
    """
    low, high = wilson(F.col("bull_hits_deduped"), F.col("signals_deduped"), Z_EXACT)
    side = base.select("regime", "population_id", F.col("bull_rate").alias("_base"))
    df = report.join(side, ["regime", "population_id"], "left")

    def off(a, b):
        return F.coalesce(F.abs(a - b) > tolerance, F.lit(False))

    p = F.col("bull_precision_deduped")
    rules = {
        "precision_is_hits_over_signals": off(p, ratio("bull_hits_deduped", "signals_deduped")),
        "lift_is_precision_over_base": off(F.col("lift"), ratio(p, F.col("_base"))),
        "interval_brackets_precision": F.coalesce(
            (F.col("bull_wilson_low") > p + tolerance) | (F.col("bull_wilson_high") < p - tolerance), F.lit(False)),
        "interval_matches_counts": off(F.col("bull_wilson_low"), low) | off(F.col("bull_wilson_high"), high),
        "deduped_within_raw": F.col("signals_deduped") > F.col("signals_raw"),
        "hits_within_signals": (F.col("bull_hits_deduped") > F.col("signals_deduped"))
        | (F.col("joint_hits_deduped") > F.col("bull_hits_deduped"))}
    found = F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    return df.select("strategy_id", "regime", F.explode(found).alias("violation"))


def coverage_problems(predictions: DataFrame, outcomes: DataFrame, strategies: DataFrame) -> DataFrame:
    """For each strategy: samples never predicted, predicted more than once, and predicted without an outcome.

    A strategy that predicts but isn't listed gets a row of its own, with unknown ``missing``.
    """
    n = predictions.groupBy("strategy_id", "sample_id").agg(F.count(F.lit(1)).alias("_n"))
    listed = strategies.select("strategy_id").join(F.broadcast(outcomes.agg(F.count(F.lit(1)).alias("_want"))))
    known = outcomes.select("sample_id", F.lit(True).alias("_known"))
    have = n.join(known, "sample_id", "left").groupBy("strategy_id").agg(
        _count(F.col("_known")).alias("_have"), _count(F.col("_known") & (F.col("_n") > 1)).alias("_repeated"),
        _count(F.col("_known").isNull()).alias("_unknown"))
    return listed.join(have, "strategy_id", "full").select(
        "strategy_id", (F.col("_want") - F.coalesce("_have", F.lit(0))).alias("missing"),
        F.coalesce("_repeated", F.lit(0)).alias("repeated"), F.coalesce("_unknown", F.lit(0)).alias("unknown"))


def outcome_counts(outcomes: DataFrame, label: str = "label_bull") -> DataFrame:
    """Outcomes: rows, positives, and values outside 0 and 1."""
    return outcomes.agg(F.count(F.lit(1)).alias("samples"), _count(F.col(label) == 1).alias("positives"),
                        _count(~F.col(label).isin(0, 1)).alias("not_binary"))


def rolling_inventory(plan_features: dict[str, tuple[int, str, int]], spark) -> DataFrame:
    """Every rolling feature with its window, statistic, least count and direction."""
    return spark.createDataFrame([(n, w, s, m, "backward") for n, (w, s, m) in plan_features.items()],
                                 "feature string, bars int, statistic string, least int, direction string")


def signal_windows(panel: DataFrame, signals: DataFrame, before: int = 60, after: int = 60) -> DataFrame:
    """Bars around each signal with their offset; a signal needs ``before + 1`` bars in its window.

    Bars and signals meet in buckets as wide as the window, never across a whole history.
    """
    width = before + after
    # Bars from this one to the end, counted from the end so that the frame only grows.
    rest = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    idx = panel.withColumns({"_i": seq(), "_left": rest})
    marks = signals.join(idx.select("code", "date", "_i", "_left"), ["code", "date"])
    size = F.least(F.col("_i"), F.lit(before)) + F.least(F.col("_left"), F.lit(after))
    marks = marks.filter(size >= before + 1).withColumnsRenamed({"date": "signal_date", "_i": "_at"}).drop("_left")
    probe = marks.withColumn("_bucket", F.explode(F.array_distinct(F.array(
        F.floor((F.col("_at") - before) / width), F.floor((F.col("_at") + after - 1) / width)))))
    bars = idx.withColumn("_bucket", F.floor(F.col("_i") / width)).drop("_left")
    met = probe.join(bars, ["code", "_bucket"]).filter(
        (F.col("_i") >= F.col("_at") - before) & (F.col("_i") < F.col("_at") + after))
    return met.withColumn("offset", F.col("_i") - F.col("_at")).drop("_bucket", "_i", "_at")


def window_marks(windows: DataFrame, keys: list[str], target_multiple: float) -> DataFrame:
    """Per signal window: entry price, target price, position of the signal, first bar to touch the target."""
    got = windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("window_bars"), (-F.min("offset")).alias("signal_pos"),
        F.max(F.when(F.col("offset") == 1, F.col("open"))).alias("entry"),
        F.sort_array(F.collect_list(F.when(F.col("offset") >= 1, F.struct("offset", "high")))).alias("_path"))
    target = F.col("entry") * target_multiple
    # The path holds one window's bars, at most the bars after a signal.
    return got.withColumns({"target": target, "first_touch": F.get(F.transform(
        F.filter("_path", lambda b: b["high"] >= target), lambda b: b["offset"]), F.lit(0))}).drop("_path")
