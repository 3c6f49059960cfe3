"""Hit rates, base rates, concentration, returns and agreement over signal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import over_eps, price_limit, wilson
from ..functions.fixed import COOLDOWN, COST_BPS, LIMIT_TOLERANCE, MIN_HISTORY, STRIDE, Z_EXACT
from ..functions.windows import back
from ..session import staged
from .cooldown import dedupe
from .outcomes import realised_return
from .ranking import average_rank, cumulative, quantiles



def ratio(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a / b)


def population_id(population: str, stride: int = STRIDE, min_history: int = MIN_HISTORY) -> str:
    return f"{population}_stride{stride}_minhist{min_history}"


def base_rates(rows: DataFrame, keys: list[str], population: str = "scanned",
               stride: int = STRIDE, min_history: int = MIN_HISTORY) -> DataFrame:
    """Natural rates over the resolved rows of a population, stamped with its id."""
    got = rows.filter("label_resolved").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluated_points"), F.sum("label_bull").alias("bull"),
        F.sum("label_joint").alias("joint"), F.avg("label_strict_low").alias("strict_low_rate"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    return got.withColumns({
        "bull_rate": ratio("bull", "evaluated_points"),
        "joint_rate": ratio("joint", "evaluated_points"),
        "population_id": F.lit(population_id(population, stride, min_history))})


def tier_rates(rows: DataFrame, tier: str = "recall_tier", top: int = 5) -> list[Column]:
    """Label rate among rows of at least each tier."""
    return [F.avg(F.when(F.col(tier) >= k, F.col("label_bull"))).alias(f"rate_tier_{k}")
            for k in range(1, top + 1)]


def _block(rows: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    got = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"signals_{suffix}"),
        F.sum(F.coalesce("label_bull", F.lit(0))).alias(f"bull_hits_{suffix}"),
        F.sum(F.coalesce("label_joint", F.lit(0))).alias(f"joint_hits_{suffix}"),
        F.sum(F.coalesce("label_strict_low", F.lit(0))).alias(f"_low_{suffix}"),
        F.countDistinct("code").alias("distinct_stocks"), F.countDistinct("date").alias("distinct_dates"))
    n = F.col(f"signals_{suffix}")
    return got.withColumns({
        f"bull_precision_{suffix}": F.col(f"bull_hits_{suffix}") / n,
        f"joint_precision_{suffix}": F.col(f"joint_hits_{suffix}") / n,
        f"strict_low_rate_{suffix}": F.col(f"_low_{suffix}") / n}).drop(f"_low_{suffix}")


def date_concentration(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of squared date shares; 1 means everything happened on one date."""
    per_date = rows.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("_n"))
    got = per_date.groupBy(*keys).agg(
        F.sum(F.col("_n").cast("double") * F.col("_n")).alias("_sq"), F.sum("_n").alias("_all"))
    return got.select(*keys, (F.col("_sq") / (F.col("_all").cast("double") * F.col("_all"))).alias(
        "hhi_date_concentration"))


def hit_rates(signals: DataFrame, keys: list[str], cooldown: int = COOLDOWN) -> DataFrame:
    """Raw and de-duplicated hit report per key. Unresolved signals are counted, never scored.

    Signals and events feed several aggregates, so each is written once and read back.
    """
    signals = staged(signals.select(
        *keys, "code", "date", "label_bull", "label_joint", "label_strict_low", "label_resolved"))
    raw_n = signals.groupBy(*keys).agg(
        F.sum((~F.col("label_resolved")).cast("int")).alias("censored_signals"))
    live = signals.filter("label_resolved")
    events = staged(dedupe(live.drop("label_resolved"), cooldown, keys))
    raw = _block(live, keys, "raw").select(
        *keys, "signals_raw", "bull_hits_raw", "bull_precision_raw")
    deduped = _block(events, keys, "deduped")
    out = raw_n.join(raw, keys, "left").join(deduped, keys, "left").join(
        date_concentration(events, keys), keys, "left")
    out = out.na.fill(0, ["signals_raw", "signals_deduped", "bull_hits_raw", "bull_hits_deduped",
                          "joint_hits_deduped", "distinct_stocks", "distinct_dates"])
    bl, bh = wilson(F.col("bull_hits_deduped"), F.col("signals_deduped"))
    jl, jh = wilson(F.col("joint_hits_deduped"), F.col("signals_deduped"))
    return out.withColumns({
        "bull_wilson_low": bl, "bull_wilson_high": bh, "joint_wilson_low": jl, "joint_wilson_high": jh})


def with_lift(report: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Precision over the base rate of the same population; the id is part of the join."""
    side = base.select(*keys, "population_id", F.col("bull_rate").alias("baseline"))
    return report.join(side, [*keys, "population_id"], "left").withColumn(
        "lift", ratio("bull_precision_deduped", "baseline"))


def tradeability(signals: DataFrame, panel: DataFrame) -> DataFrame:
    """Could the next open be bought: gap, open at the limit, one-price board, no next bar."""
    nxt = panel.select("code", "date", "close", *[
        back(c, -1).alias(f"next_{c}") for c in ("open", "high", "low", "close", "volume")])
    df = signals.join(nxt, ["code", "date"], "left")
    df = df.withColumn("gap_pct", over_eps(F.col("next_open"), F.col("close")) - 1.0)
    at_limit = F.coalesce(F.col("gap_pct") >= price_limit("code") - LIMIT_TOLERANCE, F.lit(False))
    flat = (F.abs(F.col("next_high") - F.col("next_open")) < 1e-9) & (
        F.abs(F.col("next_low") - F.col("next_open")) < 1e-9)
    no_bar = F.col("next_open").isNull() | (F.coalesce("next_volume", F.lit(0.0)) <= 0)
    return df.withColumns({
        "open_at_limit": at_limit, "one_word_limit": at_limit & F.coalesce(flat, F.lit(False)),
        "no_next_bar": no_bar, "unfillable": at_limit | no_bar})


def tradeability_report(audited: DataFrame, key: str = "strategy_id") -> DataFrame:
    """Per key and overall (one rollup): resolved, hits, unfillable share, tradeable hit rate."""
    def total(cond: Column) -> Column:
        return F.sum(cond.cast("int"))

    live = F.col("label_resolved")
    hit = F.coalesce(F.col("label_bull") == 1, F.lit(False))
    got = audited.rollup(key).agg(
        F.count(F.lit(1)).alias("signals_raw"), total(live).alias("signals"), total(~live).alias("censored"),
        total(live & hit).alias("hits"), total(live & F.col("unfillable")).alias("unfillable"),
        total(live & F.col("one_word_limit")).alias("one_word_limit"),
        total(live & F.col("open_at_limit")).alias("gapped_at_limit"),
        total(live & F.col("no_next_bar")).alias("no_next_bar"),
        total(live & ~F.col("unfillable")).alias("tradeable_signals"),
        total(live & hit & ~F.col("unfillable")).alias("tradeable_hits"))
    return got.withColumn("label", F.coalesce(key, F.lit("ALL"))).drop(key).withColumns({
        "hit_rate": ratio("hits", "signals"), "unfillable_pct": ratio("unfillable", "signals"),
        "tradeable_hit_rate": ratio("tradeable_hits", "tradeable_signals")})


def holding_report(signals: DataFrame, panel: DataFrame, horizon: int, keys: list[str],
                   cost_bps: float = COST_BPS) -> DataFrame:
    """Gross and net realised return per key, with exact median and tail quantiles."""
    cost = cost_bps / 10_000.0
    got = signals.join(realised_return(panel, horizon), ["code", "date"], "left")
    net = F.col("return_h") - cost
    means = got.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("signals"), F.count("return_h").alias("resolved"),
        F.avg("return_h").alias("gross_mean_return"), F.avg(net).alias("net_mean_return"),
        F.avg((net > 0).cast("int")).alias("net_win_rate"))
    q = quantiles(got, keys, "return_h", {"_p10": 0.10, "_p50": 0.50, "_p90": 0.90})
    return means.join(q, keys, "left").select(
        *keys, "signals", "resolved", "gross_mean_return", F.col("_p50").alias("gross_median_return"),
        "net_mean_return", (F.col("_p50") - cost).alias("net_median_return"), "net_win_rate",
        (F.col("_p10") - cost).alias("net_p10"), (F.col("_p90") - cost).alias("net_p90"),
        F.lit(horizon).alias("horizon_sessions"), F.lit(cost_bps).alias("cost_bps_round_trip"))


def expectancy_report(signals: DataFrame, panel: DataFrame, horizon: int, target: float, keys: list[str],
                      cost_bps: float = COST_BPS) -> DataFrame:
    """Hit rate beside what the signals earned, held to the horizon or sold at the target."""
    cost = cost_bps / 10_000.0
    got = signals.join(realised_return(panel, horizon), ["code", "date"]).filter("return_h is not null")
    hit = F.coalesce(F.col("label_bull") == 1, F.lit(False))
    r = F.col("return_h")
    net = r - cost
    means = got.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("signals"), F.avg(hit.cast("int")).alias("hit_rate"),
        F.avg(net).alias("net_expectancy"), F.avg((net > 0).cast("int")).alias("net_win_rate"),
        F.avg(F.when(hit, F.lit(target) - cost).otherwise(net)).alias("net_expectancy_at_target"),
        F.avg(F.when(hit, r)).alias("mean_return_if_hit"), F.avg(F.when(~hit, r)).alias("mean_return_if_miss"),
        F.avg(F.when(hit, (r <= cost).cast("int"))).alias("pct_hits_that_did_not_beat_cost"))
    q = quantiles(got, keys, "return_h", {"_p50": 0.50})
    return means.join(q, keys, "left").withColumn("net_median", F.col("_p50") - cost).drop("_p50")


def spearman(df: DataFrame, group: list[str], a: str, b: str, out: str = "rho") -> DataFrame:
    """Correlation of average ranks over the rows where both values are known."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c in (a, b):
        ranks = cumulative(rows, group, [c])
        rows = rows.join(ranks.select(*group, c, average_rank(ranks).alias(f"_rank_{c}")), [*group, c])
    return rows.groupBy(*group).agg(F.corr(f"_rank_{a}", f"_rank_{b}").alias(out), F.count(F.lit(1)).alias("n"))


def confusion(scored: DataFrame, keys: list[str], predicted: str = "prediction", actual: str = "actual",
              z: float = Z_EXACT) -> DataFrame:
    """Confusion counts and rates of binary predictions; rows with an unknown side are errors."""
    p, a = F.col(predicted), F.col(actual)

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(cond.cast("int")), F.lit(0))

    got = scored.groupBy(*keys).agg(
        total((p == 1) & (a == 1)).alias("tp"), total((p == 0) & (a == 0)).alias("tn"),
        total((p == 1) & (a == 0)).alias("fp"), total((p == 0) & (a == 1)).alias("fn"),
        total(p.isNull() | a.isNull()).alias("errors"))
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    right = F.col("tp") + F.col("tn")
    low, high = wilson(right, n, z)
    return got.withColumns({
        "samples": n, "accuracy": ratio(right, n),
        "positive_recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "yes_precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "yes_predictions": F.col("tp") + F.col("fp"),
        "yes_rate": ratio(F.col("tp") + F.col("fp"), n),
        "accuracy_low": low, "accuracy_high": high})


def disagreement(decisions: DataFrame, sample: list[str], names: list[str]) -> DataFrame:
    """Share of samples on which two strategies differ, for every pair.

    Each sample becomes one word of flags (yes, no or unknown). Equal words are counted first, so the
    pairs are formed once per different word and never per sample.
    """
    wide = decisions.groupBy(*sample).agg(*[
        F.max(F.when(F.col("strategy_id") == n, F.col("prediction"))).alias(n) for n in names])
    flags = F.concat(*[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in names])
    words = wide.groupBy(flags.alias("word")).agg(F.count(F.lit(1)).alias("_w"))
    pairs = F.array(*[F.struct(F.lit(x).alias("strategy_a"), F.lit(y).alias("strategy_b"), F.lit(i).alias("i"), F.lit(j).alias("j"))
                      for i, x in enumerate(names) for j, y in enumerate(names) if i < j])
    of = words.select("word", "_w", F.explode(pairs).alias("_p")).select(
        "_w", "_p.strategy_a", "_p.strategy_b", *[F.substring("word", F.col(f"_p.{k}") + 1, F.lit(1)).alias(k) for k in "ij"])
    both = (F.col("i") != "-") & (F.col("j") != "-")
    n = F.sum(F.when(both, F.col("_w")).otherwise(0))
    return of.groupBy("strategy_a", "strategy_b").agg(
        n.alias("samples"), ratio(F.sum(F.when(both & (F.col("i") != F.col("j")), F.col("_w")).otherwise(0)), n).alias("disagreement"))


def concentration(signals: DataFrame, keys: list[str], hit: str = "hit") -> DataFrame:
    """How much of a result hangs on few dates, from one row per date."""
    per_date = signals.groupBy(*keys, "date").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(hit).cast("double").alias("_h"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    d = per_date.withColumns({"_tn": F.sum("_n").over(whole), "_th": F.sum("_h").over(whole)})
    d = d.withColumns({
        "_share": F.col("_n") / F.col("_tn"), "_p": F.col("_h") / F.col("_n"),
        "_loo": ratio(F.col("_th") - F.col("_h"), F.col("_tn") - F.col("_n")),
        # Ties on the count go to the later date.
        "_busy": F.struct("_n", "date", "_h")})
    got = d.groupBy(*keys).agg(
        F.sum("_n").alias("n_signals"), F.count(F.lit(1)).alias("n_distinct_dates"),
        F.sum(F.col("_share") * F.col("_share")).alias("herfindahl_dates"),
        F.max("_share").alias("max_date_share"), F.max("_busy").alias("_b"), F.sum("_h").alias("_hits"),
        F.min("_loo").alias("precision_drop_worst_date"), F.max("_loo").alias("precision_drop_best_date"),
        F.avg("_p").alias("mean_daily_precision"),
        F.avg((F.col("_p") > F.col("_th") / F.col("_tn")).cast("int")).alias("share_dates_above_base"))
    # One row per date: the exact median of a calendar-sized group.
    med = d.groupBy(*keys).agg(F.percentile("_p", 0.5).alias("median_daily_precision"))
    stocks = signals.groupBy(*keys).agg(F.countDistinct("code").alias("n_distinct_stocks"))
    joined = (got.join(med, keys).join(stocks, keys) if keys else
              got.join(F.broadcast(med)).join(F.broadcast(stocks)))
    return joined.withColumns({
        "effective_dates": 1.0 / F.col("herfindahl_dates"),
        "busiest_date": F.col("_b.date"), "busiest_date_signals": F.col("_b._n"),
        "busiest_date_precision": F.col("_b._h") / F.col("_b._n"),
        "precision_drop_busiest_date": ratio(
            F.col("_hits") - F.col("_b._h"), F.col("n_signals") - F.col("_b._n")),
        "precision_drop_busiest_n": F.col("n_signals") - F.col("_b._n")}).drop("_b", "_hits")


def by_date(rows: DataFrame, calendar: DataFrame | None = None, hit: str = "hit") -> DataFrame:
    """Signals and hits of every market date; calendar dates without a signal count as zero."""
    got = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"))
    if calendar is None:
        return got
    return calendar.select("date").distinct().join(got, "date", "left").na.fill(0, ["n", "hits"])


def drop_top_dates(rows: DataFrame, drops: list[int], hit: str = "hit") -> DataFrame:
    """Precision left after removing the busiest dates; ties on the count go to the earlier date."""
    ranked = by_date(rows, hit=hit).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "date")))
    got = ranked.agg(*[f for k in drops for f in (
        F.sum(F.when(F.col("_rank") > k, F.col("n"))).alias(f"n{k}"),
        F.sum(F.when(F.col("_rank") > k, F.col("hits"))).alias(f"h{k}"))])
    rows_ = F.array(*[F.struct(
        F.lit(k).alias("dropped"), F.coalesce(f"n{k}", F.lit(0)).alias("signals"),
        ratio(f"h{k}", f"n{k}").alias("precision")) for k in drops])
    return got.select(F.explode(rows_).alias("_d")).select("_d.*")


def pool_folds(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Fold results to ratio-of-sums rates beside the two other averages of the base rate.

    Input per fold: n_test, positives, base_rate, signals, precision. Folds without a signal or
    with an unknown precision leave the pool.
    """
    ok = folds.filter("signals > 0 and precision is not null")
    got = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), F.sum("signals").alias("oos_signals"),
        F.sum(F.col("precision") * F.col("signals")).alias("_hits"),
        F.sum("positives").alias("_pos"), F.sum("n_test").alias("_rows"),
        F.sum(F.col("base_rate") * F.col("signals")).alias("_bs"),
        F.avg("base_rate").alias("oos_base_rate_unweighted"),
        F.sum((F.col("precision") > F.col("base_rate")).cast("int")).alias("folds_above_base"))
    out = got.withColumns({
        "oos_precision": ratio("_hits", "oos_signals"), "oos_base_rate": ratio("_pos", "_rows"),
        "oos_base_rate_by_signals": ratio("_bs", "oos_signals")})
    return out.withColumns({
        "oos_lift": ratio("oos_precision", "oos_base_rate"),
        "oos_base_rate_max_abs_diff": F.greatest(
            F.abs(F.col("oos_base_rate_by_signals") - F.col("oos_base_rate")),
            F.abs(F.col("oos_base_rate_unweighted") - F.col("oos_base_rate")))}
    ).drop("_hits", "_pos", "_rows", "_bs")


def weighted_precision(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Signal-weighted mean precision over folds that have one."""
    ok = folds.filter("signals > 0 and precision is not null")
    return ok.groupBy(*keys).agg(
        F.sum("signals").alias("n_signals"), F.count(F.lit(1)).alias("n_folds"),
        (F.sum(F.col("precision") * F.col("signals")) / F.sum("signals")).alias("precision"))
