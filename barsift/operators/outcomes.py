"""Forward outcomes: what happened after each bar, with unresolved rows left unknown."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import over_eps
from ..functions.fixed import REGIMES
from ..functions.windows import back, forward_extreme, seq, span

# Horizons up to this many bars find the first hit inside the window's own array.
_ARRAY_HORIZON = 64


def _first_hit_in_array(target: Column, horizon: int) -> Column:
    """Fold over the next bars: position of the first strict exceed and the low up to it."""
    path = F.collect_list(F.struct("high", "low")).over(span(1, horizon))
    start = F.struct(
        F.lit(0).alias("at"), F.lit(None).cast("int").alias("hit"), F.lit(None).cast("double").alias("low"))

    def step(acc, bar):
        low = F.least(acc["low"], bar["low"])
        now = acc["at"] + 1
        open_ = acc["hit"].isNull()
        return F.struct(
            now.alias("at"),
            F.when(open_ & (bar["high"] > target), now).otherwise(acc["hit"]).alias("hit"),
            F.when(open_, low).otherwise(acc["low"]).alias("low"))

    return F.aggregate(path, start, step, lambda a: F.struct(
        a["hit"].alias("hit"), F.when(a["hit"].isNotNull(), a["low"]).alias("low")))


def _first_hit_by_blocks(df: DataFrame, horizon: int) -> DataFrame:
    """Long horizons: the bar of the first strict exceed and the low up to it, for rows that do reach the target.

    The history is cut into blocks of about the root of ``horizon`` bars. A row reads its own block, the extremes of the
    blocks ahead, and the one block that holds the hit: three roots of the horizon, and never a row per pair of bars. A
    block holds its rows and the blocks that they may look into, so nothing is joined.
    """
    size = math.isqrt(horizon - 1) + 1
    bar = F.struct("_seq", "high", "low")
    cut = df.withColumn("_b", F.floor(F.col("_seq") / size))
    blocks = cut.groupBy("code", "_b").agg(
        F.max("high").alias("_top"), F.min("low").alias("_bottom"), F.sort_array(F.collect_list(bar)).alias("_bars"),
        F.collect_list(F.struct(*[c for c in df.columns if c != "code"])).alias("_rows"))
    later = Window.partitionBy("code").orderBy("_b").rowsBetween(1, horizon // size + 1)
    blocks = blocks.withColumn("_next", F.collect_list(F.struct("_b", "_top", "_bottom", "_bars")).over(later))

    def lows(bars: Column, first: Column, last: Column) -> Column:
        return F.array_min(F.transform(F.filter(bars, lambda y: (y["_seq"] > first) & (y["_seq"] <= last)), lambda y: y["low"]))

    def reached(r: Column) -> Column:
        """The first hit of a row, as (at, low)."""
        def over(y: Column) -> Column:
            return (y["_seq"] > r["_seq"]) & (y["high"] > r["_target"])

        def ending(at: Column, ahead: Column) -> Column:
            return F.struct(at.alias("at"), F.least(lows(F.col("_bars"), r["_seq"], at), ahead).alias("low"))

        near = F.get(F.filter("_bars", over), F.lit(0))["_seq"]
        block = F.get(F.filter("_next", lambda x: x["_top"] > r["_target"]), F.lit(0))
        between = F.array_min(F.transform(F.filter("_next", lambda x: x["_b"] < block["_b"]), lambda x: x["_bottom"]))
        far = F.get(F.filter(block["_bars"], over), F.lit(0))["_seq"]
        return F.when(r["_reach"], F.when(near.isNotNull(), ending(near, F.lit(None).cast("double"))).otherwise(
            ending(far, F.least(between, lows(block["_bars"], r["_seq"], far)))))

    hits = blocks.select("code", F.explode(F.transform("_rows", lambda r: F.struct(r.alias("r"), reached(r).alias("h")))).alias("_x"))
    return hits.select("code", "_x.r.*", F.col("_x.h.at").alias("_hit_at"), F.col("_x.h.low").alias("_hit_low"))


def forward_outcomes(panel: DataFrame, horizon: int, target_return: float | None = None,
                     target_multiple: float = 4.0, floor_ratio: float = 0.8) -> DataFrame:
    """Labels of every bar for one horizon, target and floor.

    Entry is the next open. The target must be exceeded strictly; the floor may be touched. A
    row with fewer than ``horizon`` later bars has no label, whatever its partial path shows.
    """
    growth = target_multiple if target_return is None else 1.0 + target_return
    df = panel.withColumns({"entry_open": back("open", -1), "_seq": seq()}).withColumn(
        "_target", F.col("entry_open") * F.lit(growth))
    if horizon <= _ARRAY_HORIZON:
        ahead = span(1, horizon)
        df = df.withColumns({
            "future_bars": F.count("high").over(ahead),
            "_fh": F.max("high").over(ahead),
            "_fl": F.min("low").over(ahead),
            "_hit": _first_hit_in_array(F.col("_target"), horizon)})
        df = df.withColumns({"_hit_bars": F.col("_hit.hit"), "_hit_low": F.col("_hit.low")})
    else:
        # Linear in the history: extremes by blocks, and running values from the end of the
        # history for the tail that has fewer bars left than the horizon.
        df = forward_extreme(df, {"_fh": ("high", "max"), "_fl": ("low", "min")}, horizon)
        rest = Window.partitionBy("code").orderBy(F.desc("date")).rowsBetween(
            Window.unboundedPreceding, -1)
        df = df.withColumns({
            "_left": F.count("high").over(rest), "_rh": F.max("high").over(rest),
            "_rl": F.min("low").over(rest)})
        df = df.withColumn("future_bars", F.col("_left") - F.coalesce(back("_left", -horizon), F.lit(0)))
        df = df.withColumns({
            "_fh": F.coalesce("_fh", F.when(F.col("future_bars") < horizon, F.col("_rh"))),
            "_fl": F.coalesce("_fl", F.when(F.col("future_bars") < horizon, F.col("_rl")))})
        df = df.withColumn("_reach", F.coalesce(F.col("_fh") > F.col("_target"), F.lit(False)))
        df = _first_hit_by_blocks(df, horizon)
        df = df.withColumn("_hit_bars", (F.col("_hit_at") - F.col("_seq")).cast("int"))
    resolved = (F.col("future_bars") >= horizon) & F.col("entry_open").isNotNull()
    entry = F.col("entry_open")
    gate = F.coalesce("_hit_low", "_fl")
    bull = F.when(resolved, (F.col("_fh") > F.col("_target")).cast("int"))
    held = F.when(resolved, (gate >= F.lit(floor_ratio) * entry).cast("int"))
    df = df.withColumns({
        "forward_max_return": over_eps(F.col("_fh"), entry) - 1.0,
        "forward_min_return": over_eps(F.col("_fl"), entry) - 1.0,
        "bars_to_target": F.col("_hit_bars"),
        "label_bull": bull,
        "label_strict_low": held,
        "label_joint": F.when(bull.isNotNull() & held.isNotNull(), F.least(bull, held)),
        "label_resolved": resolved,
    })
    return df.drop("_seq", "_target", "_fh", "_fl", "_hit", "_hit_bars", "_hit_low", "_hit_at", "_reach",
                   "_left", "_rh", "_rl")


OUTCOME_COLUMNS = (
    "entry_open", "future_bars", "forward_max_return", "forward_min_return", "bars_to_target",
    "label_bull", "label_strict_low", "label_joint", "label_resolved")


def outcomes_by_regime(panel: DataFrame, regimes: dict | None = None) -> DataFrame:
    """All regimes side by side, each column suffixed ``__regime``; one shuffle on code."""
    out = panel
    # The longest horizon nests its rows in blocks, so it goes first while they are still narrow.
    for name, (horizon, target, floor) in sorted(
            (regimes or REGIMES).items(), key=lambda r: -r[1][0]):
        out = forward_outcomes(out, horizon, target_return=target, floor_ratio=floor)
        out = out.withColumnsRenamed({c: f"{c}__{name}" for c in OUTCOME_COLUMNS})
        out = out.withColumn(f"horizon__{name}", F.lit(horizon))
    return out


def long_outcomes(wide: DataFrame, keys: list[str], regimes: dict | None = None,
                  columns: tuple[str, ...] = OUTCOME_COLUMNS) -> DataFrame:
    """Suffixed regimes to one row per key and regime."""
    rows = F.array(*[
        F.struct(F.lit(r).alias("regime"), *[F.col(f"{c}__{r}").alias(c) for c in columns])
        for r in (regimes or REGIMES)])
    return wide.select(*keys, F.explode(rows).alias("_o")).select(*keys, "_o.*")


def close_outcomes(panel: DataFrame, horizon: int, target_return: float) -> DataFrame:
    """Label on closes instead of highs; a missing or non-positive entry leaves it unknown."""
    df = panel.withColumns({
        "entry_open": back("open", -1),
        "_n": F.count("close").over(span(1, horizon)),
        "_fc": F.max("close").over(span(1, horizon))})
    usable = (F.col("_n") >= horizon) & (F.col("entry_open") > 0)
    return df.withColumns({
        "fwd_max_close": F.when(usable, F.col("_fc") / F.col("entry_open") - 1.0),
        "label_close": F.when(
            usable, (F.col("_fc") > F.col("entry_open") * F.lit(1.0 + target_return)).cast("int")),
        "entry_state": F.when(F.col("entry_open").isNull(), "no_entry")
        .when(F.col("entry_open") <= 0, "bad_entry").otherwise("ok"),
    }).drop("_n", "_fc")


def realised_return(panel: DataFrame, horizon: int) -> DataFrame:
    """Return from the next open to the close ``horizon`` bars after the signal."""
    df = panel.withColumns({"entry_open": back("open", -1), "exit_close": back("close", -horizon)})
    return df.select(
        "code", "date", "entry_open", "exit_close",
        F.when(F.col("entry_open") > 0, F.col("exit_close") / F.col("entry_open") - 1.0).alias("return_h"))
