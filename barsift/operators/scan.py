"""The strategy scan: every rule on every grid bar in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CARD_BARS, MIN_HISTORY, STRIDE
from .strategies import Strategies, components, rule, score, with_primitives


def grid_rows(panel: DataFrame, stride: int = STRIDE, min_history: int = MIN_HISTORY) -> DataFrame:
    """Grid bars with primitives: windows see the full history, the grid filter comes after.

    A bar needs a full card behind it, so a smaller ``min_history`` admits no shorter one.
    """
    return with_primitives(panel).filter(
        (F.col("seq") >= min_history) & (F.col("seq") % stride == 0) & (F.col("seq") + 1 >= CARD_BARS))


def scored(rows: DataFrame, strategies: Strategies | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Grid bars with one score column per distinct rule; the primitives end here."""
    todo = strategies or Strategies()
    return rows.select("code", "date", *keep, *[s.alias(n) for n, s in todo.scores().items()])


def decisions(rows: DataFrame, strategies: Strategies | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Long decision table: one row per bar and strategy. An unknown score is an unknown decision.

    ``rows`` are grid bars with primitives, or already scored ones.
    """
    return _long(rows, strategies, keep, lambda parts: parts)


def signals(rows: DataFrame, strategies: Strategies | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The positive decisions alone: each bar's decisions are filtered before they become rows."""
    return _long(rows, strategies, keep, lambda parts: F.filter(parts, lambda d: d["score"] >= d["threshold"]))


def _long(rows: DataFrame, strategies: Strategies | None, keep: tuple[str, ...], which) -> DataFrame:
    todo = strategies or Strategies()
    have = all(s in rows.columns for _, s, _ in todo.cutoffs())
    table = rows if have else scored(rows, todo, keep)
    parts = F.array(*[
        F.struct(F.lit(n).alias("strategy_id"), F.col(s).alias("score"), F.lit(cut).alias("threshold"))
        for n, s, cut in todo.cutoffs()])
    out = table.select("code", "date", *keep, F.explode(which(parts)).alias("_d"))
    return out.select(
        "code", "date", *keep, "_d.strategy_id", "_d.score", "_d.threshold",
        (F.col("_d.score") >= F.col("_d.threshold")).cast("int").alias("prediction"))


def decision(panel: DataFrame, name: str, stride: int = STRIDE, min_history: int = MIN_HISTORY) -> DataFrame:
    """One strategy on the grid, with its components as a map."""
    base, cut = rule(name)
    parts = components(base)
    pairs = [x for k, v in parts.items() for x in (F.lit(k), v)]
    return grid_rows(panel, stride, min_history).select(
        "code", "date", score(base).alias("score"), F.create_map(*pairs).alias("components")).select(
        "code", "date", F.lit(name).alias("strategy_id"), "score", F.lit(cut).alias("threshold"),
        (F.col("score") >= cut).cast("int").alias("prediction"), "components")


def emitted(all_decisions: DataFrame) -> DataFrame:
    """Signals: only positive decisions leave the scan."""
    return all_decisions.filter("prediction = 1")


def decision_errors(all_decisions: DataFrame) -> DataFrame:
    """Scored and unscored bars per strategy; an unscored bar is an error, never a negative."""
    return all_decisions.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("cards"),
        F.count("score").alias("scored"),
        F.sum(F.col("score").isNull().cast("int")).alias("errors"),
        F.sum(F.coalesce("prediction", F.lit(0))).alias("signals"))
