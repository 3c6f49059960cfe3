"""Walk-forward folds, purging, and rule-based choices made on earlier sessions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import session_index
from .crosssec import top_k
from .scoring import ratio



def folds(rows: DataFrame, n_folds: int = 5, horizon: int = 10, embargo: int = 2,
          min_train_sessions: int = 120, holdout_start: str | None = None) -> DataFrame:
    """Expanding folds over the distinct sessions: one row per fold, role and date.

    Test blocks split the sessions after the warm-up evenly; training ends ``horizon + embargo``
    sessions before the block. Folds with too short a training block are dropped. Everything
    here is one row per session and fold.
    """
    days = rows.select("date").distinct()
    if holdout_start is not None:
        days = days.filter(F.col("date") < F.lit(holdout_start).cast("date"))
    idx = session_index(days)
    everyone = Window.partitionBy(F.lit(0))
    usable = F.count(F.lit(1)).over(everyone) - min_train_sessions
    placed = idx.withColumn("_u", usable).filter(F.col("_u") >= n_folds)
    blocks = placed.select("date", "session_id", "_u", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    start = F.lit(min_train_sessions) + F.floor(F.col("fold") * F.col("_u") / n_folds)
    stop = F.lit(min_train_sessions) + F.floor((F.col("fold") + 1) * F.col("_u") / n_folds)
    safe = start - (horizon + embargo)
    role = F.when((F.col("session_id") >= start) & (F.col("session_id") < stop), "test").when(
        F.col("session_id") < safe, "train")
    return blocks.filter(safe >= min_train_sessions).withColumn("role", role).filter(
        "role is not null").select("fold", "role", "date")


def fold_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their fold and role; the plan has one row per session and fold."""
    return rows.join(plan, "date")


def fold_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("sessions"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def purge_by_label_end(rows: DataFrame, cutoff: str, horizon: int) -> DataFrame:
    """Rows marked train, purged or test so that no training label reaches the cutoff."""
    day = F.lit(cutoff).cast("date")
    before = session_index(rows.select("date").filter(F.col("date") < day))
    safe = before.withColumn("_last", F.max("session_id").over(Window.partitionBy(F.lit(0)))).filter(
        F.col("session_id") == F.col("_last") - horizon).select(F.col("date").alias("_safe"))
    return rows.join(F.broadcast(safe), how="left").withColumn(
        "role", F.when(F.col("date") >= day, "test").when(F.col("date") <= F.col("_safe"), "train").otherwise("purged")
    ).drop("_safe")


def boundary_leaks(rows: DataFrame, cutoff: str, horizon: int) -> DataFrame:
    """Rows dated before the cutoff whose label window ends at or after it, per role."""
    marked = purge_by_label_end(rows, cutoff, horizon)
    idx = session_index(rows)
    first_test = idx.filter(F.col("date") >= F.lit(cutoff).cast("date")).agg(F.min("session_id").alias("_first"))
    ends = marked.join(idx, "date").join(F.broadcast(first_test))
    return ends.filter("role <> 'test'").groupBy("role").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.col("session_id") + horizon >= F.col("_first")).cast("int")).alias("label_end_in_test"))


def fold_precision(scored: DataFrame, picks: DataFrame, keys: list[str], label: str = "y") -> DataFrame:
    """Per fold: test rows, positives, base rate, and the signals and precision of the picks."""
    base = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(label).alias("positives"), F.avg(label).alias("base_rate"))
    got = picks.groupBy(*keys).agg(F.count(F.lit(1)).alias("signals"), F.avg(label).alias("precision"))
    return base.join(got, keys, "left").na.fill(0, ["signals"])


def choose_k(train: DataFrame, k_grid: list[int], n_folds: int = 3, purge: int = 12, min_train: int = 150,
             min_rows: int = 200, min_signals: int = 40, label: str = "y", score: str = "score",
             fallback: int = 5) -> DataFrame:
    """K with the best pooled precision over inner blocks of the training sessions.

    Blocks without enough earlier sessions or rows do not vote; the smaller K wins a tie; with
    no eligible K the fallback is returned.
    """
    idx = session_index(train)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    blocks = idx.withColumn("_n", n).withColumn("block", F.least(
        F.lit(n_folds - 1), F.ceil((F.col("session_id") + 1) * n_folds / F.col("_n")) - 1))
    start = F.floor(F.col("block") * F.col("_n") / n_folds)
    voters = blocks.filter(start - purge >= min_train).select("date", "block")
    rows = train.join(voters, "date")
    enough = rows.groupBy("block").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= min_rows).select("block")
    ranked = top_k(rows.join(enough, "block"), max(k_grid), score)
    per = ranked.select(F.explode(F.array(*[F.lit(k) for k in k_grid])).alias("k"), "rank", label).filter(
        F.col("rank") < F.col("k")).groupBy("k").agg(
        F.count(F.lit(1)).alias("n_signals"), F.avg(label).alias("precision"))
    best = per.filter(F.col("n_signals") >= min_signals).agg(
        F.max(F.struct("precision", (-F.col("k")).alias("_k"), "n_signals")).alias("_b"))
    return best.select(
        F.coalesce(-F.col("_b._k"), F.lit(fallback)).alias("k"), F.col("_b.n_signals").alias("n_signals"),
        F.col("_b.precision").alias("precision"),
        F.when(F.col("_b").isNull(), "no grid point reached the signal floor").otherwise(
            "best inner precision").alias("reason"))


def search_ranking(results: DataFrame, min_signals: int, min_folds: int) -> DataFrame:
    """Configurations eligible by signals and folds, best pooled precision first."""
    return results.filter((F.col("oos_signals") >= min_signals) & (F.col("n_folds") >= min_folds)).orderBy(
        F.desc("oos_precision"), "config")


def lift_over(results: DataFrame) -> DataFrame:
    return results.withColumn("lift", ratio("oos_precision", "oos_base_rate"))
