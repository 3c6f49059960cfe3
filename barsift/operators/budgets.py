"""Selection rules by budget: five families judged on the same ranked rows, fold by fold and pooled.

Rows are ranked once a session and once a fold. A rule with a budget is then a bound on one of four positions (rank in the
session, percentile in the session, score, place in the fold), so all rules are one small table beside the ranked rows, and
a row is handed on once for each bound that it meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import wilson
from ..session import staged
from .crosssec import session_percentile, session_rank
from .inference import date_totals, replicates
from .ranking import cumulative, row_numbers
from .scoring import ratio

TOP, PERCENTILE, SAME_RATE = "session_top_k", "session_percentile", "global_same_rate"
GLOBAL, ORACLE, MATCHED = "global_threshold", "matched_oracle", "matched_train_threshold"
IN_TOP, IN_GLOBAL = "insample_top_k", "insample_threshold"


def rules(ks: list[int], qs: list[float], rate: float) -> list[tuple[str, float]]:
    """(rule, budget) pairs judged on test rows."""
    return [*((r, float(k)) for r in (TOP, ORACLE, MATCHED) for k in ks), *((r, q) for r in (PERCENTILE, SAME_RATE) for q in qs), (GLOBAL, rate)]


def _thresholds(train: DataFrame, asked: DataFrame) -> DataFrame:
    """(fold, rule, budget, bound): the score of the best share ``rate`` of a fold's training rows, for all asked at once."""
    size = train.groupBy("fold").agg(F.count(F.lit(1)).alias("_rows"), F.count("score").alias("_known"))
    wanted = asked.join(size, "fold").withColumn("_k", F.least(F.col("_known"), F.greatest(
        F.lit(1), F.bround(F.col("_rows") * F.col("rate")).cast("bigint"))))
    dist = cumulative(train.filter("score is not null"), ["fold"], ["score"])
    # A few bounds a fold.
    reach = dist.join(F.broadcast(wanted), "fold").filter(F.col("all_n") - F.col("before_n") >= F.col("_k"))
    return reach.groupBy("fold", "rule", "budget").agg(F.max("score").alias("bound"))


def _table(spark, pairs: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame(pairs, "rule string, budget double")


def picks(rows: DataFrame, plan: DataFrame, ks: list[int], qs: list[float], rate: float, **kw) -> DataFrame:
    """(rule, budget, fold, date, code, y) of every row that a rule selects; written once.

    ``rows`` has date, code, y and score, one row per date and code; ``plan`` has fold, role and date. Rules on training rows
    are marked as in-sample by their name. A row without a score is selected by no rule, but counts in a fold's rows.
    """
    spark = rows.sparkSession
    ranked = session_percentile(session_rank(rows.select("date", "code", "y", "score"), **kw), **kw)
    placed = staged(ranked.join(plan, "date"))
    train, test = placed.filter("role = 'train'"), placed.filter("role = 'test'")
    sizes = train.groupBy("fold").agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("date").alias("_d"),
                                      *[F.avg((F.coalesce("pct", F.lit(0.0)) > q).cast("int")).alias(f"_q{i}") for i, q in enumerate(qs)])
    matched = sizes.join(_table(spark, [(MATCHED, float(k)) for k in ks])).select(
        "fold", "rule", "budget", F.least(F.lit(1.0), F.col("budget") / (F.col("_n") / F.col("_d"))).alias("rate"))
    same = sizes.select("fold", F.explode(F.array(*[F.struct(F.lit(SAME_RATE).alias("rule"), F.lit(q).alias("budget"), F.col(f"_q{i}").alias("rate"))
                                                    for i, q in enumerate(qs)])).alias("_r")).select("fold", "_r.*")
    fixed = sizes.join(_table(spark, [(GLOBAL, rate), (IN_GLOBAL, rate)])).select("fold", "rule", "budget", F.lit(rate).alias("rate"))
    by_score = _thresholds(train, matched.unionByName(same).unionByName(fixed)).select(
        "fold", F.when(F.col("rule") == IN_GLOBAL, "train").otherwise("test").alias("role"), "rule", "budget", F.lit("score").alias("by"), "bound")
    folds = plan.select("fold", "role").distinct()
    by_rank = folds.join(_table(spark, [(r, float(k)) for r in (TOP, IN_TOP) for k in ks])).filter(
        (F.col("rule") == IN_TOP) == (F.col("role") == "train")).select("fold", "role", "rule", "budget", F.lit("rank").alias("by"), F.col("budget").alias("bound"))
    by_pct = folds.filter("role = 'test'").join(_table(spark, [(PERCENTILE, q) for q in qs])).select(
        "fold", "role", "rule", "budget", F.lit("pct").alias("by"), F.col("budget").alias("bound"))
    spent = test.groupBy("fold").agg(*[F.count_if(F.col("session_rank") < k).alias(f"_k{k}") for k in ks])
    by_place = spent.select("fold", F.explode(F.array(*[F.struct(F.lit(float(k)).alias("budget"), F.col(f"_k{k}").cast("double").alias("bound")) for k in ks])).alias("_b")).select(
        "fold", F.lit("test").alias("role"), F.lit(ORACLE).alias("rule"), "_b.budget", F.lit("place").alias("by"), "_b.bound")
    bounds = by_score.unionByName(by_rank).unionByName(by_pct).unionByName(by_place)
    # One row per fold and role, with some twenty bounds.
    bounds = bounds.groupBy("fold", "role").agg(F.collect_list(F.struct("rule", "budget", "by", "bound")).alias("_bounds"))
    order = test.filter("score is not null").withColumn("_neg", -F.col("score"))
    order = row_numbers(order, ["fold"], ["_neg", "date", "code"], "place", **kw).drop("_neg", "group_rows")
    both = order.unionByName(train.withColumn("place", F.lit(None).cast("bigint"))).filter("score is not null")

    def met(b: Column) -> Column:
        return F.when(b["by"] == "rank", F.col("session_rank") < b["bound"]).when(b["by"] == "pct", F.col("pct") > b["bound"]).when(
            b["by"] == "score", F.col("score") >= b["bound"]).otherwise(F.col("place") < b["bound"])

    chosen = both.join(F.broadcast(bounds), ["fold", "role"]).select("fold", "date", "code", "y", F.explode(F.filter("_bounds", met)).alias("_b"))
    return staged(chosen.select("_b.rule", "_b.budget", "fold", "date", "code", "y"))


def fold_table(chosen: DataFrame, rows: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per rule, budget and fold: signals, precision with its bounds, lift over the fold's base rate, dates and codes."""
    base = rows.join(plan, "date").groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.avg("y").alias("base_rate"))
    base = base.withColumnRenamed("role", "_role")
    codes = chosen.groupBy("rule", "budget", "fold", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("rule", "budget", "fold").agg(
        F.count(F.lit(1)).alias("codes"))
    per = chosen.groupBy("rule", "budget", "fold", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("h")).groupBy("rule", "budget", "fold").agg(
        F.sum("n").alias("signals"), F.sum("h").alias("hits"), F.count(F.lit(1)).alias("dates"))
    got = per.join(codes, ["rule", "budget", "fold"]).withColumn("_role", F.when(F.col("rule").isin(IN_TOP, IN_GLOBAL), "train").otherwise("test"))
    got = got.join(F.broadcast(base), ["fold", "_role"]).drop("_role")
    low, high = wilson(F.col("hits"), F.col("signals"))
    p = ratio("hits", "signals")
    return got.withColumns({"precision": p, "share_of_rows": ratio("signals", "rows"), "wilson_low": low, "wilson_high": high,
                            "lift": ratio(p, F.col("base_rate"))}).drop("hits")


def pooled_table(chosen: DataFrame, plan: DataFrame, ks: list[int], qs: list[float], rate: float, n_boot: int = 4000, seed: int = 0, block: int = 1,
                 level: float = 0.95) -> DataFrame:
    """One row per rule and budget over all folds: precision with a date-resampled interval, and the difference from
    the global threshold under the same draws of test dates."""
    pairs = rules(ks, qs, rate)
    calendar = plan.filter("role = 'test'").select("date").distinct()
    per = chosen.groupBy("rule", "budget", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("h"))
    sums = {}
    for i, (rule, budget) in enumerate(pairs):
        own = (F.col("rule") == rule) & (F.col("budget") == budget)
        sums |= {f"h{i}": F.sum(F.when(own, F.col("h"))), f"c{i}": F.sum(F.when(own, F.col("n")))}
    totals = staged(date_totals(per, calendar, sums))
    point = totals.agg(*[F.sum(n).alias(n) for n in sums])
    reps = replicates(totals, list(sums), n_boot, seed, block)
    a, last = (1 - level) / 2, len(pairs) - 1
    aggs = []
    for i in range(len(pairs)):
        p = ratio(f"h{i}", f"c{i}")
        d = p - ratio(f"h{last}", f"c{last}")
        aggs.append(F.struct(F.percentile(p, a).alias("ci_low"), F.percentile(p, 1 - a).alias("ci_high"), F.percentile(d, a).alias("delta_low"),
                             F.percentile(d, 1 - a).alias("delta_high"), F.avg((d > 0).cast("int")).alias("share_draws_better")).alias(f"b{i}"))
    wide = point.join(F.broadcast(reps.agg(*aggs)))
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(budget).alias("budget"), F.col(f"c{i}").cast("bigint").alias("signals"),
                              ratio(f"h{i}", f"c{i}").alias("precision"), (ratio(f"h{i}", f"c{i}") - ratio(f"h{last}", f"c{last}")).alias("delta"),
                              F.col(f"b{i}").alias("_b")) for i, (rule, budget) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*").select("*", "_b.*").drop("_b")
