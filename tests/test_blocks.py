"""Means and windows over shared blocks of bars, and exact medians from a bracket."""

import math
import random

from pyspark.sql import functions as F

from barsift.functions.windows import BLOCK, blocked, ewm, in_blocks
from barsift.operators import layers, models, strategies


def bars(spark, n):
    r = random.Random(3)
    rows = [(c, i, 20 + r.random(), r.random() if r.random() < 0.6 and not 200 < i < n - 300 else None) for c in ("000001", "000002") for i in range(n)]
    df = spark.createDataFrame(rows, "code string, i int, close double, x double")
    return df.withColumn("date", F.date_add(F.lit("1990-01-01").cast("date"), F.col("i")))


def recursion(values, alpha):
    """The mean as it is defined, step by step."""
    out, state, weight = [], None, 0.0
    for v in values:
        weight *= 1 - alpha
        if v is not None:
            state = v if state is None else (weight * state + alpha * v) / (weight + alpha)
            weight = 1.0
        out.append(state)
    return out


def test_means_in_shared_blocks_follow_the_recursion(spark):
    n = 2 * BLOCK + 700
    df = blocked(bars(spark, n))
    with in_blocks():
        df = ewm(ewm(df, {"slow": ("close", 0.01, None, 1), "fast": ("close", 0.95, None, 1)}), {"gappy": ("x", 1 / 14, None, 1)}, gaps=True)
    got = df.orderBy("code", "date").collect()
    for code in ("000001", "000002"):
        mine = [r for r in got if r["code"] == code]
        for column, source, alpha in (("slow", "close", 0.01), ("fast", "close", 0.95), ("gappy", "x", 1 / 14)):
            want = recursion([r[source] for r in mine], alpha)
            assert all((a is None and r[column] is None) or math.isclose(a, r[column], rel_tol=1e-9) for a, r in zip(want, mine, strict=True)), column


def sorts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(" Sort [" in f" {line.lstrip(':+- *()0123456789')}" for line in plan.splitlines())


def test_layers_and_primitives_sort_twice(spark):
    df = spark.createDataFrame([], "code string, date date, open double, high double, low double, close double, volume double")
    for made in (layers.with_layers(df), strategies.with_primitives(df)):
        assert 1 <= sorts(made) <= 2


def test_medians_are_exact(spark):
    r = random.Random(5)
    rows = [(r.gauss(0, 1), float(r.random() < 0.1), None if r.random() < 0.5 else r.random() ** 9, float("nan") if i % 3 else float(i)) for i in range(5001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = models.medians(df, ("a", "b", "c", "d"))
    for i, c in enumerate("abcd"):
        known = sorted(x[i] for x in rows if x[i] is not None and not math.isnan(x[i]))
        assert got[c] == known[(len(known) + 1) // 2 - 1]


def test_configurations_that_differ_in_rate_share_a_fit(spark, monkeypatch):
    fitted = []
    real = models.fit_scores
    monkeypatch.setattr(models, "fit_scores", lambda train, rows, cfg: fitted.append(cfg.name) or real(train, rows, cfg))
    rows = spark.range(400).select(
        F.col("id").cast("string").alias("code"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("date"),
        (F.col("id") % 7 < 3).cast("int").alias("label_high"), (F.col("id") % 7).cast("double").alias("f"))
    plan = rows.select("date").distinct().select(F.lit(1).alias("fold"), "date", F.when(F.col("date") < "2000-01-25", "train").otherwise("test").alias("role"))
    two = [models.Config(f"r{r}", "logistic", target_rate=r, features=("f",), settings={"maxIter": 3}, min_train=10, min_test=10) for r in (0.1, 0.4)]
    got = {x["config"]: x for x in models.search(rows, plan, two, [1]).collect()}
    assert fitted == ["r0.1"] and set(got) == {"r0.1", "r0.4"}


def test_windows_by_doubling_are_the_sliding_ones(spark):
    from barsift.functions.windows import by_doubling, roll
    df = bars(spark, 420)
    asked = {f"{how}{w}{c}": (c, how, w, w // 3) for how in ("max", "min", "sum", "mean") for w in (1, 5, 64, 250) for c in ("close", "x")}
    got = by_doubling(df, asked)
    slid = got.select("*", *[roll(c, w, how, least=max(1, least)).alias(f"_{o}") for o, (c, how, w, least) in asked.items()])
    wrong = [F.count_if(~F.col(o).eqNullSafe(F.col(f"_{o}")) if how in ("max", "min") else ~F.coalesce(
        F.abs(F.col(o) - F.col(f"_{o}")) < 1e-11, F.col(o).isNull() & F.col(f"_{o}").isNull())).alias(o) for o, (_, how, _, _) in asked.items()]
    assert set(slid.agg(*wrong).first().asDict().values()) == {0}


def test_ranges_are_found_by_halving(spark):
    from barsift.operators.ranking import _passed
    df = spark.sql("select id p, transform(sequence(1, 1 + id % 37), i -> i * 3) c from range(120) union all select 5, cast(null as array<bigint>)")
    got = df.select("p", "c", F.coalesce(_passed("c", F.col("p")), F.lit(0)).alias("n")).collect()
    assert all(r["n"] == sum(x <= r["p"] for x in r["c"] or []) for r in got)
    assert "filter(" not in _passed("c", F.col("p"))._jc.toString()


def test_key_differences_count_repeats(spark):
    from barsift.operators.audits import key_differences
    a, b = (spark.createDataFrame(x, "code string, date string") for x in ([("1", "a"), ("1", "a"), ("2", None)], [("1", "a"), ("3", "c")]))
    got = key_differences(a, b, "l", "r")
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "a", "l"), ("2", None, "l"), ("3", "c", "r")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_report_values_round_as_spark_does(spark):
    from barsift.functions.columns import NUDGE, r6
    r = random.Random(9)
    odd = [None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e-9, -2.5e-7, 1e10 + 0.1234565, 3e300, -1234567.0000005]
    near = [(r.randrange(-10 ** 7, 10 ** 7) + 0.5) / 10 ** d - NUDGE + e for d in (5, 6) for e in (0, 1e-12, -1e-12) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in odd + near + [r.gauss(0, 10 ** r.randrange(-7, 9)) for _ in range(20000)]], "x double")
    for digits in (5, 6):
        want = F.round(F.col("x") + F.lit(NUDGE), digits) + F.lit(0.0)
        assert df.filter(~r6(F.col("x"), digits).eqNullSafe(want)).count() == 0


def test_earlier_windows_are_lags_of_one_statistic(spark):
    from barsift.functions.windows import roll, span
    r = random.Random(4)
    rows = [(c, i, *[round(20 + r.random(), 2) for _ in range(4)], None if r.random() < 0.1 else float(r.randrange(100))) for c in ("000001", "000002") for i in range(130)]
    df = spark.createDataFrame(rows, "code string, i int, open double, high double, low double, close double, volume double")
    df = df.withColumn("date", F.date_add(F.lit("1990-01-01").cast("date"), F.col("i")))
    asked = {"vr_base": ("volume", 16, "mean", 5), "vr5_base": ("volume", 16, "mean", 10), "top40_1": ("close", 40, "max", 1), "bot20_21": ("close", 20, "min", 21),
             "base_low": ("low", 10, "min", 5), "std15_5": ("close", 15, "pstd", 5), "cl_old": ("cl", 5, "mean", 5), "tm20_5": ("turnover", 20, "mean", 5)}
    got = strategies.with_primitives(df)
    assert got.select("*", F.sum("_usable").over(span(-59, 0)).alias("_cards")).filter("card_bars <> _cards").count() == 0
    slid = got.select("*", *[roll(c, w, how, skip=skip).alias(f"_w_{o}") for o, (c, w, how, skip) in asked.items()])
    assert set(slid.agg(*[F.count_if(~F.col(o).eqNullSafe(F.col(f"_w_{o}"))).alias(o) for o in asked]).first()) == {0}
    frames = set(__import__("re").findall(r"RowFrame, -(\d+), currentrow", got._jdf.queryExecution().optimizedPlan().toString()))
    assert max(map(int, frames)) < 21
