"""Distributed ranks, totals and quantiles against NumPy, with groups forced to split."""

import datetime
import os
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsift import session
from barsift.operators import crosssec as xs
from barsift.operators import inference as inf
from barsift.operators import models
from barsift.operators import walkforward as wf
from barsift.operators.matrix import with_cross_section
from barsift.operators.ranking import average_rank, cumulative, quantiles, row_numbers


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    n = 6000
    # One group holds most rows, and one value holds a third of them.
    return pd.DataFrame({
        "date": np.where(rng.random(n) < 0.8, "d0", np.where(rng.random(n) < 0.5, "d1", "d2")),
        "code": [f"{i:06d}" for i in range(n)],
        "score": np.where(rng.random(n) < 0.33, 0.5, np.round(rng.random(n), 3)),
        "y": (rng.random(n) < 0.3).astype(int)})


@pytest.fixture(scope="module")
def rows(spark, frame):
    return spark.createDataFrame(frame, "date string, code string, score double, y int").cache()


@pytest.mark.parametrize("split", [10, 100, 10**6])
def test_average_rank(rows, frame, split):
    dist = cumulative(rows, ["date"], ["score"], {"hits": F.sum("y")}, split_rows=split)
    got = dist.select("date", "score", average_rank(dist).alias("r"), "before_hits", "all_n").toPandas()
    want = frame.assign(r=frame.groupby("date")["score"].rank()).drop_duplicates(["date", "score"])
    both = got.merge(want, on=["date", "score"], suffixes=("", "_w"))
    assert len(both) == len(got) == len(want) and np.allclose(both["r"], both["r_w"])
    for r in got.sample(20, random_state=1).itertuples():
        g = frame[frame.date == r.date]
        assert r.before_hits == g.y[g.score < r.score].sum() and r.all_n == len(g)


@pytest.mark.parametrize("split", [20, 10**6])
def test_row_numbers_are_a_permutation(rows, frame, split):
    got = row_numbers(rows, ["date"], ["score", "code"], split_rows=split).toPandas()
    for d, g in got.groupby("date"):
        assert sorted(g["row_no"]) == list(range((frame.date == d).sum()))
        assert g.sort_values("row_no")["score"].is_monotonic_increasing


@pytest.mark.parametrize("split", [20, 10**6])
def test_quantiles(rows, frame, split):
    got = quantiles(rows, ["date"], "score", {"a": 0.01, "b": 0.5, "c": 0.93}, split_rows=split).collect()
    for r in got:
        assert np.allclose([r.a, r.b, r.c], np.quantile(frame.score[frame.date == r.date], [0.01, 0.5, 0.93]))


def test_auc_and_frontier(rows, frame):
    def brute(g):
        p, n = g.score[g.y == 1].to_numpy(), g.score[g.y == 0].to_numpy()
        return ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))

    for r in xs.auc(rows, ["date"], split_rows=30).collect():
        assert np.isclose(r.auc, brute(frame[frame.date == r.date]))
    for r in xs.frontier(rows, [], split_rows=50).sample(0.05, 3).collect():
        g = frame[frame.score >= r.score]
        assert r.n_published == len(g) and np.isclose(r.precision, g.y.mean()) and np.isclose(r.recall, g.y.sum() / frame.y.sum())


def test_tied_scores_publish_together(spark):
    tied = spark.createDataFrame([("d", str(i), 0.5, int(i < 5)) for i in range(10)], "date string, code string, score double, y int")
    got = xs.frontier(tied, []).collect()
    assert len(got) == 1 and got[0].n_published == 10 and got[0].precision == 0.5


@pytest.mark.parametrize("rate", [0.0001, 0.02, 0.5])
def test_threshold(rows, frame, rate):
    k = max(1, round(rate * len(frame)))
    assert xs.threshold_for_rate(rows, rate, []).first().threshold == np.sort(frame.score)[-k]


def test_top_k_and_percentile_mask(rows, frame):
    got = xs.top_k(rows, 3).toPandas()
    want = frame.sort_values(["score", "code"], ascending=[False, True]).groupby("date").head(3)
    assert set(got["code"]) == set(want["code"])


def test_cross_section_of_a_split_session(rows, frame):
    got = with_cross_section(rows, {"s": "score"}, split_rows=40).toPandas().set_index("code")
    g = frame.set_index("code")
    rank = g.groupby("date")["score"].rank(pct=True)
    z = g.groupby("date")["score"].transform(lambda s: (s - s.mean()) / (s.std() + 1e-12))
    assert np.allclose(got["s_rank"], rank.loc[got.index]) and np.allclose(got["s_z"], z.loc[got.index])


def test_spread_visits_every_bucket_first(rows):
    got = xs.spread(rows.filter("date = 'd1'"), [], 12).toPandas()
    assert set(got.sort_values(["bucket_rank", "bucket"]).head(12)["bucket"]) == set(range(12))


def test_permutation_keeps_totals_and_breaks_the_link(rows, frame):
    planted = inf.planted_feature(rows.withColumn("date", F.col("date")), strength=5.0)
    null = inf.permuted_labels(planted, seed=3, split_rows=50)
    per = null.groupBy("date").agg(F.sum("y").alias("a"), F.sum("y_null").alias("b")).collect()
    assert all(r.a == r.b for r in per)
    real = xs.auc(planted, [], "y", "planted").first().auc
    fake = xs.auc(null, [], "y_null", "planted").first().auc
    assert real == 1.0 and abs(fake - 0.5) < 0.05


def test_folds_purge_and_cover(spark):
    days = pd.bdate_range("2020-01-01", periods=300)
    rows = spark.createDataFrame(pd.DataFrame({"date": days.date}), "date date")
    plan = wf.folds(rows, n_folds=5, horizon=10, embargo=2, min_train_sessions=120).toPandas()
    at = {d: i for i, d in enumerate(days.date)}
    tests = []
    for k, g in plan.groupby("fold"):
        train = [at[d] for d in g.date[g.role == "train"]]
        test = [at[d] for d in g.date[g.role == "test"]]
        assert min(test) - max(train) - 1 == 12 and len(train) >= 120
        tests += test
    # The first block has too short a training block after the purge.
    assert sorted(tests) == list(range(120 + 36, 300)) and plan.fold.nunique() == 4


def test_bootstrap_interval_holds_the_rate(spark, rows, frame):
    days = pd.bdate_range("2020-01-01", periods=60).date
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"date": rng.choice(days, 900), "hit": (rng.random(900) < 0.4).astype(int)})
    r = inf.date_bootstrap(spark.createDataFrame(f, "date date, hit int"),
                           spark.createDataFrame(pd.DataFrame({"date": days}), "date date"), n_boot=200, block=5).first()
    assert r.n_dates == 60 and r.ci_low < r.precision < r.ci_high and np.isclose(r.precision, f.hit.mean())


def test_top_k_is_cut_before_the_shuffle(rows):
    plan = xs.top_k(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") and plan.count("WindowGroupLimit") >= 2


def test_one_shuffle_serves_every_window(spark):
    from panels import to_spark, wavy
    from barsift.operators import scan
    got = scan.emitted(scan.decisions(scan.grid_rows(to_spark(spark, wavy("000001", 80, 1)))))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_unknown_scores_rank_last_and_stay(spark):
    day = datetime.date(2024, 1, 2)
    rows = spark.createDataFrame([(f"{i}", day, s, y) for i, (s, y) in enumerate([(None, 0), (0.9, 1), (0.5, 1), (None, 0), (0.1, 0)])],
                                 "code string, date date, score double, y int")
    ranks = {r.code: r.session_rank for r in xs.session_rank(rows).collect()}
    assert ranks == {"0": None, "1": 0, "2": 1, "3": None, "4": 2}
    assert {r.asked: r.precision for r in xs.rate_curve(rows, [2]).collect()} == {2: 1.0}
    cuts = {r.n_published: r.precision for r in xs.prefix_frontier(rows).collect()}
    assert cuts[1] == 1.0 and cuts[2] == 1.0 and cuts[5] == 0.4
    assert sorted(r.n_published for r in xs.frontier(rows, []).collect()) == [1, 2, 3]
    budgets = spark.createDataFrame([(day, 2)], "date date, budget int")
    assert {r.code for r in xs.top_n_per_group(rows, budgets, ["date"]).collect()} == {"1", "2"}


def test_staging_needs_a_shared_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError):
        session.staging_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://somewhere:7077")))


def test_dropped_stages_leave_no_files(spark):
    kept = session.staged(spark.range(5))
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    assert os.path.isdir(folder)
    session.drop_stages(spark)
    assert not os.path.exists(folder)


def test_a_fold_that_is_too_small_says_so(spark):
    rows = spark.createDataFrame([("a", datetime.date(2024, 1, 2), "train", 1, 0.5), ("b", datetime.date(2024, 1, 3), "test", 0, 0.4)],
                                 "code string, date date, role string, label_high int, x double")
    r = models.evaluate_fold(rows, models.Config("c", features=("x",), min_train=5)).first()
    assert (r.config, r.status, r.n_train, r.n_test, r.signals) == ("c", "insufficient rows", 1, 1, None)
