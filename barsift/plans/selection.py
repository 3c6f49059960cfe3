"""Queries on selection, thresholds, folds, resampling and feature scans.

The population is every resolved weekly bar with its label and a fixed formula as the score,
so that each result can be stated in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import crosssec as xs
from ..operators import inference as inf
from ..operators import scoring, walkforward as wf
from ..operators.strategies import close_location
from ..session import staged
from ..sources.tables import bars
from . import sqltext as q
from .labels import labelled
from .registry import query

CUTOFF = "2000-01-03"


def population(spark, folder) -> DataFrame:
    rows = labelled(spark, folder, "webpro").filter("label_resolved")
    score = (30.5 - F.col("close")) / 10.5 * 0.7 + 0.3 * close_location()
    return staged(rows.select("code", "date", F.col("label_bull").alias("y"), score.alias("score"), "close", "volume",
                              "high", "low"))


POP = q.with_(q.BARS, q.SEQ, q.label_cte("webpro"), """pop as (select code, date, l.seq, label_bull y, close, volume, high, low,
  (30.5::double-close)/10.5::double*0.7::double+0.3::double*(case when high-low<=1e-12 then 0.5::double
    else greatest(0e0,least(1e0,(close-low)/(high-low))) end) score
  from lab_webpro l join s using (code, date) where label_resolved)""")


def popq(*ctes: str) -> str:
    return POP.rstrip() + "".join(",\n" + c for c in ctes) + "\n"


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


TOP5 = "t5 as (select *, row_number() over (partition by date order by score desc, code)-1 rk from pop)"


@query("t02_top_k", popq(TOP5) + "select code, date, y, rk as rank from t5 where rk<5")
def _t02(spark, folder):
    return xs.top_k(population(spark, folder), 5).select("code", "date", "y", "rank")


@query("w17_session_rank", popq(TOP5) + f"""select code, date, rk session_rank,
  {q.r6('(rank() over (partition by date order by score)+(count(*) over (partition by date, score)-1)/2e0)/count(*) over (partition by date)')} pct,
  {q.r6('(score-avg(score) over (partition by date))/(stddev_samp(score) over (partition by date)+1e-12)')} z from t5""")
def _w17(spark, folder):
    pop = population(spark, folder)
    got = xs.session_zscore(xs.session_percentile(xs.session_rank(pop), "score"), "score")
    return six(got.select("code", "date", "session_rank", "pct", "z"), "pct", "z")


PCT = """pc as (select *, (rank() over (partition by date order by score)+(count(*) over (partition by date, score)-1)/2e0)
  /count(*) over (partition by date) pct from pop)"""


@query("t03_percentile_mask", popq(PCT) + "select code, date, y from pc where pct>0.95::double")
def _t03(spark, folder):
    return xs.session_percentile(population(spark, folder)).filter(F.col("pct") > 0.95).select("code", "date", "y")


def _thr(rate: str, src: str) -> str:
    return f"""th as (select min(score) threshold, any_value(n) rows, any_value(kk) k from (select score, row_number() over (order by score desc) rn,
  count(*) over () n, greatest(1, round_even(count(*) over ()*{rate}::double,0)::bigint) kk from {src}) where rn<=kk)"""


@query("t04_pick_threshold", popq(f"tr as (select * from pop where date<date '{CUTOFF}')", _thr("0.02", "tr")) + """
  select rows, k, threshold, (select count(*) from tr where score>=threshold) published from th""")
def _t04(spark, folder):
    train = population(spark, folder).filter(F.col("date") < F.lit(CUTOFF).cast("date"))
    thr = xs.threshold_for_rate(train, 0.02, [])
    return train.join(F.broadcast(thr), F.col("score") >= F.col("threshold")).groupBy("rows", "k", "threshold").agg(
        F.count(F.lit(1)).alias("published"))


@query("t05_global_threshold", popq(f"tr as (select * from pop where date<date '{CUTOFF}')", _thr("0.02", "tr")) + f"""
  select count(*) signals, sum(y)::bigint hits, {q.r6('avg(y)')} "precision",
  (select {q.r6('least(1e0, 5/(count(*)/count(distinct date)::double))')} from tr) matched_rate_k5
  from pop, th where date>=date '{CUTOFF}' and score>=threshold""")
def _t05(spark, folder):
    pop = population(spark, folder)
    day = F.lit(CUTOFF).cast("date")
    train = pop.filter(F.col("date") < day)
    thr = xs.threshold_for_rate(train, 0.02, []).select("threshold")
    got = pop.filter(F.col("date") >= day).join(F.broadcast(thr), F.col("score") >= F.col("threshold")).agg(
        F.count(F.lit(1)).alias("signals"), F.sum("y").alias("hits"), F.avg("y").alias("precision"))
    rate = xs.matched_rate(train, 5, []).select(F.col("rate").alias("matched_rate_k5"))
    return six(got.join(F.broadcast(rate)), "precision", "matched_rate_k5")


def plan_of(pop: DataFrame) -> DataFrame:
    return wf.folds(pop, n_folds=5, horizon=10, embargo=2, min_train_sessions=100)


FOLDS = """ses as (select date, row_number() over (order by date)-1 i, count(*) over () n from (select distinct date from pop)),
fd as (select date, i, f, 100+floor(f*(n-100)/5)::bigint st, 100+floor((f+1)*(n-100)/5)::bigint en from ses, range(5) r(f)),
fold as (select f as fold, case when i>=st and i<en then 'test' when i<st-12 then 'train' end as role, date from fd where st-12>=100)"""


@query("m01_folds", popq(FOLDS) + """select fold, role, count(*) sessions, min(date) first_date, max(date) last_date
  from fold where role is not null group by all""")
def _m01(spark, folder):
    return wf.fold_summary(plan_of(population(spark, folder)))


@query("j06_fold_membership", popq(FOLDS) + """select fold, role, count(*) row_count, sum(y)::bigint hits from pop join fold using (date)
  where role is not null group by all""")
def _j06(spark, folder):
    pop = population(spark, folder)
    return wf.fold_rows(pop, plan_of(pop)).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("y").alias("hits"))


PURGE = f"""sx as (select date, row_number() over (order by date)-1 i from (select distinct date from pop)),
cutp as (select min(i) c from sx where date>=date '{CUTOFF}'),
mk as (select pop.*, sx.i, c, case when pop.date>=date '{CUTOFF}' then 'test' when sx.i<=c-11 then 'train' else 'purged' end as role
  from pop join sx using (date), cutp)"""


@query("m02_purge_by_label_end", popq(PURGE) + "select role, count(*) row_count, min(date) first_date, max(date) last_date from mk group by 1")
def _m02(spark, folder):
    return wf.purge_by_label_end(population(spark, folder), CUTOFF, 10).groupBy("role").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("q07_boundary_leaks", popq(PURGE) + """select role, count(*) as "rows", sum((i+10>=c)::int)::bigint label_end_in_test
  from mk where role<>'test' group by 1""")
def _q07(spark, folder):
    return wf.boundary_leaks(population(spark, folder), CUTOFF, 10)


@query("p08_holdout_sessions", popq() + f"select distinct date from pop where date>=date '{CUTOFF}'")
def _p08(spark, folder):
    return population(spark, folder).filter(F.col("date") >= F.lit(CUTOFF).cast("date")).select("date").distinct()


FTEST = """tst as (select pop.*, fold from pop join fold using (date) where role='test'),
bud as (select fold, count(*) budget from (select fold, row_number() over (partition by date, fold order by score desc, code) r from tst) where r<=3 group by 1),
orc as (select t.* from (select *, row_number() over (partition by fold order by score desc, date, code) rn from tst) t join bud using (fold) where rn<=budget)"""


@query("t06_oracle_by_fold", popq(FOLDS, FTEST) + f"""select fold, count(*) signals, sum(y)::bigint hits, {q.r6('avg(y)')} "precision" from orc group by 1""")
def _t06(spark, folder):
    pop = population(spark, folder)
    test = wf.fold_rows(pop, plan_of(pop)).filter("role = 'test'")
    budget = xs.top_k(test, 3, by=("date", "fold")).groupBy("fold").agg(F.count(F.lit(1)).alias("budget"))
    got = xs.top_n_per_group(test, budget, ["fold"]).groupBy("fold").agg(
        F.count(F.lit(1)).alias("signals"), F.sum("y").alias("hits"), F.avg("y").alias("precision"))
    return six(got, "precision")


COUNTS = [1, 10, 50, 100, 500, 1000, 5000, 10**9]


@query("t07_rate_curve", popq("rc as (select row_number() over (order by score desc, date, code) n, sum(y) over (order by score desc, date, code rows unbounded preceding) h, count(*) over () t from pop)")
       + f"""select c::bigint asked, n n_signals, {q.r6('h/n::double')} "precision" from rc, (values {','.join(f'({c})' for c in COUNTS)}) v(c) where n=greatest(1,least(c,t))""")
def _t07(spark, folder):
    got = xs.rate_curve(population(spark, folder), COUNTS)
    return six(got.withColumn("asked", F.col("asked").cast("bigint")), "precision")


FRONT = """fr as (select score, sum(count(*)) over (order by score desc) n, sum(sum(y)) over (order by score desc) tp,
  (select count(*) from pop) t, (select sum(y) from pop) p from pop group by score),
fr2 as (select score, n::bigint n_published, n/t::double publish_rate, tp/p::double recall, tp/n::double precision_, (n-tp)/(t-p)::double fpr from fr)"""


@query("t08_frontier", popq(FRONT) + f"""select score, n_published, {q.r6('publish_rate')} publish_rate, {q.r6('recall')} recall,
  {q.r6('precision_')} "precision", {q.r6('fpr')} fpr from fr2""")
def _t08(spark, folder):
    return six(xs.frontier(population(spark, folder), []), "publish_rate", "recall", "precision", "fpr")


@query("t08_prefix_frontier", popq("""pf as (select row_number() over (order by score desc, date, code) n, sum(y) over (order by score desc, date, code rows unbounded preceding) tp,
  count(*) over () t, sum(y) over () p from pop)""", """ks as (select distinct floor(2000+i*((select max(t) from pf)-2000)/199e0)::bigint k from range(200) r(i))""")
       + f"""select n n_published, {q.r6('n/t::double')} publish_rate, {q.r6('tp/p::double')} recall, {q.r6('tp/n::double')} "precision",
  {q.r6('(n-tp)/(t-p)::double')} fpr from pf where n<=2000 or n=t or n in (select k from ks)""")
def _t08p(spark, folder):
    return six(xs.prefix_frontier(population(spark, folder)), "publish_rate", "recall", "precision", "fpr")


@query("t09_required_fpr", popq() + f"""select recall, {q.r6('b*recall*(1-0.7::double)/((1-b)*0.7::double)', 8)} fpr
  from (select avg(y) b from pop), (values (0.5::double),(0.3::double),(0.1::double),(0.01::double)) v(recall)""")
def _t09(spark, folder):
    base = population(spark, folder).agg(F.avg("y").alias("b"))
    got = base.select("b", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.3, 0.1, 0.01)])).alias("recall"))
    return got.select("recall", r6(xs.required_fpr(F.col("b"), F.lit(0.7), F.col("recall")), 8).alias("fpr"))


@query("t10_bounds", popq(FRONT) + "".join(f"""{' union all ' if i else ''}(select '{c}' on_column, f as floor, {q.r6('precision_')} max_precision, n_published at_signals, {q.r6('recall')} recall from (
  select f, precision_, n_published, recall, row_number() over (partition by f order by precision_ desc, n_published) rn from fr2, (values {vals}) v(f) where {c}>=f) where rn=1)"""
       for i, (c, vals) in enumerate((("n_published", "(50e0),(250e0),(1000e0),(5000e0)"), ("recall", "(0.5::double),(0.1::double),(0.01::double)")))))
def _t10(spark, folder):
    cuts = staged(xs.frontier(population(spark, folder), []))
    a = xs.bounds(cuts, "n_published", [50, 250, 1000, 5000]).withColumn("on_column", F.lit("n_published"))
    b = xs.bounds(cuts, "recall", [0.5, 0.1, 0.01]).withColumn("on_column", F.lit("recall"))
    return six(a.unionByName(b), "max_precision", "recall")


@query("t13_choose_k", popq(f"tr as (select * from pop where date<date '{CUTOFF}')",
  "tx as (select date, row_number() over (order by date)-1 i, count(*) over () n from (select distinct date from tr))",
  "tb as (select date, b, st from (select date, i, b, floor(b*n/3) st, floor((b+1)*n/3) en from tx, range(3) r(b)) where i>=st and i<en and st-12>=60)",
  "rk as (select tr.*, row_number() over (partition by date order by score desc, code) r from tr join tb using (date))",
  "kk as (select k, count(*) n_signals, avg(y) p from rk, (values (1),(3),(5),(10)) v(k) where r<=k group by 1 having count(*)>=40)")
  + f"""select k, n_signals, {q.r6('p')} "precision", 'best inner precision' reason from kk order by p desc, k limit 1""")
def _t13(spark, folder):
    train = population(spark, folder).filter(F.col("date") < F.lit(CUTOFF).cast("date"))
    return six(wf.choose_k(train, [1, 3, 5, 10], min_train=60), "precision")


_FP = """fb as (select fold, count(*) n_test, sum(y)::bigint positives, avg(y) base_rate from tst group by 1),
fk as (select k, fold, count(*) signals, avg(y) precision_ from (select *, row_number() over (partition by date, fold order by score desc, code) r from tst), (values (1),(3),(10)) v(k) where r<=k group by all),
pl as (select k, count(*) n_folds, sum(signals)::bigint oos_signals, sum(precision_*signals)/sum(signals) oos_precision, sum(positives)/sum(n_test)::double oos_base_rate,
  sum(base_rate*signals)/sum(signals) oos_base_rate_by_signals, avg(base_rate) oos_base_rate_unweighted, sum((precision_>base_rate)::int)::bigint folds_above_base
  from fk join fb using (fold) group by 1)"""


def fold_results(spark, folder) -> DataFrame:
    """Top-k results per fold for several k; a deterministic stand-in for a model search."""
    pop = population(spark, folder)
    test = staged(wf.fold_rows(pop, plan_of(pop)).filter("role = 'test'"))
    ranked = xs.top_k(test, 10, by=("date", "fold"))
    picks = ranked.select(F.explode(F.array(F.lit(1), F.lit(3), F.lit(10))).alias("k"), "fold", "rank", "y").filter(
        F.col("rank") < F.col("k"))
    base = test.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_test"), F.sum("y").alias("positives"), F.avg("y").alias("base_rate"))
    got = picks.groupBy("k", "fold").agg(F.count(F.lit(1)).alias("signals"), F.avg("y").alias("precision"))
    return got.join(base, "fold")


@query("a12_pool_folds", popq(FOLDS, FTEST, _FP) + f"""select k, n_folds, oos_signals, folds_above_base,
  {q.r6('oos_precision')} oos_precision, {q.r6('oos_base_rate')} oos_base_rate, {q.r6('oos_base_rate_by_signals')} oos_base_rate_by_signals,
  {q.r6('oos_base_rate_unweighted')} oos_base_rate_unweighted, {q.r6('oos_precision/oos_base_rate')} oos_lift,
  {q.r6('greatest(abs(oos_base_rate_by_signals-oos_base_rate),abs(oos_base_rate_unweighted-oos_base_rate))')} oos_base_rate_max_abs_diff from pl""")
def _a12(spark, folder):
    got = scoring.pool_folds(fold_results(spark, folder), ["k"])
    return six(got, "oos_precision", "oos_base_rate", "oos_base_rate_by_signals", "oos_base_rate_unweighted", "oos_lift",
               "oos_base_rate_max_abs_diff")


@query("a13_weighted_precision", popq(FOLDS, FTEST, _FP) + f"""select k, oos_signals n_signals, n_folds, {q.r6('oos_precision')} "precision" from pl""")
def _a13(spark, folder):
    return six(scoring.weighted_precision(fold_results(spark, folder), ["k"]), "precision")


@query("a26_search_ranking", popq(FOLDS, FTEST, _FP) + f"""select 'top'||k config, n_folds, oos_signals, {q.r6('oos_precision')} oos_precision
  from pl where oos_signals>=300 and n_folds>=3""")
def _a26(spark, folder):
    pooled = scoring.pool_folds(fold_results(spark, folder), ["k"]).withColumn(
        "config", F.concat(F.lit("top"), F.col("k").cast("string")))
    return six(wf.search_ranking(pooled, 300, 3).select("config", "n_folds", "oos_signals", "oos_precision"), "oos_precision")


def _auc_sql(src: str, keys: str = "") -> str:
    part = f"partition by {keys}" if keys else ""
    return f"""select {keys + ',' if keys else ''} count(*) n, (sum(y*rr)-sum(y)*(sum(y)+1)/2e0)/(sum(y)*(count(*)-sum(y))) auc from (
  select *, rank() over ({part} order by x)+(count(*) over (partition by {keys + ',' if keys else ''} x)-1)/2e0 rr from {src}) group by all having sum(y)>0 and sum(y)<count(*)"""


@query("m08_session_auc", popq("ps as (select *, score x from pop)", f"pa as ({_auc_sql('ps')})", f"da as ({_auc_sql('ps', 'date')})") + f"""
  select {q.r6('(select auc from pa)')} pooled_auc, {q.r6('avg(auc)')} mean_session_auc, {q.r6('sum(auc*n)/sum(n)')} weighted_session_auc,
  {q.r6('quantile_cont(auc,0.5)')} median_session_auc, {q.r6('avg((auc>0.5)::int)')} share_sessions_auc_above_half, count(*) n_sessions from da""")
def _m08(spark, folder):
    return six(xs.session_auc(population(spark, folder)), "pooled_auc", "mean_session_auc", "weighted_session_auc",
               "median_session_auc", "share_sessions_auc_above_half")


SCAN_FEATURES = ["close", "volume", "high", "low", "score"]
MELT = "lg as (" + " union all ".join(f"select code, date, y, '{c}' feature, {c} x from pop" for c in SCAN_FEATURES) + ")"


@query("m09_auc_scan", popq(MELT, """lp as (select *, (rank() over (partition by feature, date order by x)+(count(*) over (partition by feature, date, x)-1)/2e0)
  /count(*) over (partition by feature, date) pct from lg)""", f"ra as ({_auc_sql('lg', 'feature')})",
  "lq as (select feature, y, pct x from lp)", f"rb as ({_auc_sql('lq', 'feature')})") + f"""
  select feature, {q.r6('ra.auc')} auc, {q.r6('rb.auc')} auc_within_date_rank, 1e0 finite_share from ra join rb using (feature)""")
def _m09(spark, folder):
    return six(xs.auc_scan(population(spark, folder), SCAN_FEATURES), "auc", "auc_within_date_rank", "finite_share")


@query("a17_feature_health", popq(MELT) + f"""select feature, count(*) as "rows", count(x) finite, 1e0 coverage, {q.r6('avg(x)')} mean, {q.r6('stddev_pop(x)')} std,
  count(distinct x) nunique, {q.r6('quantile_cont(x,0.01)')} p01, {q.r6('quantile_cont(x,0.5)')} p50, {q.r6('quantile_cont(x,0.99)')} p99, min(x)=max(x) constant
  from lg group by 1""")
def _a17(spark, folder):
    return six(xs.feature_health(population(spark, folder), SCAN_FEATURES), "coverage", "mean", "std", "p01", "p50", "p99")


_RK = "rk as (select " + ", ".join(f"rank() over (order by {c})+(count(*) over (partition by {c})-1)/2e0 {c}" for c in SCAN_FEATURES) + " from pop)"


@query("a18_spearman_matrix", popq(_RK) + " union all ".join(
    f"select '{a}' feature_a, '{b}' feature_b, count(*) n, {q.r6(f'corr({a},{b})')} rho from rk"
    for i, a in enumerate(SCAN_FEATURES) for b in SCAN_FEATURES[i + 1:]))
def _a18(spark, folder):
    return six(xs.spearman_matrix(population(spark, folder), SCAN_FEATURES), "rho")


@query("a19_spearman", popq("rk as (select rank() over (order by volume)+(count(*) over (partition by volume)-1)/2e0 a, "
       "rank() over (order by score)+(count(*) over (partition by score)-1)/2e0 b from pop)") + f"select {q.r6('corr(a,b)')} rho, count(*) n from rk")
def _a19(spark, folder):
    return six(scoring.spearman(population(spark, folder), [], "volume", "score"), "rho")


PICK = "pk as (select *, y hit from t5 where rk<5)"


def picked(spark, folder) -> DataFrame:
    return xs.top_k(population(spark, folder), 5).withColumn("hit", F.col("y"))


@query("a14_concentration", popq(TOP5, PICK, """pd as (select date, count(*) n, sum(hit) h, sum(count(*)) over () nn, sum(sum(hit)) over () hh from pk group by 1)""") + f"""
  select any_value(nn)::bigint n_signals, count(*) n_distinct_dates, {q.r6('sum((n/nn::double)*(n/nn::double))')} herfindahl_dates,
  {q.r6('1/sum((n/nn::double)*(n/nn::double))')} effective_dates, {q.r6('max(n/nn::double)')} max_date_share,
  {q.r6('min((hh-h)/(nn-n)::double)')} precision_drop_worst_date, {q.r6('max((hh-h)/(nn-n)::double)')} precision_drop_best_date,
  {q.r6('avg(h/n::double)')} mean_daily_precision, {q.r6('quantile_cont(h/n::double,0.5)')} median_daily_precision,
  {q.r6('avg((h/n::double>hh/nn::double)::int)')} share_dates_above_base, (select count(distinct code) from pk) n_distinct_stocks,
  arg_max(date,(n,date)) busiest_date, arg_max(n,(n,date)) busiest_date_signals, {q.r6('arg_max(h/n::double,(n,date))')} busiest_date_precision,
  {q.r6('arg_max((hh-h)/(nn-n)::double,(n,date))')} precision_drop_busiest_date, arg_max(nn-n,(n,date))::bigint precision_drop_busiest_n from pd""")
def _a14(spark, folder):
    return six(scoring.concentration(picked(spark, folder), []), "herfindahl_dates", "effective_dates", "max_date_share",
               "precision_drop_worst_date", "precision_drop_best_date", "mean_daily_precision", "median_daily_precision",
               "share_dates_above_base", "busiest_date_precision", "precision_drop_busiest_date")


DROPS = [0, 1, 3, 5, 10, 20, 40]


@query("a15_drop_top_dates", popq(TOP5, PICK, "pd as (select date, count(*) n, sum(hit) h, row_number() over (order by count(*) desc, date) r from pk group by 1)")
       + f"""select d dropped, sum(n)::bigint signals, {q.r6('sum(h)/sum(n)::double')} "precision" from pd, (values {','.join(f'({d})' for d in DROPS)}) v(d) where r>d group by 1""")
def _a15(spark, folder):
    return six(scoring.drop_top_dates(picked(spark, folder), DROPS), "precision")


@query("a16_half_split", popq(TOP5, PICK, "ph as (select *, row_number() over (order by date, code)-1 i, count(*) over () n from pk)") + f"""
  select case when i<n//2 then 'first' else 'second' end half, count(*) signals, {q.r6('avg(hit)')} "precision" from ph group by 1""")
def _a16(spark, folder):
    from ..operators.ranking import row_numbers
    placed = row_numbers(picked(spark, folder), [], ["date", "code"])
    half = F.when(F.col("row_no") < F.floor(F.col("group_rows") / 2), "first").otherwise("second")
    return six(placed.groupBy(half.alias("half")).agg(F.count(F.lit(1)).alias("signals"), F.avg("hit").alias("precision")), "precision")


@query("a23_by_date", popq(TOP5, "pk as (select *, y hit from t5 where rk<2 and score>0.8::double)") + """
  select c.date, count(pk.code) n, coalesce(sum(hit),0)::bigint hits from (select distinct date from pop) c left join pk using (date) group by 1""")
def _a23(spark, folder):
    pop = population(spark, folder)
    rows = xs.top_k(pop, 2).filter(F.col("score") > 0.8).withColumn("hit", F.col("y"))
    return scoring.by_date(rows, pop)


@query("t11_spread", popq("sg as (select *, row_number() over (order by date, code)-1 i, count(*) over () n from pop where score>0.8::double)",
       "sb as (select *, ceil((i+1)*12/n::double)-1 b from sg)") + "select code, date, b::bigint bucket, (i-floor(b*n/12e0))::bigint bucket_rank from sb")
def _t11(spark, folder):
    rows = population(spark, folder).filter(F.col("score") > 0.8)
    return xs.spread(rows, []).select("code", "date", F.col("bucket").cast("bigint").alias("bucket"),
                                      F.col("bucket_rank").cast("bigint").alias("bucket_rank"))


# Resampling: the same hash draws on both engines.
def _boot(cols: list[str], seed: int, n_boot: int, block: int) -> str:
    draw = f"('0x'||substr(md5('{seed}:'||rep||':'||slot),1,8))::bigint"
    return f"""slots as (select rep, slot, n from range({n_boot}) r(rep), (select count(*) n from tot), range(100000) t(slot) where slot<ceil(n/{block}e0)),
dr as (select rep, ({draw}%n+o)%n i from slots, range({block}) b(o)),
reps as (select rep, {', '.join(f'sum({c}) {c}' for c in cols)} from dr join tot using (i) group by 1)"""


def _tot(cols: dict[str, str], src: str = "pk") -> str:
    return f"""tot as (select row_number() over (order by c.date)-1 i, c.date, {', '.join(f'coalesce({n},0) {n}' for n in cols)} from (select distinct date from pop) c
  left join (select date, {', '.join(f'({e})::double {n}' for n, e in cols.items())} from {src} group by 1) using (date))"""


def _ci(block: int) -> str:
    return popq(TOP5, PICK, _tot({"h": "sum(hit)", "c": "count(*)"}), _boot(["h", "c"], 0, 4000, block)) + f"""
  select (select sum(c)::bigint from tot) n_signals, (select count(*) from tot) n_dates, {q.r6('(select sum(h)/sum(c) from tot)')} "precision",
  {q.r6('quantile_cont(h/c,0.025)')} ci_low, {q.r6('quantile_cont(h/c,0.975)')} ci_high, {q.r6('avg(h/c)')} boot_mean, {q.r6('stddev_pop(h/c)')} boot_sd,
  {block} as "block", 4000 n_boot, 0.95::double as "level" from reps where c>0"""


def _boot_query(block: int):
    def run(spark, folder):
        pop = population(spark, folder)
        rows = xs.top_k(pop, 5).withColumn("hit", F.col("y"))
        return six(inf.date_bootstrap(rows, pop, n_boot=4000, block=block), "precision", "ci_low", "ci_high", "boot_mean", "boot_sd")
    return run


query("i01_date_bootstrap", _ci(1))(_boot_query(1))
query("i01_block_bootstrap", _ci(10))(_boot_query(10))

ARMS = "ar as (select *, (rk<5)::int a, (rk>=5 and rk<10)::int b from t5)"


@query("i02_paired_bootstrap", popq(TOP5, ARMS, _tot({"ha": "sum(a*y)", "ca": "sum(a)", "hb": "sum(b*y)", "cb": "sum(b)"}, "ar"), _boot(["ha", "ca", "hb", "cb"], 3, 4000, 1),
       "rd as (select ha/ca-hb/cb d from reps where ca>0 and cb>0)", "po as (select sum(ha) ha, sum(ca) ca, sum(hb) hb, sum(cb) cb, count(*) n from tot)") + f"""
  select any_value(ca)::bigint n_signals_a, any_value(cb)::bigint n_signals_b, {q.r6('any_value(ha/ca)')} precision_a, {q.r6('any_value(hb/cb)')} precision_b,
  {q.r6('any_value(ha/ca-hb/cb)')} delta, {q.r6('quantile_cont(d,0.025)')} ci_low, {q.r6('quantile_cont(d,0.975)')} ci_high, {q.r6('avg(d)')} boot_mean, {q.r6('stddev_pop(d)')} boot_sd,
  {q.r6('avg((d>0)::int)')} share_draws_a_better, quantile_cont(d,0.025)>0 or quantile_cont(d,0.975)<0 excludes_zero, any_value(n) n_dates from rd, po""")
def _i02(spark, folder):
    pop = population(spark, folder)
    rows = xs.session_rank(pop).withColumns({
        "a": F.col("session_rank") < 5, "b": (F.col("session_rank") >= 5) & (F.col("session_rank") < 10)})
    return six(inf.paired_bootstrap(rows, pop, "a", "b", n_boot=4000, seed=3), "precision_a", "precision_b", "delta", "ci_low", "ci_high",
               "boot_mean", "boot_sd", "share_draws_a_better")


@query("i03_contrast", popq("ar as (select *, (volume>25)::int a from pop)", _tot({"ha": "sum(a*y)", "ca": "sum(a)", "hb": "sum((1-a)*y)", "cb": "sum(1-a)"}, "ar"), _boot(["ha", "ca", "hb", "cb"], 5, 4000, 5),
       "po as (select sum(ha)/sum(ca) pa, sum(hb)/sum(cb) pb, sum(ca) na, sum(cb) nb from tot)",
       "cl as (select sqrt(sum(pow((ha-pa*ca)/na-(hb-pb*cb)/nb,2))) se, any_value(pa) pa, any_value(pb) pb, any_value(na) na, any_value(nb) nb from tot, po)",
       "bo as (select stddev_samp(ha/ca-hb/cb) se_boot, 2*least(avg((ha/ca-hb/cb<=0)::int), avg((ha/ca-hb/cb>=0)::int)) p_boot from reps)") + f"""
  select {q.r6('se')} se_cluster, {q.r6('pa')} rate_a, {q.r6('pb')} rate_b, na n_a, nb n_b, {q.r6('se_boot')} se_boot, {q.r6('p_boot')} p_boot, {q.r6('pa-pb')} delta,
  {q.r6('sqrt(pa*(1-pa)/na+pb*(1-pb)/nb)')} se_row, {q.r6('(pa-pb)/sqrt(pa*(1-pa)/na+pb*(1-pb)/nb)')} z_row, {q.r6('(pa-pb)/se')} z_cluster from cl, bo""")
def _i03(spark, folder):
    pop = population(spark, folder)
    got = inf.contrast(pop.withColumn("arm", F.col("volume") > 25), pop, "arm", n_boot=4000, seed=5, block=5)
    return six(got, "se_cluster", "rate_a", "rate_b", "se_boot", "p_boot", "delta", "se_row", "z_row", "z_cluster")


@query("i04_clustered_z", popq("pd as (select date, count(*) n, sum(y)::double h from pop group by 1)") + f"""select sum(n)::bigint n, sum(h) hits, count(*) dates, {q.r6('sum(h)/sum(n)')} rate,
  {q.r6('(sum(h)-0.28::double*sum(n))/sqrt(sum(n)*0.28::double*0.72::double)')} z_row, {q.r6('sum(h-0.28::double*n)/sqrt(sum(pow(h-0.28::double*n,2)))')} z_cluster,
  {q.r6('(avg(h/n)-0.28::double)/(stddev_samp(h/n)/sqrt(count(*)))')} z_date_equal from pd""")
def _i04(spark, folder):
    return six(inf.clustered_z(population(spark, folder), 0.28), "rate", "z_row", "z_cluster", "z_date_equal")


@query("i04_subset_z", popq("g as (select sum(m) n1, sum(m*y) h1, sum(1-m) n0, sum((1-m)*y) h0 from (select *, (volume>25)::int m from pop))") + f"""
  select n1::bigint n1, h1::bigint h1, n0::bigint n0, h0::bigint h0, {q.r6('h1/n1::double')} rate_in, {q.r6('h0/n0::double')} rate_out,
  {q.r6('(h1/n1::double-h0/n0::double)/sqrt((h1+h0)/(n1+n0)::double*(1-(h1+h0)/(n1+n0)::double)*(1e0/n1+1e0/n0))')} z from g""")
def _i04s(spark, folder):
    return six(inf.subset_z(population(spark, folder).withColumn("m", F.col("volume") > 25), "m"), "rate_in", "rate_out", "z")


@query("i06_hypergeometric", popq("g as (select count(*) n, sum(y) pos from pop)", "h as (select n, pos::bigint pos, k, pos/n::double p, sqrt(pos/n::double*(1-pos/n::double)/k*(n-k)/greatest(n-1,1)) sd from g, (values (50),(250),(1000)) v(k) where k<=n)")
       + f"""select n, pos, k, {q.r6('p')} mean, {q.r6('sd')} sd, {', '.join(f"{q.r6(f'p+sd*sqrt(2*ln({m}::double))')} best_of_{m}" for m in (10, 100, 1000))} from h""")
def _i06(spark, folder):
    total = population(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    return six(inf.hypergeometric(total, [50, 250, 1000]), "mean", "sd", "best_of_10", "best_of_100", "best_of_1000")


@query("i05_null_variants")
def _i05(spark, folder):
    """Top-5 precision and AUC of the real label beside permuted, random and planted ones."""
    pop = population(spark, folder)
    rate = 0.28
    variants = {
        "real": pop.select("date", "code", "score", "y"),
        "within_date_permutation": inf.permuted_labels(pop, seed=1).select("date", "code", "score", F.col("y_null").alias("y")),
        "global_permutation": inf.permuted_labels(pop, seed=2, within_date=False).select("date", "code", "score", F.col("y_null").alias("y")),
        "bernoulli": inf.bernoulli_labels(pop, rate, seed=3).select("date", "code", "score", F.col("y_null").alias("y")),
        "noise_score": inf.noise_feature(pop, seed=4).select("date", "code", F.col("noise").alias("score"), "y"),
        "planted": inf.planted_feature(pop, seed=5).select("date", "code", F.col("planted").alias("score"), "y"),
    }
    out = None
    for name, rows in variants.items():
        part = rows.withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    out = staged(out)
    a = xs.auc(out, ["variant"]).select("variant", "auc", "rows", "positives")
    k = xs.top_k(out, 5, by=("variant", "date")).groupBy("variant").agg(F.avg("y").alias("top5_precision"))
    return a.join(k, "variant")


@query("i07_selection_budget")
def _i07(spark, folder):
    return inf.selection_budget(population(spark, folder), [1, 10, 50, 200])
