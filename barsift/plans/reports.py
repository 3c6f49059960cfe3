"""Queries on sources, joins, signal reports and audits."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6, six_digit_code, wilson
from ..functions.fixed import FEATURE_GROUPS, REGIMES
from ..functions.windows import back, histories, spread
from ..operators import audits as au
from ..operators import context, crosssec as xs, grid, inference as inf, layers, matrix, scan, scoring
from ..operators.cooldown import dedupe, first_per_year
from ..operators.outcomes import forward_outcomes, outcomes_by_regime, realised_return
from ..operators.strategies import Strategies, all_names
from ..session import staged, staging_root
from ..sources import panel as src
from ..sources.tables import bars, table
from . import rulesql as rs
from . import sqltext as q
from .features import LAYER_PARTS, MATRIX_PARTS, PRICE_PARTS, rounded
from .labels import labelled
from .registry import query
from .selection import six

B = q.with_(q.BARS)
BS = q.with_(q.BARS, q.SEQ)
LAB = q.with_(q.BARS, q.SEQ, q.label_cte("webpro"))
CUT = "2000-01-03"

NAMES = all_names()


def report_signals(spark, folder, regimes: dict | None = None) -> DataFrame:
    """Signals of a set of strategies with the short-horizon labels, written once for the reports."""
    panel = outcomes_by_regime(bars(spark, folder), regimes or {"webpro": REGIMES["webpro"]})
    cols = ("label_bull", "label_strict_low", "label_joint", "label_resolved")
    keep = tuple(f"{c}__webpro" for c in cols)
    got = scan.signals(scan.grid_rows(panel), Strategies(NAMES), keep)
    return staged(got.withColumnsRenamed({f"{c}__webpro": c for c in cols}))


SIG = q.with_(rs.PRIMS, q.label_cte("webpro"), rs.decisions_cte(NAMES), """sig as (select d.code, d.date, d.seq, d.strategy_id, d.score, l.label_bull,
  l.label_strict_low, least(l.label_bull,l.label_strict_low) label_joint, l.label_resolved from dec d join lab_webpro l using (code, date) where d.prediction=1)""")


def sigq(*ctes: str) -> str:
    return SIG.rstrip() + "".join(",\n" + c for c in ctes) + "\n"


# Sources.

_TWO = f"""src as (select *, 0 ord from bars union all select code, date, open, high+1, low, close+1, volume, 1 from bars where date>=date '{CUT}'
  union all select code, date, open, low-1, low, close, volume, 2 from bars where volume>95),
pan as (select * from (select *, row_number() over (partition by code, date order by ord desc) rn from src) where rn=1 and close>0 and high>=low)"""


def two_sources(spark, folder) -> DataFrame:
    panel = bars(spark, folder)
    later = panel.filter(F.col("date") >= F.lit(CUT).cast("date")).withColumns({"high": F.col("high") + 1, "close": F.col("close") + 1})
    broken = panel.filter("volume > 95").withColumn("high", F.col("low") - 1)
    return src.union_sources([panel, later, broken])


@query("s03_build_panel", q.with_(q.BARS, _TWO) + "select code, date, open, high, low, close, volume from pan")
def _s03(spark, folder):
    return src.build_panel(two_sources(spark, folder)).select("code", "date", "open", "high", "low", "close", "volume")


@query("a01_manifest", q.with_(q.BARS, _TWO) + """select (select count(*) from src) rows_before_dedup,
  (select count(*)-count(distinct (code, date)) from src) duplicate_rows_dropped, count(*) as "rows", count(distinct code) codes, count(distinct date) trading_days,
  min(date) date_min, max(date) date_max from pan""")
def _a01(spark, folder):
    sources = two_sources(spark, folder)
    return src.manifest(sources, src.build_panel(sources))


@query("e01_union_sources", q.with_(q.BARS, _TWO) + "select ord as source_ord, count(*) bars from src group by 1")
def _e01(spark, folder):
    return two_sources(spark, folder).groupBy("source_ord").agg(F.count(F.lit(1)).alias("bars"))


@query("e02_keep_last", q.with_(q.BARS, _TWO) + "select code, date, close, ord as source_ord from (select *, row_number() over (partition by code, date order by ord desc) rn from src) where rn=1")
def _e02(spark, folder):
    return src.keep_last(two_sources(spark, folder), ["source_ord"]).select("code", "date", "close", "source_ord")


@query("p01_valid_bars", q.with_(q.BARS, _TWO) + "select ord as source_ord, count(*) bars from src where close>0 and high>=low group by 1")
def _p01(spark, folder):
    return two_sources(spark, folder).filter(src.valid_bar()).groupBy("source_ord").agg(F.count(F.lit(1)).alias("bars"))


@query("s02_normalise_code", "select s_suppkey, case when length((s_suppkey*99991)::varchar)>=6 then (s_suppkey*99991)::varchar else lpad((s_suppkey*99991)::varchar,6,'0') end code, lpad(s_suppkey::varchar,6,'0') short from supplier")
def _s02(spark, folder):
    return table(spark, folder, "supplier").select(
        "s_suppkey", six_digit_code(F.col("s_suppkey") * 99991).alias("code"), six_digit_code("s_suppkey").alias("short"))


def _csv_folder(df: DataFrame) -> str:
    path = f"{staging_root(df.sparkSession)}/csv-{uuid4().hex}"
    df.write.option("header", True).csv(path)
    return path


@query("s01_load_source", B + "select code, date, open, high, low, close, case when volume>90 then null else volume end volume, true tagged from bars")
def _s01(spark, folder):
    """Bars written as CSV with unreadable volumes, and read back as a source."""
    text = bars(spark, folder).select(F.col("code").cast("int").alias("code"), "date", "open", "high", "low", "close",
                                      F.when(F.col("volume") > 90, F.lit("n/a")).otherwise(F.col("volume").cast("string")).alias("volume"))
    got = src.read_bar_csv(spark, _csv_folder(text))
    return got.select("code", "date", "open", "high", "low", "close", "volume", F.col("source_file").endswith(".csv").alias("tagged"))


@query("s08_read_signals", sigq() + f"select code, date, strategy_id, {q.r6('score')} score, label_bull::double label_bull from sig")
def _s08(spark, folder):
    got = report_signals(spark, folder).select("code", "date", "strategy_id", "score", "label_bull")
    read = src.read_signals(spark, _csv_folder(got), ["code", "date", "strategy_id", "score", "label_bull"])
    return six(read, "score")


@query("s04_stored_panel", B + f"select count(*) bars, count(distinct code) codes, {q.r6('sum(close)', 4)} total_close from bars")
def _s04(spark, folder):
    path = f"{staging_root(spark)}/panel-{uuid4().hex}"
    got = src.load_panel(spark, path, lambda: bars(spark, folder))
    return got.agg(F.count(F.lit(1)).alias("bars"), F.countDistinct("code").alias("codes"), r6(F.sum("close"), 4).alias("total_close"))


@query("s05_code_layout", B + "select code, count(*) bars, 1 parts from bars group by 1")
def _s05(spark, folder):
    laid = src.by_code_layout(bars(spark, folder), 16).withColumn("_part", F.spark_partition_id())
    return laid.groupBy("code").agg(F.count(F.lit(1)).alias("bars"), F.countDistinct("_part").alias("parts"))


@query("s06_read_table", "select o_orderstatus, count(*) orders from orders group by 1")
def _s06(spark, folder):
    return src.read_table(spark, f"{folder}/orders.parquet").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


@query("s09_report_sink", B + f"select code, count(*)::varchar bars, min(low)::double lowest from bars group by 1")
def _s09(spark, folder):
    path = f"{staging_root(spark)}/report-{uuid4().hex}"
    src.write_report(bars(spark, folder).groupBy("code").agg(F.count(F.lit(1)).alias("bars"), F.min("low").alias("lowest")), path)
    return spark.read.schema("code string, bars string, lowest double").option("header", True).csv(path)


@query("s11_matrix_store", B + "select stride, count(*) row_count from bars, (values (5)) v(stride) group by 1")
def _s11(spark, folder):
    path = f"{staging_root(spark)}/matrix-{uuid4().hex}"
    rows = bars(spark, folder).select("code", "date", "close")
    src.write_matrix(rows, path, 10, 0.3, 5)
    src.write_matrix(rows, path, 10, 0.3, 25)
    return src.load_matrix(spark, path, 10, 0.3).groupBy("stride").agg(F.count(F.lit(1)).alias("row_count"))


# Grids and filters.

@query("p02_scan_grid", BS + "select code, date, seq::bigint seq from s where seq>=60 and seq%5=0")
def _p02(spark, folder):
    return grid.scan_grid(bars(spark, folder)).select("code", "date", F.col("seq").cast("bigint").alias("seq"))


@query("p03_scan_targets", B + f"""select code, date from (select *, row_number() over (partition by code order by date)-1 i from bars
  where date>=date '1997-01-06' and date<=date '{CUT}') where i>=60 and i%5=0""")
def _p03(spark, folder):
    return grid.scan_targets(bars(spark, folder), start="1997-01-06", end=CUT)


@query("p04_row_stride", B + "select code, date, rn row_no from (select *, row_number() over (order by code, date)-1 rn from bars) where rn%7=0")
def _p04(spark, folder):
    return grid.row_stride(bars(spark, folder), 7).select("code", "date", "row_no")


@query("p05_session_stride", B + "select code, date from bars where date in (select date from (select date, row_number() over (order by date)-1 i from (select distinct date from bars)) where i%5=0)")
def _p05(spark, folder):
    return grid.session_stride(bars(spark, folder), 5).select("code", "date")


@query("p07_resolved_only", LAB + "select code, count(*) bars, sum(label_bull)::bigint hits from lab_webpro where label_resolved group by 1")
def _p07(spark, folder):
    return labelled(spark, folder, "webpro").filter("label_resolved").groupBy("code").agg(
        F.count(F.lit(1)).alias("bars"), F.sum("label_bull").alias("hits"))


@query("p09_feature_groups", q.with_(*PRICE_PARTS) + "select code, date, " + ", ".join(f"{q.r6(c)} {c}" for c in (*FEATURE_GROUPS["position"], *FEATURE_GROUPS["candle"])) + " from q4")
def _p09(spark, folder):
    df = matrix.with_price_features(bars(spark, folder)).drop("_up", "open", "high", "low", "close", "volume")
    return rounded(df, matrix.select_features(df, ["position", "candle"]))


@query("p10_checked_features", q.with_(*PRICE_PARTS) + f"select code, date, {q.r6('ret5')} ret5, {q.r6('atr14_pct')} atr14_pct from q4")
def _p10(spark, folder):
    df = matrix.with_price_features(bars(spark, folder))
    return rounded(matrix.checked_features(df, ["ret5", "atr14_pct"]), ["ret5", "atr14_pct"])


_BROKEN = f"""bk as (select code, date, open, case when volume>80 then low-1 else high end high, low, close, case when volume<3 then -volume when volume=33 then null else volume end volume from bars)"""


@query("p12_bar_violations", q.with_(q.BARS, _BROKEN) + """select code, date, 'high_below_body' violation from bk where high<greatest(open,close,low)
  union all select code, date, 'low_above_body' from bk where low>least(open,close,high)
  union all select code, date, 'negative_volume' from bk where volume<0 union all select code, date, 'not_finite' from bk where volume is null""")
def _p12(spark, folder):
    v = F.col("volume")
    df = bars(spark, folder).withColumns({"high": F.when(v > 80, F.col("low") - 1).otherwise(F.col("high")),
                                          "volume": F.when(v < 3, -v).when(v == 33, F.lit(None)).otherwise(v)})
    return au.bar_violations(df)


# Joins.

@query("j01_signals_with_labels", sigq() + "select strategy_id, code, date, label_bull, label_resolved from sig")
def _j01(spark, folder):
    got = scan.signals(scan.grid_rows(bars(spark, folder)), Strategies(NAMES))
    lab = labelled(spark, folder, "webpro").select("code", "date", "label_bull", "label_resolved")
    return got.join(lab, ["code", "date"], "left").select("strategy_id", "code", "date", "label_bull", "label_resolved")


@query("j02_layers_with_labels", q.with_(*LAYER_PARTS, q.label_cte("webpro")) + "select lay.code, lay.date, recall_tier, label_bull, label_resolved from lay join lab_webpro using (code, date) where recall_tier>=1")
def _j02(spark, folder):
    lay = layers.with_layers(bars(spark, folder)).filter("recall_tier >= 1").select("code", "date", "recall_tier")
    return lay.join(labelled(spark, folder, "webpro").select("code", "date", "label_bull", "label_resolved"), ["code", "date"], "left")


@query("j03_signals_with_next_bar", sigq("nb as (select code, date, lead(open) over (partition by code order by date) next_open from bars)") + "select strategy_id, code, date, next_open from sig left join nb using (code, date)")
def _j03(spark, folder):
    nxt = bars(spark, folder).select("code", "date", back("open", -1).alias("next_open"))
    return report_signals(spark, folder).join(nxt, ["code", "date"], "left").select("strategy_id", "code", "date", "next_open")


@query("j04_rows_with_market", q.with_(*PRICE_PARTS) + f"select code, date, {q.r6('mkt')} mkt_ret1 from q4 join (select date, avg(ret1) mkt from q4 group by 1) using (date)")
def _j04(spark, folder):
    df = matrix.with_price_features(bars(spark, folder))
    return six(df.join(matrix.market_series(df).select("date", "mkt_ret1"), "date").select("code", "date", "mkt_ret1"), "mkt_ret1")


@query("j05_panel_against_source", q.with_(q.BARS, _TWO) + """select count(*) checked, sum((round(p.close,6)<>round(b.close,6))::int)::bigint close_mismatch,
  sum((round(p.volume,6)<>round(b.volume,6))::int)::bigint volume_mismatch from pan p join bars b using (code, date)""")
def _j05(spark, folder):
    return au.source_mismatches(src.build_panel(two_sources(spark, folder)), bars(spark, folder))


_WIN = sigq("sgw as (select *, seq si from sig where strategy_id='rsi_mean_reversion')", "tt as (select code, max(seq)+1 n from s group by 1)",
            "wd as (select g.code, g.date signal_date, s.seq-g.si ofs, s.open, s.high, s.close from sgw g join tt using (code) join s on s.code=g.code and s.seq between g.si-60 and g.si+59 where least(g.si,60)+least(n-g.si,60)>=61)")


@query("j08_signal_windows", _WIN + 'select code, signal_date, ofs::bigint as "offset", close from wd')
def _j08(spark, folder):
    sg = report_signals(spark, folder).filter("strategy_id = 'rsi_mean_reversion'").select("code", "date")
    return au.signal_windows(bars(spark, folder), sg).select("code", "signal_date", F.col("offset").cast("bigint").alias("offset"), "close")


@query("w26_window_marks", _WIN + f"""select code, signal_date, count(*) window_bars, (-min(ofs))::bigint signal_pos, max(case when ofs=1 then open end) entry,
  {q.r6('max(case when ofs=1 then open end)*1.3::double')} target, min(case when ofs>=1 and high>=en*1.3::double then ofs end)::bigint first_touch
  from (select *, max(case when ofs=1 then open end) over (partition by code, signal_date) en from wd) group by 1,2""")
def _w26(spark, folder):
    sg = report_signals(spark, folder).filter("strategy_id = 'rsi_mean_reversion'").select("code", "date")
    got = au.window_marks(au.signal_windows(bars(spark, folder), sg), ["code", "signal_date"], 1.3)
    return six(got.withColumns({c: F.col(c).cast("bigint") for c in ("signal_pos", "first_touch")}), "target")


@query("j09_cards", BS + f"""select code, date observation_date, 60 bars, {q.r6('avg(close) over w')} mean_close from s
  window w as (partition by code order by date rows 59 preceding) qualify seq>=60 and seq%5=0""")
def _j09(spark, folder):
    cards = cards_of(spark, folder)
    return cards.select("code", "observation_date", F.size("bars").alias("bars"), r6(
        F.aggregate("bars", F.lit(0.0), lambda a, b: a + b["close"]) / 60).alias("mean_close"))


def cards_of(spark, folder) -> DataFrame:
    # Cards hold sixty bars each; a fixed number of parts keeps a task's share of them small.
    panel = spread(bars(spark, folder), "code")
    return au.make_cards(context.with_kdj(panel).withColumn("turnover", F.col("volume")), rows=grid.scan_grid)


@query("j10_labels_with_features", LAB + "select count(*) bars, 0 repeated_keys, count(label_bull) with_label from s left join lab_webpro using (code, date)")
def _j10(spark, folder):
    panel, lab = bars(spark, folder), labelled(spark, folder, "webpro").select("code", "date", "label_bull")
    dup = lab.groupBy("code", "date").count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated_keys"))
    got = panel.join(lab, ["code", "date"], "left").agg(F.count(F.lit(1)).alias("bars"), F.count("label_bull").alias("with_label"))
    return got.join(F.broadcast(dup))


@query("k44_validate_cards", sigq("dc as (select d.strategy_id, d.prediction p, l.label_bull a from dec d join lab_webpro l using (code, date) where strategy_id in ('donchian_turtle','rsi_mean_reversion') and label_resolved)") + f"""
  select strategy_id, sum((p=1 and a=1)::int)::bigint tp, sum((p=0 and a=0)::int)::bigint tn, sum((p=1 and a=0)::int)::bigint fp, sum((p=0 and a=1)::int)::bigint fn, 0 errors,
  {q.r6('avg((p=a)::int)')} accuracy from dc group by 1""")
def _k44(spark, folder):
    """Cards exploded to bars, scored again from the card alone, and compared with the outcomes."""
    rows = au.explode_cards(cards_of(spark, folder))
    with histories("code", "observation_date"):
        rows = scan.with_primitives(rows)
    rows = rows.filter(F.col("date") == F.col("observation_date"))
    got = scan.decisions(rows, Strategies(["donchian_turtle", "rsi_mean_reversion"]))
    lab = labelled(spark, folder, "webpro").filter("label_resolved").select("code", "date", F.col("label_bull").alias("actual"))
    out = scoring.confusion(got.join(lab, ["code", "date"]), ["strategy_id"])
    return six(out.select("strategy_id", "tp", "tn", "fp", "fn", "errors", "accuracy"), "accuracy")


# Labels on signals.

@query("l04_cooldown", q.with_(q.BARS, q.SEQ, q.KDJ, "sg as (select r.code, r.date from rsv r join kd using (code, seq) where k<20)", q.dedupe_cte("sg", "dd", [], 20)) + "select code, date from dd")
def _l04(spark, folder):
    return dedupe(context.with_kdj(bars(spark, folder)).filter("kdj_k < 20").select("code", "date"), 20)


@query("l06_first_per_year", sigq() + "select strategy_id, code, date, label_bull from (select *, row_number() over (partition by strategy_id, code, year(date) order by date) rn from sig) where rn=1")
def _l06(spark, folder):
    return first_per_year(report_signals(spark, folder), ["strategy_id"]).select("strategy_id", "code", "date", "label_bull")


@query("l08_population_provenance", LAB + """select 'panel' population, 'panel_stride1_minhist0' population_id, count(*) row_count, min(date) date_min, max(date) date_max from lab_webpro where label_resolved
  union all select 'scanned', 'scanned_stride5_minhist60', count(*), min(date), max(date) from lab_webpro where label_resolved and seq>=60 and seq%5=0""")
def _l08(spark, folder):
    lab = labelled(spark, folder, "webpro")
    parts = []
    for name, rows, st, mh in (("panel", lab, 1, 0), ("scanned", grid.scan_grid(lab).drop("seq"), 5, 60)):
        parts.append(scoring.base_rates(rows, [], name, st, mh).select(
            F.lit(name).alias("population"), "population_id", F.col("evaluated_points").alias("row_count"), "date_min", "date_max"))
    return parts[0].unionByName(parts[1])


@query("l09_lift", sigq("lv as (select * from sig where label_resolved)", q.dedupe_cte("lv", "dd", ["strategy_id"], 60), "bs as (select avg(label_bull) b from lab_webpro where label_resolved and seq>=60 and seq%5=0)")
       + f"select strategy_id, {q.r6('avg(label_bull)')} bull_precision_deduped, {q.r6('any_value(b)')} baseline, {q.r6('avg(label_bull)/any_value(b)')} lift from dd, bs group by 1")
def _l09(spark, folder):
    rep = scoring.hit_rates(report_signals(spark, folder), ["strategy_id"]).withColumns({
        "population_id": F.lit(scoring.population_id("scanned")), "regime": F.lit("webpro")})
    base = scoring.base_rates(grid.scan_grid(labelled(spark, folder, "webpro")).withColumn("regime", F.lit("webpro")), ["regime"])
    out = scoring.with_lift(rep, base, ["regime"]).filter("signals_deduped > 0")
    return six(out.select("strategy_id", "bull_precision_deduped", "baseline", "lift"), "bull_precision_deduped", "baseline", "lift")


_TR = """nx as (select code, date, close pc, lead(open) over w no, lead(high) over w nh, lead(low) over w nl, lead(volume) over w nv from bars window w as (partition by code order by date)),
tf as (select sig.*, no/(pc+1e-12)-1 gap_pct, coalesce(no/(pc+1e-12)-1>=(case when substr(code,1,3) in ('300','688','301') then 0.20::double else 0.10::double end)-0.005::double,false) oal,
  coalesce(abs(nh-no)<1e-9 and abs(nl-no)<1e-9,false) flat, no is null or coalesce(nv,0)<=0 nnb from sig left join nx using (code, date))"""


@query("l10_tradeability_flags", sigq(_TR) + f"select strategy_id, code, date, {q.r6('gap_pct')} gap_pct, oal open_at_limit, oal and flat one_word_limit, nnb no_next_bar, oal or nnb unfillable from tf")
def _l10(spark, folder):
    got = scoring.tradeability(report_signals(spark, folder), bars(spark, folder))
    return six(got.select("strategy_id", "code", "date", "gap_pct", "open_at_limit", "one_word_limit", "no_next_bar", "unfillable"), "gap_pct")


_T07 = f"""select coalesce(strategy_id,'ALL') as "label", count(*) signals_raw, count(*) filter (label_resolved) signals, count(*) filter (not label_resolved) censored,
  count(*) filter (label_bull=1) hits, count(*) filter (label_resolved and (oal or nnb)) unfillable, count(*) filter (label_resolved and oal and flat) one_word_limit,
  count(*) filter (label_resolved and oal) gapped_at_limit, count(*) filter (label_resolved and nnb) no_next_bar, count(*) filter (label_resolved and not (oal or nnb)) tradeable_signals,
  count(*) filter (label_bull=1 and not (oal or nnb)) tradeable_hits from tf group by rollup(strategy_id)"""


@query("a07_tradeability", sigq(_TR, f"t7 as ({_T07})") + f"""select *, {q.r6('hits/signals::double')} hit_rate, {q.r6('unfillable/signals::double')} unfillable_pct,
  {q.r6('tradeable_hits/nullif(tradeable_signals,0)::double')} tradeable_hit_rate from t7""")
def _a07(spark, folder):
    got = scoring.tradeability_report(scoring.tradeability(report_signals(spark, folder), bars(spark, folder)))
    return six(got, "hit_rate", "unfillable_pct", "tradeable_hit_rate")


@query("t01_worst_tradeability", sigq(_TR, f"t7 as ({_T07})") + f"""select "label", signals, {q.r6('unfillable/signals::double')} unfillable_pct from t7 where "label"<>'ALL' order by unfillable/signals::double desc, "label" limit 3""")
def _t01(spark, folder):
    got = scoring.tradeability_report(scoring.tradeability(report_signals(spark, folder), bars(spark, folder)))
    top = got.filter("label <> 'ALL'").orderBy(F.desc("unfillable_pct"), "label").limit(3)
    return six(top.select("label", "signals", "unfillable_pct"), "unfillable_pct")


_RR = "rr as (select code, date, lead(close,10) over w/lead(open) over w-1 r from bars window w as (partition by code order by date))"


@query("w24_realised_return", q.with_(q.BARS, _RR) + f"select code, date, {q.r6('r')} return_h from rr")
def _w24(spark, folder):
    return realised_return(bars(spark, folder), 10).select("code", "date", r6(F.col("return_h")).alias("return_h"))


@query("a08_holding_report", sigq(_RR) + f"""select strategy_id, count(*) signals, count(r) resolved, {q.r6('avg(r)')} gross_mean_return, {q.r6('quantile_cont(r,0.5)')} gross_median_return,
  {q.r6('avg(r-0.00102)')} net_mean_return, {q.r6('quantile_cont(r,0.5)-0.00102')} net_median_return, {q.r6('avg((r-0.00102::double>0)::int)')} net_win_rate,
  {q.r6('quantile_cont(r,0.1)-0.00102')} net_p10, {q.r6('quantile_cont(r,0.9)-0.00102')} net_p90, 10 horizon_sessions, 10.2::double cost_bps_round_trip from sig left join rr using (code, date) group by 1""")
def _a08(spark, folder):
    got = scoring.holding_report(report_signals(spark, folder), bars(spark, folder), 10, ["strategy_id"])
    return six(got, "gross_mean_return", "gross_median_return", "net_mean_return", "net_median_return", "net_win_rate", "net_p10", "net_p90")


_EX = f"""ex as (select strategy_id, count(*) signals, {q.r6('avg((label_bull is not null and label_bull=1)::int)')} hit_rate, {q.r6('avg(r-0.00102)')} net_expectancy, {q.r6('quantile_cont(r,0.5)-0.00102')} net_median,
  {q.r6('avg((r-0.00102::double>0)::int)')} net_win_rate, {q.r6('avg(case when label_bull=1 then 0.3::double-0.00102 else r-0.00102 end)')} net_expectancy_at_target,
  {q.r6('avg(case when label_bull=1 then r end)')} mean_return_if_hit, {q.r6('avg(case when label_bull is null or label_bull<>1 then r end)')} mean_return_if_miss,
  {q.r6('avg(case when label_bull=1 then (r<=0.00102::double)::int end)')} pct_hits_that_did_not_beat_cost from sig join rr using (code, date) where r is not null group by 1)"""


@query("a09_expectancy", sigq(_RR, _EX) + "select * from ex")
def _a09(spark, folder):
    got = scoring.expectancy_report(report_signals(spark, folder), bars(spark, folder), 10, 0.30, ["strategy_id"])
    return six(got, *[c for c in got.columns if c not in ("strategy_id", "signals")])


@query("a06_date_concentration", sigq() + f"select strategy_id, {q.r6('sum(n*n)/(sum(n)*sum(n))')} hhi_date_concentration from (select strategy_id, date, count(*)::double n from sig group by all) group by 1")
def _a06(spark, folder):
    return six(scoring.date_concentration(report_signals(spark, folder), ["strategy_id"]), "hhi_date_concentration")


@query("a10_confusion", "with c as (select d.lang, (n_chars>1500)::int p, quality a from documents d join labels using (doc_id)), k as (select lang, sum((p=1 and a=1)::int)::bigint tp, sum((p=0 and a=0)::int)::bigint tn, sum((p=1 and a=0)::int)::bigint fp, sum((p=0 and a=1)::int)::bigint fn from c group by 1) "
       + f"""select lang, tp, tn, fp, fn, {q.r6('(tp+tn)/(tp+tn+fp+fn)::double')} accuracy, {q.r6('tp/nullif(tp+fn,0)::double')} positive_recall, {q.r6('tp/nullif(tp+fp,0)::double')} yes_precision, {q.r6('(tp+fp)/(tp+tn+fp+fn)::double')} yes_rate,
  {q.r6(q.wilson_sql('tp+tn', 'tp+tn+fp+fn')[0])} accuracy_low, {q.r6(q.wilson_sql('tp+tn', 'tp+tn+fp+fn')[1])} accuracy_high from k""")
def _a10(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", (F.col("n_chars") > 1500).cast("int").alias("prediction"))
    rows = docs.join(table(spark, folder, "labels").select("doc_id", F.col("quality").alias("actual")), "doc_id")
    got = scoring.confusion(rows, ["lang"])
    return six(got.select("lang", "tp", "tn", "fp", "fn", "accuracy", "positive_recall", "yes_precision", "yes_rate", "accuracy_low", "accuracy_high"),
               "accuracy", "positive_recall", "yes_precision", "yes_rate", "accuracy_low", "accuracy_high")


@query("a11_disagreement", sigq() + f"""select a.strategy_id strategy_a, b.strategy_id strategy_b, count(*) samples, {q.r6('avg((a.prediction<>b.prediction)::int)')} disagreement
  from dec a join dec b on a.code=b.code and a.date=b.date and list_position([{','.join(f"'{n}'" for n in NAMES)}], a.strategy_id)<list_position([{','.join(f"'{n}'" for n in NAMES)}], b.strategy_id) group by all""")
def _a11(spark, folder):
    got = scan.decisions(scan.grid_rows(bars(spark, folder)), Strategies(NAMES))
    return six(scoring.disagreement(got, ["code", "date"], NAMES), "disagreement")


@query("a04_tier_base_rates", q.with_(*LAYER_PARTS, q.label_cte("webpro")) + f"""select count(*) candidates, {q.r6('avg(label_bull)')} bull_rate, {q.r6('avg(least(label_bull,label_strict_low))')} joint_rate, {q.r6('avg(label_strict_low)')} strict_low_rate,
  {', '.join(f"{q.r6(f'avg(case when recall_tier>={k} then label_bull end)')} rate_tier_{k}" for k in range(1, 6))} from lay join lab_webpro using (code, date) where label_resolved""")
def _a04(spark, folder):
    lay = layers.with_layers(bars(spark, folder)).drop("year")
    lab = forward_outcomes(lay, *(REGIMES["webpro"][:2])).filter("label_resolved")
    got = lab.agg(F.count(F.lit(1)).alias("candidates"), F.avg("label_bull").alias("bull_rate"), F.avg("label_joint").alias("joint_rate"),
                  F.avg("label_strict_low").alias("strict_low_rate"), *scoring.tier_rates(lab))
    return six(got, *got.columns[1:])


@query("t12_balanced_sample", sigq("sk as (select strategy_id, label_bull, code, date, row_number() over (partition by strategy_id, label_bull order by date, code)-1 i, count(*) over (partition by strategy_id, label_bull) n from sig where label_bull is not null)",
       "sb as (select *, case when n<=12 then i else ceil((i+1)*12/n::double)-1 end b from sk)", "so as (select *, row_number() over (partition by strategy_id, label_bull order by case when n<=12 then 0 else i-floor(b*n/12e0) end, b) k from sb)")
       + "select strategy_id, label_bull, code, date, k sample_no from so where k<=10")
def _t12(spark, folder):
    got = xs.balanced_sample(report_signals(spark, folder), ["strategy_id"], 10)
    return got.select("strategy_id", "label_bull", "code", "date", "sample_no")


@query("t14_true_rates", sigq("lv as (select * from sig where label_resolved)", q.dedupe_cte("lv", "dd", ["strategy_id"], 60), "tr as (select strategy_id, avg(label_bull) p from dd group by 1)",
       "fy as (select * from (select *, row_number() over (partition by strategy_id, code, year(date) order by date) rn from sig) where rn=1)") + f"select strategy_id, code, date, {q.r6('p')} population_hit_rate from fy left join tr using (strategy_id)")
def _t14(spark, folder):
    sg = report_signals(spark, folder)
    rates = scoring.hit_rates(sg, ["strategy_id"]).select("strategy_id", F.col("bull_precision_deduped").alias("population_hit_rate"))
    return six(first_per_year(sg, ["strategy_id"]).join(rates, "strategy_id", "left").select("strategy_id", "code", "date", "population_hit_rate"), "population_hit_rate")


@query("e03_shared_dates", sigq() + "select distinct date from sig where strategy_id='donchian_turtle' intersect select distinct date from sig where strategy_id='pullback_retest'")
def _e03(spark, folder):
    sg = report_signals(spark, folder)
    return sg.filter("strategy_id = 'donchian_turtle'").select("date").intersect(sg.filter("strategy_id = 'pullback_retest'").select("date"))


@query("e04_key_differences", LAB + "select 'grid_only' side, code, date from s where seq>=60 and seq%5=0 and seq%10<>0 union all select 'other_only', code, date from s where seq>=60 and seq%10=0 and seq%5<>0")
def _e04(spark, folder):
    # Two columns of a bar shuffle as few bytes; whole histories are dealt over all shuffle partitions.
    panel = spread(bars(spark, folder).select("code", "date"), "code")
    return au.key_differences(grid.scan_targets(panel), grid.scan_targets(panel, stride=10), "grid_only", "other_only")


# Scalar families.

@query("scalar_math", B + f"""select code, date, {q.r6('ln(close)')} ln_close, {q.r6('exp(-volume/100)')} decay, {q.r6('sqrt(volume)')} root, {q.r6('abs(close-open)')} move, sign(close-open)::int direction,
  {q.r6('case when abs(high-low)>=1e-12 then (close-low)/(high-low) end')} inside, {q.r6('greatest(0e0,least(1e0,(close-22)/5))')} clipped from bars""")
def _sm(spark, folder):
    from ..functions.columns import clip, guarded
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    return bars(spark, folder).select(
        "code", "date", r6(F.ln(c)).alias("ln_close"), r6(F.exp(-v / 100)).alias("decay"), r6(F.sqrt(v)).alias("root"), r6(F.abs(c - o)).alias("move"),
        F.signum(c - o).cast("int").alias("direction"), r6(guarded(c - lo, h - lo)).alias("inside"), r6(clip((c - 22) / 5)).alias("clipped"))


@query("scalar_dates", B + "select code, date, year(date)::int y, date_trunc('month',date)::date m, strftime(date,'%Y-%m-%d') day_text, isodow(date)::int weekday from bars")
def _sdts(spark, folder):
    return bars(spark, folder).select(
        "code", "date", F.year("date").alias("y"), F.trunc("date", "month").alias("m"), F.date_format("date", "yyyy-MM-dd").alias("day_text"), (F.weekday("date") + 1).alias("weekday"))


@query("scalar_strings_hash", B + "select code, date, substr(code,1,3) prefix, substr(code,1,3) in ('300','688','301') wide_board, sha256(code||'|'||strftime(date,'%Y-%m-%d')) id from bars")
def _ssh(spark, folder):
    return bars(spark, folder).select(
        "code", "date", F.substring("code", 1, 3).alias("prefix"), F.substring("code", 1, 3).isin("300", "688", "301").alias("wide_board"),
        F.sha2(F.concat_ws("|", "code", F.date_format("date", "yyyy-MM-dd")), 256).alias("id"))


@query("scalar_json_map", "select event_type, count(*) events, sum((json_extract(props,'$.k'))::bigint)::bigint k_sum from events group by 1")
def _sj(spark, folder):
    ev = table(spark, folder, "events").withColumn("p", F.from_json("props", "k bigint"))
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("p.k").alias("k_sum"))


@query("scalar_arrays", B + f"""select code, date, {q.r6('list_aggregate(l[-3:],$$avg$$)')} mean_last3, {q.r6('list_aggregate(l[:3],$$avg$$)')} mean_first3, len(list_filter(l, lambda x: x>=28))::int events
  from (select code, date, list(close) over (partition by code order by date rows 9 preceding) l from bars)""".replace("$$", "'"))
def _sa(spark, folder):
    from ..functions.windows import span
    df = bars(spark, folder).withColumn("l", F.collect_list("close").over(span(-9, 0)))

    def mean(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    last = F.slice("l", F.greatest(F.size("l") - 2, F.lit(1)), F.lit(3))
    return df.select("code", "date", r6(mean(last)).alias("mean_last3"), r6(mean(F.slice("l", 1, 3))).alias("mean_first3"),
                     F.size(F.filter("l", lambda x: x >= 28)).alias("events"))


# Audits.

@query("a02_verify_panel", q.with_(q.BARS, _TWO) + """select count(*) as "rows", count(distinct code) codes, min(date) date_min, max(date) date_max, 0 null_close, 0 nonpositive_close, sum((high<low)::int)::bigint bad_hl_bracket,
  sum((close>high or close<low)::int)::bigint close_outside_bracket, sum((volume=0)::int)::bigint zero_volume_rows, count(*)-count(distinct (code,date)) duplicate_code_date, count(*)=count(distinct (code,date)) monotonic_dates_per_code from src""")
def _a02(spark, folder):
    return au.verify_panel(two_sources(spark, folder).drop("source_ord"))


def _census_parts() -> str:
    pops = {"panel": "true", "early": "seq<60", "late": "seq>=60", "scanned": "seq>=60 and seq%5=0", **{f"late_residue_{r}": f"seq>=60 and seq%5={r}" for r in range(5)}}
    return " union all ".join(f"select '{n}' population, count(*) n, sum(label_bull)::bigint hits, {q.r6('avg(label_bull)')} rate, min(date) date_min, max(date) date_max, min(seq)::bigint seq_min, max(seq)::bigint seq_max from lab_webpro where label_resolved and ({c})" for n, c in pops.items())


def _seq_labelled(spark, folder) -> DataFrame:
    from ..functions.windows import seq
    return labelled(spark, folder, "webpro").withColumn("seq", seq())


def _census(spark, folder) -> DataFrame:
    got = au.census(_seq_labelled(spark, folder), 5, 60)
    return six(got.withColumns({c: F.col(c).cast("bigint") for c in ("seq_min", "seq_max")}), "rate")


query("a20_census", LAB + _census_parts())(_census)


@query("a21_residue_table", LAB + f"select (seq%5)::bigint residue, count(*) n, {q.r6('avg(label_bull)')} rate from lab_webpro where label_resolved group by 1")
def _a21(spark, folder):
    return six(_seq_labelled(spark, folder).filter("label_resolved").groupBy((F.col("seq") % 5).cast("bigint").alias("residue")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("label_bull").alias("rate")), "rate")


@query("q04_population_identity", LAB + """select sum((label_resolved)::int)::bigint panel_n, sum((label_resolved and seq>=60 and seq%5=0)::int)::bigint scanned_n, true residues_add_up, true early_late_add_up from lab_webpro""")
def _q04(spark, folder):
    c = au.census(_seq_labelled(spark, folder), 5, 60)

    def n(cond, col="n"):
        return F.sum(F.when(cond, F.col(col)).otherwise(0))

    p = F.col("population")
    return c.agg(n(p == "panel").alias("panel_n"), n(p == "scanned").alias("scanned_n"),
                 ((n(p.startswith("late_residue")) == n(p == "late")) & (n(p.startswith("late_residue"), "hits") == n(p == "late", "hits"))).alias("residues_add_up"),
                 (n(p == "early") + n(p == "late") == n(p == "panel")).alias("early_late_add_up"))


@query("a22_standardised_rates", LAB + ",\nst as (select date_trunc('month',date) m, sum(a) na, sum(a*label_bull) ha, sum(1-a) nb, sum((1-a)*label_bull) hb from (select *, (seq%5=0)::int a from lab_webpro where label_resolved and seq>=60) group by 1)".lstrip() + f"""
  select count(*) strata, {q.r6('sum(ha)/sum(na)::double')} rate_a, {q.r6('sum(hb)/sum(nb)::double')} rate_b, {q.r6('sum(ha/na::double*nb)/sum(nb)')} a_at_b_mix, {q.r6('sum(hb/nb::double*na)/sum(na)')} b_at_a_mix from st where na>0 and nb>0""")
def _a22(spark, folder):
    rows = _seq_labelled(spark, folder).filter("label_resolved and seq >= 60").select("date", F.col("label_bull").alias("y"), (F.col("seq") % 5 == 0).alias("a"))
    return six(au.standardised_rates(rows, "a"), "rate_a", "rate_b", "a_at_b_mix", "b_at_a_mix")


@query("i04_two_arm_z", LAB + ",\npd as (select date, sum(a)::double na, sum(a*label_bull)::double ha, sum(1-a)::double nb, sum((1-a)*label_bull)::double hb from (select *, (seq%5=0)::int a from lab_webpro where label_resolved) group by 1),\nto_ as (select sum(na) tna, sum(ha) tha, sum(nb) tnb, sum(hb) thb from pd),\nsh as (select ha/na ra, hb/nb rb from pd where na>0 and nb>0)".lstrip() + f"""
  select any_value(tna) n_a, any_value(tnb) n_b, {q.r6('any_value(tha/tna)')} rate_a, {q.r6('any_value(thb/tnb)')} rate_b, (select count(*) from sh) shared_dates,
  {q.r6('any_value((tha/tna-thb/tnb)/sqrt((tha+thb)/(tna+tnb)*(1-(tha+thb)/(tna+tnb))*(1/tna+1/tnb)))')} z_row,
  {q.r6('any_value(tha/tna-thb/tnb)/sqrt(sum(pow(ha-tha/tna*na,2))/any_value(tna*tna)+sum(pow(hb-thb/tnb*nb,2))/any_value(tnb*tnb))')} z_cluster,
  {q.r6('(select (avg(ra)-avg(rb))/sqrt(var_samp(ra)/count(*)+var_samp(rb)/count(*)) from sh)')} z_date_equal from pd, to_""")
def _i04t(spark, folder):
    rows = _seq_labelled(spark, folder).filter("label_resolved").select("date", F.col("label_bull").alias("y"), (F.col("seq") % 5 == 0).alias("a"))
    return six(inf.arm_z(rows, "a"), "rate_a", "rate_b", "z_row", "z_cluster", "z_date_equal")


_KEEP = LAB + ",\nkp as (select s.*, label_bull, (row_number() over (order by s.code, s.date)-1)%5=0 kept from s join lab_webpro using (code, date)),\nqe as (select quantile_cont(close,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) e from kp)".lstrip()


def kept_rows(spark, folder) -> DataFrame:
    lab = labelled(spark, folder, "webpro")
    kept = grid.row_stride(lab.select("code", "date"), 5).select("code", "date", F.lit(True).alias("kept"))
    return lab.join(kept, ["code", "date"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@query("a24_inclusion", _KEEP + f"""select 'label' as "by", label_bull::varchar as "value", count(*) n, {q.r6('avg(kept::int)')} kept_share from kp group by 2
  union all select 'weekday', isodow(date)::varchar, count(*), {q.r6('avg(kept::int)')} from kp group by 2
  union all select 'decile', len(list_filter(e, lambda x: close>x))::varchar, count(*), {q.r6('avg(kept::int)')} from kp, qe group by 2""")
def _a24(spark, folder):
    rows = staged(kept_rows(spark, folder).select("code", "date", "close", "label_bull", "kept"))
    parts = [au.inclusion_by(rows, "kept", F.col("label_bull"), "label"), au.inclusion_by(rows, "kept", F.weekday("date") + 1, "weekday"),
             au.inclusion_by(au.decile_of(rows, "close"), "kept", F.col("decile"), "decile")]
    return six(parts[0].unionByName(parts[1]).unionByName(parts[2]), "kept_share")


@query("a25_mean_differences", _KEEP + " union all ".join(f"select '{c}' feature, {q.r6(f'avg({c})')} full_mean, {q.r6(f'avg(case when kept then {c} end)')} kept_mean, {q.r6(f'(avg(case when kept then {c} end)-avg({c}))/(stddev_pop({c})+1e-12)')} smd from kp" for c in ("close", "volume", "high")))
def _a25(spark, folder):
    return six(au.mean_differences(kept_rows(spark, folder), "kept", ["close", "volume", "high"]), "full_mean", "kept_mean", "smd")


def _struct_sql(cond: str, name: str) -> str:
    return f"""select '{name}' rule, count(*) sessions_kept, sum(n)::bigint rows_kept, {q.r6('avg(n)')} names_per_session, min(n) names_min, max(n) names_max, (select count(distinct date) from bars) sessions, (select count(*) from bars) as "rows"
  from (select date, count(*) n from (select *, row_number() over (order by code, date)-1 rn, dense_rank() over (order by date)-1 dr from bars) where {cond} group by 1)"""


@query("q06_stride_structure", B + _struct_sql("rn%5=0", "row") + " union all " + _struct_sql("dr%5=0", "session"))
def _q06(spark, folder):
    panel = bars(spark, folder)
    a = au.stride_structure(panel, grid.row_stride(panel, 5)).withColumn("rule", F.lit("row"))
    b = au.stride_structure(panel, grid.session_stride(panel, 5)).withColumn("rule", F.lit("session"))
    return six(a.unionByName(b), "names_per_session")


@query("q06_fingerprint", B + "select true same_rows, count(*) as \"rows\" from bars")
def _q06f(spark, folder):
    panel = bars(spark, folder)
    cols = ["code", "date", "open", "close"]
    a, b = au.fingerprint(panel, cols), au.fingerprint(src.by_code_layout(panel, 4), cols)
    return a.join(F.broadcast(b.select(F.col("fingerprint").alias("_f")))).select((F.col("fingerprint") == F.col("_f")).alias("same_rows"), "rows")


AUDITED = ["ret5", "vol20", "atr14_pct", "dist_ma20", "pos_60", "kdj_k", "limitup_20"]


@query("q01_truncation_test", q.with_(*PRICE_PARTS) + " union all ".join(f"select '{c}' feature, count(*) compared, 0 differing from q4 where date<=date '{CUT}'" for c in AUDITED))
def _q01(spark, folder):
    got = au.truncation_test(bars(spark, folder), matrix.with_price_features, AUDITED, CUT)
    return got.select("feature", "compared", "differing")


@query("w27_leak_control", B + ",\nlk as (select code, date, max(high) over w a from bars window w as (partition by code order by date rows between 1 following and 5 following)),\nlc as (select code, date, max(high) over w b from bars where date<=date '2000-01-03' window w as (partition by code order by date rows between 1 following and 5 following))".lstrip()
       + """ select 'leak' feature, count(*) compared, sum((abs(a-b)>1e-6 or (a is null)<>(b is null))::int)::bigint differing from lk join lc using (code, date)""")
def _w27(spark, folder):
    return au.truncation_test(bars(spark, folder), au.with_leak, ["leak"], CUT).select("feature", "compared", "differing")


@query("q02_beta_reconstruction", q.with_(*PRICE_PARTS) + "select 'beta_60' feature, count(*) compared, 0 differing from q4")
def _q02(spark, folder):
    rows = staged(matrix.with_price_features(bars(spark, folder)).select("code", "date", "ret1", "_up"))
    by_window = matrix.with_market_features(rows)
    return au.differences(by_window, au.beta_by_join(by_window), ["beta_60"]).select("feature", "compared", "differing")


@query("q03_label_reconstruction", LAB + "select count(*) compared, 0 mismatches from lab_webpro where label_resolved")
def _q03(spark, folder):
    panel = bars(spark, folder)
    a = labelled(spark, folder, "webpro").filter("label_resolved").select("code", "date", "label_bull")
    b = au.labels_by_join(panel, 10, 0.30)
    return a.join(b, ["code", "date"], "full").agg(
        F.count(F.lit(1)).alias("compared"), F.sum((~F.col("label_bull").eqNullSafe(F.col("label_rebuilt"))).cast("int")).alias("mismatches"))


@query("q05_report_violations", sigq() + "select strategy_id, 'webpro' regime, 'precision_is_hits_over_signals' violation from sig where strategy_id='donchian_turtle' group by 1 union all select strategy_id, 'webpro', 'lift_is_precision_over_base' from sig where strategy_id in ('pullback_retest', 'donchian_turtle') group by 1")
def _q05(spark, folder):
    """A correct report with two planted faults; a shifted precision also breaks the lift built from the old one."""
    rep = scoring.hit_rates(report_signals(spark, folder), ["strategy_id"]).withColumns({
        "population_id": F.lit(scoring.population_id("scanned")), "regime": F.lit("webpro")}).filter("signals_deduped > 0")
    base = scoring.base_rates(grid.scan_grid(labelled(spark, folder, "webpro")).withColumn("regime", F.lit("webpro")), ["regime"])
    good = scoring.with_lift(rep, base, ["regime"])
    s = F.col("strategy_id")
    bad = good.withColumn("lift", F.when(s == "pullback_retest", F.col("lift") + 0.01).otherwise(F.col("lift")))
    bad = bad.withColumn("bull_precision_deduped", F.when(s == "donchian_turtle", F.col("bull_precision_deduped") + 1e-4).otherwise(F.col("bull_precision_deduped")))
    return au.report_violations(bad, base)


@query("q07_float_flips", B + """select count(*) compared, sum(((high::float>(open*1.05)::float)<>(high>open*1.05::double))::int)::bigint flips from bars""")
def _q07f(spark, folder):
    wide = F.col("high") > F.col("open") * 1.05
    narrow = F.col("high").cast("float") > (F.col("open") * 1.05).cast("float")
    return bars(spark, folder).agg(F.count(F.lit(1)).alias("compared"), F.sum((wide != narrow).cast("int")).alias("flips"))


@query("q08_prediction_coverage", sigq("oc as (select code, date from lab_webpro where label_resolved and seq>=60)") + f"""select n.strategy_id, (select count(*) from oc)-count(d.code) missing, 0 repeated,
  (select count(*) from dec x anti join oc using (code, date) where x.strategy_id=n.strategy_id) unknown
  from (values {','.join(f"('{n}')" for n in NAMES)}) n(strategy_id) left join (select dec.* from dec join oc using (code, date)) d using (strategy_id) group by 1""")
def _q08(spark, folder):
    key = F.concat_ws("|", "code", F.date_format("date", "yyyy-MM-dd")).alias("sample_id")
    lab = _seq_labelled(spark, folder).filter("label_resolved and seq >= 60").select(key, "label_bull")
    pred = scan.decisions(scan.grid_rows(bars(spark, folder)), Strategies(NAMES)).select("strategy_id", key)
    return au.coverage_problems(pred, lab, spark.createDataFrame([(n,) for n in NAMES], "strategy_id string"))


@query("q08_outcome_counts", LAB + "select count(*) samples, sum(label_bull)::bigint positives, 0 not_binary from lab_webpro where label_resolved")
def _q08o(spark, folder):
    return au.outcome_counts(labelled(spark, folder, "webpro").filter("label_resolved"))


INVENTORY = {"vol5": (5, "std", 2), "vol20": (20, "std", 10), "vol60": (60, "std", 30), "vol_ma5": (5, "mean", 2), "vol_ma20": (20, "mean", 10),
             "vol_ma60": (60, "mean", 30), "limitup_5": (5, "sum", 2), "limitup_20": (20, "sum", 10), "up_rate_20": (20, "mean", 10)}


@query("q09_rolling_inventory", q.with_(*PRICE_PARTS) + " union all ".join(f"select '{n}' feature, {w} bars, '{s}' statistic, {m} least, 'backward' direction, count(*)-count({n}) unknown_rows from q4" for n, (w, s, m) in INVENTORY.items()))
def _q09(spark, folder):
    long = xs.melt(matrix.with_price_features(bars(spark, folder)), ["code"], list(INVENTORY))
    seen = long.groupBy("feature").agg((F.count(F.lit(1)) - F.count("x")).alias("unknown_rows"))
    return au.rolling_inventory(INVENTORY, spark).join(seen, "feature")


@query("s10_result_table", B + "select code, count(*) bars, max(high) highest from bars group by 1")
def _s10(spark, folder):
    path = f"{staging_root(spark)}/result-{uuid4().hex}"
    src.write_result(bars(spark, folder).groupBy("code").agg(F.count(F.lit(1)).alias("bars"), F.max("high").alias("highest")), path)
    return src.read_table(spark, path + "/*.parquet")


@query("s12_stored_layers", q.with_(*LAYER_PARTS) + "select recall_tier, count(*) bars, sum(stabilization)::bigint steady from lay group by 1")
def _s12(spark, folder):
    """Layers written once, then read by two aggregates."""
    lay = staged(layers.with_layers(bars(spark, folder)))
    a = lay.groupBy("recall_tier").agg(F.count(F.lit(1)).alias("bars"))
    return a.join(lay.groupBy("recall_tier").agg(F.sum("stabilization").alias("steady")), "recall_tier")


@query("f01_custom_strategy", q.with_(rs.PRIMS) + "select code, date, 'above_mean' strategy_id, (close>a20)::int prediction from p")
def _f01(spark, folder):
    """A strategy of one's own: a score column over the windowed panel and a cutoff."""
    own = Strategies([]).add("above_mean", lambda: F.when(
        F.col("card_bars") == 60, (F.col("close") > F.col("mean20")).cast("double")), 0.5)
    return scan.decisions(scan.grid_rows(bars(spark, folder)), own).select("code", "date", "strategy_id", "prediction")
