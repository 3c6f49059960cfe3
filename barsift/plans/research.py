"""Queries on calendars, long-horizon events and research features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import context, horizon as hz, layers, matrix, research as rsr
from ..operators.cooldown import dedupe_on_calendar
from ..operators.grid import scan_grid
from ..sources.panel import densify, key_problems, with_session_id
from ..sources.tables import bars
from . import sqltext as q
from .features import LAYER_PARTS, PRICE_PARTS, rounded
from .registry import query
from .rulesql import over


def holey(panel):
    """Daily bars without the days their hash picks: a sparse calendar with real gaps."""
    return panel.filter(F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "code", F.date_format("date", "yyyy-MM-dd"))), 1, 8), 16, 10).cast("bigint"), F.lit(7)) != 0)


_HOLEY = "hb as (select * from bars where ('0x'||substr(md5(code||':'||strftime(date,'%Y-%m-%d')),1,8))::bigint%7<>0)"
_CAL = "cal as (select date, row_number() over (order by date)-1 sid, count(*) over () n from (select distinct date from bars))"


@query("s07_densify", q.with_(q.BARS, _HOLEY, "sp as (select code, min(date) a, max(date) b from hb group by 1)")
       + """select sp.code, c.date, hb.close, hb.volume from sp join (select distinct date from bars) c on c.date between a and b
  left join hb on hb.code=sp.code and hb.date=c.date""")
def _s07(spark, folder):
    panel = bars(spark, folder)
    return densify(holey(panel), panel).select("code", "date", "close", "volume")


@query("s07_key_problems", q.with_(q.BARS, _HOLEY) + """select 'null_key' problem, 0 n union all select 'duplicate_key', 0
  union all select 'off_calendar', count(*) from bars where date not in (select date from hb where volume>60)""")
def _s07k(spark, folder):
    panel = bars(spark, folder)
    return key_problems(panel, holey(panel).filter(F.col("volume") > 60))


@query("w18_market_session_id", q.with_(q.BARS, _CAL) + "select code, date, sid session_id from bars join cal using (date)")
def _w18(spark, folder):
    return with_session_id(bars(spark, folder)).select("code", "date", "session_id")


def _vp(w: int) -> str:
    def s(cond, x="volume"):
        return f"case when {over('count(*)', -(w - 1), 0)}>={w} then {over(f'sum(case when {cond} then {x} else 0 end)', -(w - 1), 0)} end"
    return (f"{s('r<0')} vp_down_vol_{w}, {s('r>0')} vp_up_vol_{w}, {s('r=0')} vp_flat_vol_{w}, {s('r<0', '1')} vp_n_down_{w}, {s('r>0', '1')} vp_n_up_{w}")


_VPC = [f"vp_{k}_{w}" for w in (5, 20) for k in ("down_vol", "up_vol", "flat_vol", "n_down", "n_up", "pressure", "one_sided")]
VP = f"""v0 as (select *, close/lag(close) over (partition by code order by date)-1 r from bars), v1 as (select *, {_vp(5)}, {_vp(20)} from v0),
v2 as (select *, {', '.join(f"case when vp_down_vol_{w}+vp_up_vol_{w}>0 then (vp_down_vol_{w}-vp_up_vol_{w})/(vp_down_vol_{w}+vp_up_vol_{w}) end vp_pressure_{w}, coalesce((vp_n_down_{w}=0 or vp_n_up_{w}=0) and vp_down_vol_{w} is not null,false)::int::double vp_one_sided_{w}" for w in (5, 20))} from v1)"""


@query("w19_volume_pressure", q.with_(q.BARS, VP) + "select code, date, " + ", ".join(f"{q.r6(c)} {c}" for c in _VPC) + " from v2")
def _w19(spark, folder):
    return rounded(rsr.with_volume_pressure(bars(spark, folder)), _VPC)


PATH = f"""kl as (select r.code, r.date, r.seq, (k<20 and d<20)::int lw from rsv r join kd using (code, seq)),
k2 as (select *, sum(1-lw) over (partition by code order by date rows unbounded preceding) isl from kl),
kp as (select code, date, sum(lw) over (partition by code, isl order by date rows unbounded preceding)::bigint kdj_low_streak,
  {', '.join(f"case when {over('count(*)', -(w - 1), 0)}>={w} then {over('avg(lw)', -(w - 1), 0)} end kdj_low_occ_{w}" for w in (21, 63))} from k2)"""


@query("w20_kdj_path", q.with_(q.BARS, q.SEQ, q.KDJ, PATH) + f"select code, date, kdj_low_streak, {q.r6('kdj_low_occ_21')} kdj_low_occ_21, {q.r6('kdj_low_occ_63')} kdj_low_occ_63 from kp")
def _w20(spark, folder):
    df = rsr.with_kdj_path(context.with_kdj(bars(spark, folder)))
    return df.select("code", "date", "kdj_low_streak", *[r6(F.col(c)).alias(c) for c in ("kdj_low_occ_21", "kdj_low_occ_63")])


def g(x: str, y: str) -> str:
    return f"(case when abs({y})>=1e-12 then ({x})/({y}) end)"


def _blk(x: str, a: int, b: int, n: int) -> str:
    return f"case when {over(f'count({x})', a, b)}>={n} then {over(f'sum({x})', a, b)} end"


def _asym(t: str, den: str) -> str:
    u, d = g(f"{t}_un", f"{t}_u{den}"), g(f"{t}_dn", f"{t}_d{den}")
    return f"ln(({u}+1e-12)/({d}+1e-12))"


VIR = f"""i0 as (select bars.*, sid, lag(close) over w pc, lag(sid) over w ps from bars join cal using (date) window w as (partition by code order by date)),
i1 as (select *, greatest(high-low,abs(high-pc),abs(low-pc)) tr, coalesce(sid-ps=1,false)::int st from i0),
i2 as (select *, case when {over('count(tr)', -14, -1)}>=14 then {over('avg(tr)', -14, -1)} end atr_, case when {over('count(volume)', -20, -1)}>=20 then {over('avg(volume)', -20, -1)} end vb from i1),
i3 as (select *, {g(f"ln({g('close', 'pc')})", g('atr_', 'pc'))} z, {g('volume', 'vb')} rv from i2),
i4 as (select *, case when z is not null then greatest(z,0e0) end un, case when z is not null then greatest(-z,0e0) end dn, case when z>0 then rv else (case when coalesce(z>0,false) then rv else 0e0 end) end uq,
  case when z<0 then rv else 0e0 end dq, coalesce(z>0,false)::int uc, coalesce(z<0,false)::int dc from i3),
i5 as (select *, {', '.join(f"{_blk(x, -9, 0, 10)} r_{x}, {_blk(x, -19, -10, 10)} p_{x}" for x in ('un', 'dn', 'uq', 'dq', 'uc', 'dc'))}, {_blk('st', -18, 0, 19)} ss from i4),
i6 as (select *, coalesce(ss=19,false) run, coalesce(r_uc>=2 and r_dc>=2 and p_uc>=2 and p_dc>=2,false) bal from i5)"""


@query("w21_volume_impact", q.with_(q.BARS, _CAL, VIR) + f"""select code, date, {q.r6(f"case when run and bal then {_asym('r', 'q')}-({_asym('p', 'q')}) end")} vir,
  {q.r6(f"case when run and bal then {_asym('r', 'c')}-({_asym('p', 'c')}) end")} vir_novol, run::int::double vir_coverage20, (run and not bal)::int::double vir_one_sided,
  {q.r6(f"case when run then {g('r_un', 'r_uq')} end")} vir_up_impact_recent, {q.r6(f"case when run then {g('p_dn', 'p_dq')} end")} vir_down_impact_prior,
  r_uc::bigint vir_recent_n_up from i6""")
def _w21(spark, folder):
    df = rsr.with_volume_impact(with_session_id(bars(spark, folder)))
    return df.select("code", "date", *[r6(F.col(c)).alias(c) for c in ("vir", "vir_novol", "vir_up_impact_recent", "vir_down_impact_prior")],
                     "vir_coverage20", "vir_one_sided", F.col("vir_recent_n_up").cast("bigint").alias("vir_recent_n_up"))


AUX = f"""x0 as (select bars.code, bars.date, close, sid, {', '.join(f"lead(close,{h}) over w c{h}, lead(sid,{h}) over w s{h}" for h in range(1, 6))} from bars join cal using (date) window w as (partition by code order by date)),
aux as (select code, date, sid session_id, case when s1-sid=1 then ln(c1/close) end aux_ret1,
  case when s1=sid+1 and s2=sid+2 and s3=sid+3 and s4=sid+4 and s5=sid+5 then sqrt((pow(ln(c1/close),2)+pow(ln(c2/c1),2)+pow(ln(c3/c2),2)+pow(ln(c4/c3),2)+pow(ln(c5/c4),2))/5) end aux_rv5 from x0)"""


@query("w22_auxiliary_targets", q.with_(q.BARS, _CAL, AUX) + f"select code, date, session_id, {q.r6('aux_ret1')} aux_ret1, {q.r6('aux_rv5')} aux_rv5 from aux")
def _w22(spark, folder):
    return rsr.auxiliary_targets(with_session_id(bars(spark, folder))).select(
        "code", "date", "session_id", r6(F.col("aux_ret1")).alias("aux_ret1"), r6(F.col("aux_rv5")).alias("aux_rv5"))


@query("w23_sequence_anchors", q.with_(q.BARS, _CAL, AUX, "spl as (select n, greatest(20,round_even(n*0.2::double,0)::bigint) dv from (select any_value(n) n from cal))",
       "sq as (select *, case when lag(session_id,15) over (partition by code order by date)=session_id-15 then 1 end ok from aux)")
       + """select code, date, session_id, case when session_id<=n-dv-6 then 'train' else 'dev' end as role from sq, spl
  where ok=1 and aux_ret1 is not null and aux_rv5 is not null and (session_id<=n-dv-6 or session_id>=n-dv)""")
def _w23(spark, folder):
    panel = with_session_id(bars(spark, folder))
    aux = rsr.auxiliary_targets(panel)
    return rsr.sequence_anchors(aux, 16, rsr.auxiliary_split(panel))


@query("m11_robust_scale", q.with_(q.BARS, "tq as (select quantile_cont(close,0.25) c1, quantile_cont(close,0.5) c2, quantile_cont(close,0.75) c3, "
       "quantile_cont(volume,0.25) v1, quantile_cont(volume,0.5) v2, quantile_cont(volume,0.75) v3 from bars where date<date '2000-01-03')")
       + f"""select code, date, {q.r6('(close-c2)/(case when c3-c1>=1e-6 then c3-c1 else 1 end)')} close_scaled, {q.r6('(volume-v2)/(case when v3-v1>=1e-6 then v3-v1 else 1 end)')} volume_scaled,
  1e0 close_known, 1e0 volume_known from bars, tq""")
def _m11(spark, folder):
    df = rsr.robust_scale(bars(spark, folder), ["close", "volume"], F.col("date") < F.lit("2000-01-03").cast("date"))
    return df.select("code", "date", *[r6(F.col(c)).alias(c) for c in ("close_scaled", "volume_scaled", "close_known", "volume_known")])


_FAM = {"price": "close", "activity": "volume", "width": "width"}
_ECDF = """fx as (select *, high-low width from bars), ft as (select * from fx where date<date '2000-01-03')""" + "".join(
    f""", c_{f} as (select x, count(*) filter (t=1) over_n, sum(count(*) filter (t=1)) over (order by x) cum, sum(count(*) filter (t=1)) over () tot
  from (select {c} x, 1 t from ft union all select {c}, 0 from fx) group by x)""" for f, c in _FAM.items()) + """,
fq as (select code, date, """ + ", ".join(f"(select any_value(cum/tot::double) from c_{f} where c_{f}.x=fx.{c}) q_{f}" for f, c in _FAM.items()) + """ from fx),
fs as (select *, list_sort([q_price,q_activity,q_width]) ql from fq)"""


@query("scalar_family_ecdf", q.with_(q.BARS, _ECDF) + "select code, date, " + ", ".join(f"{q.r6(f'q_{f}')} family_q__{f}" for f in _FAM)
       + f""", {q.r6('(1/(1+exp(-(q_price-0.75)/0.10))+1/(1+exp(-(q_activity-0.75)/0.10))+1/(1+exp(-(q_width-0.75)/0.10)))/3')} meb, 1e0 family_coverage,
  ((q_price>=0.75)::int+(q_activity>=0.75)::int+(q_width>=0.75)::int)::bigint family_support_count_75, ((q_price>=0.9)::int+(q_activity>=0.9)::int+(q_width>=0.9)::int)::bigint family_support_count_90,
  {q.r6('ql[3]-ql[2]')} family_dominance from fs""")
def _ecdf(spark, folder):
    panel = bars(spark, folder).withColumn("width", F.col("high") - F.col("low"))
    got = rsr.family_ecdf(panel.filter(F.col("date") < F.lit("2000-01-03").cast("date")), panel, _FAM)
    return got.select("code", "date", *[r6(F.col(c)).alias(c) for c in got.columns if c.startswith(("family_q", "meb", "family_cov", "family_dom"))],
                      *[F.col(c).cast("bigint").alias(c) for c in ("family_support_count_75", "family_support_count_90")])


@query("l12_candidate_manifest", q.with_(*LAYER_PARTS) + """select substr(sha256(code||'|'||strftime(date,'%Y-%m-%d')||'|lowzone-tier-v1'),1,24) candidate_id, code, date,
  date candidate_known_at, 'close' decision_time, 'lowzone-tier-v1' candidate_version, 'recall_tier>=1' candidate_reason, recall_tier from lay where recall_tier>=1""")
def _l12(spark, folder):
    return hz.candidates(layers.with_layers(bars(spark, folder)))


@query("p13_prefix_invariance", q.with_(*LAYER_PARTS) + "select 0 prefix_only, 0 full_only, count(*) candidates from lay where recall_tier>=1 and date<=date '2000-01-03'")
def _p13(spark, folder):
    panel = bars(spark, folder)
    cut = "2000-01-03"
    full = hz.candidates(layers.with_layers(panel))
    prefix = hz.candidates(layers.with_layers(panel.filter(F.col("date") <= F.lit(cut).cast("date"))))
    diff = hz.prefix_differences(prefix, full, cut).groupBy().agg(
        F.count(F.when(F.col("side") == "prefix_only", 1)).alias("prefix_only"),
        F.count(F.when(F.col("side") == "full_only", 1)).alias("full_only"))
    n = full.filter(F.col("date") <= F.lit(cut).cast("date")).agg(F.count(F.lit(1)).alias("candidates"))
    return diff.join(F.broadcast(n))


def _events_sql(h: int, up: float, src: str = "hb") -> str:
    return f"""cd as (select s.code, s.date, c.sid, c.n from {src} s join cal c using (date) where s.volume>30),
ex as (select cd.*, b.open e from cd left join (select {src}.*, sid from {src} join cal using (date)) b on b.code=cd.code and b.sid=cd.sid+1),
pth as (select ex.code, ex.sid, c.sid att, b.code is null miss, b.low, b.close, ex.e from ex join cal c on c.sid between ex.sid+1 and least(ex.sid+{h}, ex.n-1)
  left join {src} b on b.code=ex.code and b.date=c.date where ex.e>0),
evs as (select code, sid, min((att, kind)) ev from (select *, case when miss then 0 when low is null or low<=0 or close is null or close<=0 then 1 when low<e*0.8::double then 2 when close>e*{up}::double then 3 end kind from pth) where kind is not null group by all),
oc as (select ex.*, struct_extract_at(ev,1) att, struct_extract_at(ev,2) kind from ex left join evs using (code, sid)),
oc2 as (select *, case when sid+1>=n then 'pending_entry_calendar' when e is null or e<=0 then 'no_entry' when kind=0 then 'unknown_missing_bar' when kind=1 then 'unknown_missing_price'
  when kind=2 then 'risk' when kind=3 then 'success' when sid+{h}<n then 'timeout' else 'pending_maturity' end oclass from oc),
oc3 as (select *, case when oclass='no_entry' then sid+1 when kind is not null then att when oclass='timeout' then sid+{h} end fin from oc2)"""


def _l11_sql(h: int, up: float, every: str) -> str:
    return q.with_(q.bars_cte(every), _HOLEY, _CAL, _events_sql(h, up)) + f"""select o.code, o.date signal_date, oclass outcome_class,
  case when oclass='success' then 1 when oclass in ('risk','timeout') then 0 end label_joint, case when e>0 then e end entry_open,
  case when oclass in ('unknown_missing_bar','unknown_missing_price') then att-o.sid-1 when oclass in ('risk','success') then att-o.sid when oclass='timeout' then {h}
    when oclass='pending_maturity' then o.n-1-o.sid else 0 end bars_scanned,
  c1.date label_end, c2.date deadline, (oclass in ('risk','success','timeout') and o.sid+{h}<o.n) training_eligible
  from oc3 o left join cal c1 on c1.sid=o.fin left join cal c2 on c2.sid=o.sid+{h}"""


def _l11_query(h: int, up: float, every: str):
    def run(spark, folder):
        panel = bars(spark, folder, every)
        sparse = holey(panel)
        got = hz.label_events(sparse, sparse.filter(F.col("volume") > 30).select("code", "date"), panel, h, up)
        return got.select("code", "signal_date", "outcome_class", "label_joint", "entry_open",
                          F.col("bars_scanned").cast("bigint").alias("bars_scanned"), "label_end", "deadline", "training_eligible")
    return run


query("l11_event_labels", _l11_sql(6, 1.2, "week"))(_l11_query(6, 1.2, "week"))


def scheduled(panel: DataFrame) -> DataFrame:
    """The panel's sessions and thirty weeks after its last."""
    last = panel.agg(F.max("date").alias("d"))
    ahead = last.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.date_add("d", (k * 7).cast("int")))).alias("date"))
    return panel.select("date").distinct().unionByName(ahead)


@query("l11_event_labels_scheduled", _l11_sql(6, 1.2, "week"))
def _l11_ahead(spark, folder):
    """A calendar that runs past the data changes nothing."""
    panel = bars(spark, folder)
    sparse = holey(panel)
    # The last session must have a bar for the two calendars to end alike.
    got = hz.label_events(sparse, sparse.filter(F.col("volume") > 30).select("code", "date"), scheduled(panel), 6, 1.2)
    return got.select("code", "signal_date", "outcome_class", "label_joint", "entry_open",
                      F.col("bars_scanned").cast("bigint").alias("bars_scanned"), "label_end", "deadline", "training_eligible")
query("j07_event_labels_dense", _l11_sql(40, 1.3, "week").replace("%7<>0)", "%1=0)"))(
    lambda spark, folder: (lambda panel: hz.label_events(panel, panel.filter(F.col("volume") > 30).select("code", "date"), panel, 40, 1.3).select(
        "code", "signal_date", "outcome_class", "label_joint", "entry_open", F.col("bars_scanned").cast("bigint").alias("bars_scanned"),
        "label_end", "deadline", "training_eligible"))(bars(spark, folder)))


@query("l13_mature_splits", q.with_(*LAYER_PARTS, _CAL, """cn as (select sid, date, n, (select count(*) from lay where lay.date=cal.date and recall_tier>=3) k from cal),
cm as (select *, case when sid<=n-1-60 then k else 0 end m from cn)""") + """select a.date dev_start, (select max(date) from cal where sid<=a.sid+62) dev_end,
  (select coalesce(sum(m),0)::bigint from cm where sid+60<a.sid) n_train, (select sum(m)::bigint from cm where sid between a.sid and a.sid+62) n_dev, 60 horizon
  from cm a where a.sid>=1 and (select coalesce(sum(m),0) from cm where sid+60<a.sid)>=1 and (select sum(m) from cm where sid between a.sid and a.sid+62)>=1""")
def _l13(spark, folder):
    panel = bars(spark, folder)
    picks = hz.candidates(layers.with_layers(panel), 3)
    return hz.mature_splits(panel, picks, 60)


_L13 = q.with_(*LAYER_PARTS, _CAL, """cn as (select sid, date, n, (select count(*) from lay where lay.date=cal.date and recall_tier>=3) k from cal),
cm as (select *, case when sid<=n-1-60 then k else 0 end m from cn)""")


@query("l13_mature_splits_scheduled", _L13 + """select a.date dev_start, (select max(date) from cal where sid<=a.sid+62) dev_end,
  (select coalesce(sum(m),0)::bigint from cm where sid+60<a.sid) n_train, (select sum(m)::bigint from cm where sid between a.sid and a.sid+62) n_dev, 60 horizon
  from cm a where a.sid>=1 and (select coalesce(sum(m),0) from cm where sid+60<a.sid)>=1 and (select sum(m) from cm where sid between a.sid and a.sid+62)>=1""")
def _l13_ahead(spark, folder):
    panel = bars(spark, folder)
    return hz.mature_splits(scheduled(panel), hz.candidates(layers.with_layers(panel), 3), 60, panel=panel)


@query("l13_split_support", q.with_(*LAYER_PARTS, _CAL, """cn as (select sid, date, n, (select count(*) from lay where lay.date=cal.date and recall_tier>=3) k from cal),
cm as (select *, case when sid<=n-1-60 then k else 0 end m from cn)""") + """select (select count(*) from cal) calendar_sessions, count(*) n_legal_splits, min(a.date) first_dev_start, 60 horizon, 122 minimum_sessions
  from cm a where a.sid>=1 and (select coalesce(sum(m),0) from cm where sid+60<a.sid)>=1 and (select sum(m) from cm where sid between a.sid and a.sid+62)>=1""")
def _l13s(spark, folder):
    panel = bars(spark, folder)
    splits = hz.mature_splits(panel, hz.candidates(layers.with_layers(panel), 3), 60)
    return hz.split_support(panel, splits, 60)


@query("l05_calendar_cooldown", q.with_(q.BARS, q.SEQ, q.KDJ, "sg as (select r.code, r.date from rsv r join kd using (code, seq) where k<20)",
       q.dedupe_cte("sgc", "dd", [], 20, "sid").replace("dd_p as (select *, sid pos", _CAL + ",\nsgc as (select sg.*, sid from sg join cal using (date)),\ndd_p as (select *, sid pos"))
       + "select code, date from dd")
def _l05(spark, folder):
    panel = bars(spark, folder)
    low = context.with_kdj(panel).filter("kdj_k < 20").select("code", "date")
    return dedupe_on_calendar(low, panel, 20)


@query("m15_research_features", q.with_(*PRICE_PARTS, _CAL, VP, PATH, VIR) + f"""select q4.code, q4.date, {q.r6('ret5')} ret5, {q.r6('vp_pressure_20')} vp_pressure_20, kdj_low_streak,
  {q.r6(f"case when run and bal then {_asym('r', 'q')}-({_asym('p', 'q')}) end")} vir from q4 join v2 using (code, date) join kp using (code, date) join i6 using (code, date)""")
def _m15(spark, folder):
    df = matrix.with_price_features(with_session_id(bars(spark, folder)))
    df = rsr.with_volume_impact(rsr.with_kdj_path(rsr.with_volume_pressure(df.drop("_up"))))
    return df.select("code", "date", r6(F.col("ret5")).alias("ret5"), r6(F.col("vp_pressure_20")).alias("vp_pressure_20"),
                     "kdj_low_streak", r6(F.col("vir")).alias("vir"))


@query("p11_feature_names", q.with_(*PRICE_PARTS, _CAL) + "select count(*) bars, 10 research_columns, true baseline_excludes_them from q4")
def _p11(spark, folder):
    df = rsr.with_kdj_path(rsr.with_volume_pressure(matrix.with_price_features(bars(spark, folder)), (5,)))
    base = matrix.baseline_features(df)
    added = [c for c in df.columns if c.startswith(("vp_", "kdj_low_"))]
    return df.agg(F.count(F.lit(1)).alias("bars")).withColumns({
        "research_columns": F.lit(len(added)), "baseline_excludes_them": F.lit(not set(base) & set(added))})
