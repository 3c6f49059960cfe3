"""Queries on per-code windows, layers, the matrix and cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as win
from ..functions.columns import r6
from ..functions.fixed import CROSS_SOURCES, FEATURE_GROUPS
from ..operators import context, layers, matrix
from ..session import staged
from ..sources.tables import bars
from . import sqltext as q
from .registry import query
from .rulesql import over


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("code", "date", *[r6(F.col(c).cast("double")).alias(c) for c in columns])


def gate(agg: str, x: str, a: int, b: int, least: int) -> str:
    return f"case when {over(f'count({x})', a, b)}>={least} then {over(f'{agg}({x})', a, b)} end"


def half(agg: str, x: str, w: int) -> str:
    return gate(agg, x, -(w - 1), 0, max(2, w // 2))


def lag(x: str, n: int) -> str:
    return f"lag({x},{n}) over (partition by code order by date)"


B = q.with_(q.BARS)
BS = q.with_(q.BARS, q.SEQ)


@query("w01_lags", B + "select code, date, " + ", ".join(
    f"{lag('close', n)} close_{n}" for n in (1, 5, 20)) + f", lead(close,10) over (partition by code order by date) close_ahead_10 from bars")
def _w01(spark, folder):
    return bars(spark, folder).select("code", "date", *[win.back("close", n).alias(f"close_{n}") for n in (1, 5, 20)],
                                      win.back("close", -10).alias("close_ahead_10"))


_ROLL = [("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min"), ("sum", "sum")]


@query("w02_rolling", B + "select code, date, " + ", ".join(
    f"{q.r6(half(s, 'close', w))} close_{h}_{w}" for h, s in _ROLL for w in (5, 20, 60)) + " from bars")
def _w02(spark, folder):
    return bars(spark, folder).select("code", "date", *[
        r6(win.half_window("close", w, h)).alias(f"close_{h}_{w}") for h, _ in _ROLL for w in (5, 20, 60)])


def _context_sql() -> str:
    first = []
    for w in (5, 10, 20, 60, 120, 250):
        first += [f"close/{lag('close', w)}-1 ret_{w}", f"{over('max(high)', -(w - 1), 0)} high_{w}",
                  f"{over('min(low)', -(w - 1), 0)} low_{w}", f"{over('avg(close)', -(w - 1), 0)} ma_{w}",
                  f"{over('avg(volume)', -(w - 1), 0)} vol_ma_{w}"]
    first += [f"{over('avg(volume)', -20, -5)} pv",
              f"greatest(high-low, abs(high-{lag('close', 1)}), abs(low-{lag('close', 1)})) tr"]
    second = [f"case when high_{w}-low_{w}>1e-12 then (close-low_{w})/(high_{w}-low_{w}) else 0.5e0 end pos_{w}"
              for w in (60, 120, 250)] + [f"close/(high_{w}+1e-12)-1 dd_{w}" for w in (120, 250)] + [
        "vol_ma_5/(vol_ma_20+1e-12) vol_ratio_5_20", "vol_ma_5/(pv+1e-12) volume_ratio",
        f"{over('avg(tr)', -13, 0)} atr_14"]
    return f"""x as (select *, {', '.join(first)} from bars), y as (select *, {', '.join(second)} from x)"""


CONTEXT_COLUMNS = [f"{p}_{w}" for w in (5, 10, 20, 60, 120, 250) for p in ("ret", "high", "low", "ma", "vol_ma")] + [
    "pos_60", "pos_120", "pos_250", "dd_120", "dd_250", "vol_ratio_5_20", "volume_ratio", "atr_14"]


@query("w03_context", q.with_(q.BARS, _context_sql()) + "select code, date, " + ", ".join(
    f"{q.r6(c)} {c}" for c in CONTEXT_COLUMNS) + " from y")
def _w03(spark, folder):
    return rounded(context.with_context(bars(spark, folder)), CONTEXT_COLUMNS)


@query("w04_average_true_range", q.with_(q.BARS, _context_sql()) + f"select code, date, {q.r6('tr')} true_range, {q.r6('atr_14')} atr_14 from y")
def _w04(spark, folder):
    df = bars(spark, folder).withColumn("tr", context.true_range())
    return df.select("code", "date", r6(F.col("tr")).alias("true_range"), r6(win.roll("tr", 14)).alias("atr_14"))


@query("w05_kdj", q.with_(q.BARS, q.SEQ, q.KDJ) + f"""select r.code, r.date, {q.r6('k')} kdj_k, {q.r6('d')} kdj_d,
  {q.r6('3*k-2*d')} kdj_j from rsv r join kd using (code, seq)""")
def _w05(spark, folder):
    return rounded(context.with_kdj(bars(spark, folder)), ["kdj_k", "kdj_d", "kdj_j"])


@query("w25_prepared", q.with_(q.BARS, q.SEQ, q.KDJ, _context_sql()) + f"""select y.code, y.date, {q.r6('k')} kdj_k,
  {q.r6('pos_60')} pos_60, {q.r6('volume_ratio')} volume_ratio, volume turnover, true turnover_is_proxy
  from y join rsv r using (code, date) join kd using (code, seq)""")
def _w25(spark, folder):
    return context.prepared(bars(spark, folder)).select(
        "code", "date", *[r6(F.col(c)).alias(c) for c in ("kdj_k", "pos_60", "volume_ratio")], "turnover", "turnover_is_proxy")


_K6 = f"""z as (select code, date, seq, close, {gate('min', 'low', -8, 0, 9)} lo, {gate('max', 'high', -8, 0, 9)} hi from s),
z2 as (select code, date, seq-8 i, 100*(close-lo)/(hi-lo+1e-12) rsv from z where seq>=8),
k6 as (select code, i, rsv k, rsv d from z2 where i=0 union all
  select z2.code, z2.i, k6.k*2e0/3e0+z2.rsv/3e0, k6.d*2e0/3e0+(k6.k*2e0/3e0+z2.rsv/3e0)/3e0
  from k6 join z2 on z2.code=k6.code and z2.i=k6.i+1)"""


@query("w06_kdj_first_value", q.with_(q.BARS, q.SEQ, _K6) + f"""select s.code, s.date, {q.r6('k')} kdj_k, {q.r6('d')} kdj_d,
  {q.r6('3*k-2*d')} kdj_j, {q.r6('k-d')} kdj_k_minus_d,
  {q.r6('k-lag(k,5) over (partition by s.code order by s.date)')} kdj_k_chg5
  from s left join k6 on k6.code=s.code and k6.i=s.seq-8""")
def _w06(spark, folder):
    return rounded(context.with_kdj_first_value(bars(spark, folder)),
                   ["kdj_k", "kdj_d", "kdj_j", "kdj_k_minus_d", "kdj_k_chg5"])


EMA = """em as (select code, seq, close e5, close e10, close e20, close e60 from s where seq=0 union all
  select s.code, s.seq, em.e5*(1-2e0/6e0)+close*2e0/6e0, em.e10*(1-2e0/11e0)+close*2e0/11e0,
    em.e20*(1-2e0/21e0)+close*2e0/21e0, em.e60*(1-2e0/61e0)+close*2e0/61e0
  from em join s on s.code=em.code and s.seq=em.seq+1),
ema as (select code, seq, case when seq>=4 then e5 end ema5, case when seq>=9 then e10 end ema10,
  case when seq>=19 then e20 end ema20, case when seq>=59 then e60 end ema60 from em)"""

ADX = f"""m as (select code, seq, high-{lag('high', 1)} u, {lag('low', 1)}-low dn,
  greatest(high-low, abs(high-{lag('close', 1)}), abs(low-{lag('close', 1)})) tr from s),
m2 as (select code, seq, tr, case when u>dn and u>0 then u else 0e0 end p, case when dn>u and dn>0 then dn else 0e0 end n from m),
w as (select code, seq, tr a, p, n from m2 where seq=0 union all
  select m2.code, m2.seq, w.a*13e0/14e0+m2.tr/14e0, w.p*13e0/14e0+m2.p/14e0, w.n*13e0/14e0+m2.n/14e0
  from w join m2 on m2.code=w.code and m2.seq=w.seq+1),
di as (select code, seq, case when seq>=13 and a<>0 then 100*p/a end pd, case when seq>=13 and a<>0 then 100*n/a end nd from w),
dx as (select code, seq, pd-nd di_spread, case when pd+nd<>0 then 100*abs(pd-nd)/(pd+nd) end x from di),
ax as (select code, seq, x v, case when x is null then 0 else 1 end nobs, 1e0 wt from dx where seq=0 union all
  select dx.code, dx.seq,
    case when dx.x is null then ax.v when ax.v is null then dx.x
      else (ax.wt*13e0/14e0*ax.v+dx.x/14e0)/(ax.wt*13e0/14e0+1e0/14e0) end,
    ax.nobs+(dx.x is not null)::int,
    case when dx.x is not null then 1e0 else ax.wt*13e0/14e0 end
  from ax join dx on dx.code=ax.code and dx.seq=ax.seq+1),
adx as (select code, seq, case when nobs>=14 then v end adx14, di_spread from ax join dx using (code, seq))"""


@query("w07_ema", q.with_(q.BARS, q.SEQ, EMA) + "select s.code, s.date, " + ", ".join(
    f"{q.r6(f'ema{w}')} ema{w}" for w in (5, 10, 20, 60)) + " from s join ema using (code, seq)")
def _w07(spark, folder):
    return rounded(layers.with_ema(bars(spark, folder)), [f"ema{w}" for w in (5, 10, 20, 60)])


_MIXED = (2, 10, 60, 500)
_MIX = ("mx as (select code, seq, " + ", ".join(f"close e{w}" for w in _MIXED) + " from s where seq=0 union all select s.code, s.seq, "
        + ", ".join(f"mx.e{w}*(1-2e0/{w + 1}e0)+close*2e0/{w + 1}e0" for w in _MIXED) + " from mx join s on s.code=mx.code and s.seq=mx.seq+1)")


@query("w07_ema_mixed_spans", q.with_(q.bars_cte("day"), q.SEQ, _MIX) + "select s.code, s.date, " + ", ".join(
    f"{q.r6(f'case when seq>={w - 1} then e{w} end')} ema{w}" for w in _MIXED) + " from s join mx using (code, seq)")
def _w07_mixed(spark, folder):
    """Fast and slow means of one call, on daily bars."""
    return rounded(layers.with_ema(bars(spark, folder, "day"), spans=_MIXED), [f"ema{w}" for w in _MIXED])


@query("w08_adx", q.with_(q.BARS, q.SEQ, ADX) + f"""select s.code, s.date, {q.r6('adx14')} adx14, {q.r6('di_spread')} di_spread
  from s join adx using (code, seq)""")
def _w08(spark, folder):
    return rounded(layers.with_adx(bars(spark, folder)), ["adx14", "di_spread"])


def sd(a: str, b: str) -> str:
    return f"(case when abs({b})>=1e-12 then ({a})/({b}) end)"


def _rsi(w: int) -> str:
    return f"100-100/(1+{sd(gate('avg', 'gn', -(w - 1), 0, w), gate('avg', 'ls', -(w - 1), 0, w))})"


def full(agg: str, x: str, w: int) -> str:
    return gate(agg, x, -(w - 1), 0, w)


LAYERS = f"""a0 as (select s.*, {lag('close', 1)} c1, greatest(high-low, 1e-12) dr from s),
a1 as (select *, (close-low)/dr close_position, (least(open,close)-low)/dr lower_wick, abs(close-open)/dr body_ratio,
  dr/greatest(close,1e-12) range_pct,
  case when c1 is not null then greatest(high-low,abs(high-c1),abs(low-c1)) end tr,
  coalesce(sign(close-c1),0)*volume sg, case when close<c1 then volume end dnv, case when close>=c1 then volume end upv,
  case when c1 is not null then greatest(close-c1,0e0) end gn, case when c1 is not null then greatest(c1-close,0e0) end ls from a0),
a2 as (select *, {', '.join(f"{lag('close', n)} p{n}" for n in (3, 5, 10, 20, 60))},
  {full('min', 'low', 60)} rl, {full('max', 'high', 60)} rh, {', '.join(f"{full('avg', 'volume', w)} v{w}" for w in (5, 10, 20))},
  {', '.join(f"{full('avg', 'range_pct', w)} r{w}" for w in (5, 20, 60))}, {full('avg', 'tr', 14)} atr14,
  sum(sg) over (partition by code order by date rows unbounded preceding) obv,
  {gate('avg', 'dnv', -4, 0, 3)} dn5, {gate('avg', 'upv', -4, 0, 3)} up5, {_rsi(2)} rsi2, {_rsi(14)} rsi14 from a1),
a3 as (select a2.*, ema5, ema10, ema20, ema60, adx14, di_spread, lag(obv,10) over w obv10, lag(ema20,10) over w e20l,
  lag(ema60,20) over w e60l from a2 join ema using (code, seq) join adx using (code, seq)
  window w as (partition by a2.code order by a2.date)),
a4 as (select *, {sd('close', 'c1')}-1 ret1, {', '.join(f"{sd('close', f'p{n}')}-1 ret{n}" for n in (3, 5, 10, 20, 60))},
  {sd('low', 'rl')}-1 low_gap60, {sd('close', 'rl')}-1 close_gap60, {sd('close', 'rh')}-1 drawdown60,
  {sd('r5', 'r20')} range_contract5, {sd('r20', 'r60')} range_contract20, {sd('atr14', 'close')} atr_pct,
  {sd('volume', 'v20')} vol_ratio20, {sd('v5', 'v20')} vol_contract5, {sd('v10', 'v20')} vol_contract10,
  {sd('volume', 'v5')} vol_expand, {sd('dn5', 'up5')} down_vol_ratio5, (obv-obv10)/greatest(abs(obv10),1) obv_slope10,
  {', '.join(f"{sd('close', f'ema{w}')}-1 ema{w}_gap" for w in (5, 10, 20, 60))},
  {sd('ema20', 'e20l')}-1 ema20_slope10, {sd('ema60', 'e60l')}-1 ema60_slope20 from a3),
a5 as (select *, coalesce(low_gap60<=0.15 and close_gap60<=0.28 and drawdown60<=-0.15 and close_position>=0.30,false) t1,
  coalesce(ret5>-0.12 and r5<=r20*1.25,false) t2,
  coalesce(close>=open and close>c1 and lower_wick>=0.12 and close_position>=0.45,false) t3,
  coalesce(vol_contract5<=1.35 and vol_expand>=0.85,false) t4, coalesce(ema20_slope10>=-0.03 and close>=ema5,false) t5 from a4),
lay as (select *, case when t1 and t2 and t3 and t4 and t5 then 5 when t1 and t2 and t3 and t4 then 4
  when t1 and t2 and t3 then 3 when t1 and t2 then 2 when t1 then 1 else 0 end recall_tier,
  t2::int stabilization, year(date) yr from a5)"""

LAYER_PARTS = (q.BARS, q.SEQ, EMA, ADX, LAYERS)


@query("w09_rsi", q.with_(*LAYER_PARTS) + f"select code, date, {q.r6('rsi2')} rsi2, {q.r6('rsi14')} rsi14 from lay")
def _w09(spark, folder):
    return rounded(layers.with_layers(bars(spark, folder)), ["rsi2", "rsi14"])


@query("w10_obv_slope", q.with_(*LAYER_PARTS) + f"select code, date, {q.r6('obv_slope10')} obv_slope10 from lay")
def _w10(spark, folder):
    return rounded(layers.with_layers(bars(spark, folder)), ["obv_slope10"])


@query("w11_down_up_volume", q.with_(*LAYER_PARTS) + f"select code, date, {q.r6('down_vol_ratio5')} down_vol_ratio5 from lay")
def _w11(spark, folder):
    return rounded(layers.with_layers(bars(spark, folder)), ["down_vol_ratio5"])


@query("w12_layers", q.with_(*LAYER_PARTS) + "select code, date, recall_tier, stabilization, yr as year, " + ", ".join(
    f"{q.r6(c)} {c}" for c in layers.LAYER_FEATURES) + " from lay")
def _w12(spark, folder):
    return layers.with_layers(bars(spark, folder)).select(
        "code", "date", "recall_tier", "stabilization", "year",
        *[r6(F.col(c)).alias(c) for c in layers.LAYER_FEATURES])


def _price_sql() -> str:
    lags, means = (1, 2, 3, 5, 10, 20, 60, 120, 250), (5, 10, 20, 60, 120, 250)
    a = [f"{lag('close', n)} c{n}" for n in lags] + ["high-low rng"]
    b = [f"close/(c{n}+1e-12)-1 ret{n}" for n in lags] + [
        "case when c1 is not null then greatest(high-low,abs(high-c1),abs(low-c1)) end tr"]
    c = ["coalesce(ret1>=0.095,false)::int::double lu", "coalesce(ret1>0,false)::int::double up"]
    d = ([f"{half('stddev_samp', 'ret1', w)} vol{w}" for w in (5, 10, 20, 60)] + [f"{half('avg', 'tr', 14)} atr"]
         + [f"{half('avg', 'volume', w)} vol_ma{w}" for w in (5, 20, 60)] + [f"{half('stddev_samp', 'volume', 20)} vsd"]
         + [f"{half('avg', 'close', w)} ma{w}" for w in means]
         + [f"{half('max', 'high', w)} hi{w}" for w in (60, 120, 250)] + [f"{half('min', 'low', w)} lo{w}" for w in (60, 120, 250)]
         + [f"{half('avg', 'rng', w)} r{w}" for w in (5, 20, 60)] + [f"{half('sum', 'lu', w)} limitup_{w}" for w in (5, 10, 20)]
         + [f"{lag('lu', 1)} limitup_yesterday", f"{half('avg', 'up', 20)} up_rate_20", f"k-{lag('k', 5)} kdj_k_chg5",
            f"(3*k-2*d)-{lag('(3*k-2*d)', 5)} kdj_j_chg5", "k kdj_k", "d kdj_d", "3*k-2*d kdj_j", "k-d kdj_k_minus_d"])
    e = (["atr/(close+1e-12) atr14_pct", "volume/(vol_ma5+1e-12) vol_ratio_1_5", "vol_ma5/(vol_ma20+1e-12) vol_ratio_5_20",
          "vol_ma20/(vol_ma60+1e-12) vol_ratio_20_60", "vsd/(vol_ma20+1e-12) vol_stability_20", "r5/(r20+1e-12) range_5_20",
          "r20/(r60+1e-12) range_20_60", "rng/(close+1e-12) range_pct", "(close-low)/(rng+1e-12) close_loc",
          "(high-greatest(open,close))/(rng+1e-12) upper_wick", "(least(open,close)-low)/(rng+1e-12) lower_wick",
          "(close-open)/(open+1e-12) body_pct", "(open-c1)/(c1+1e-12) gap_open"]
         + [f"close/(ma{w}+1e-12)-1 dist_ma{w}" for w in means] + [f"(ma{w}-c{w})/(close+1e-12) ma{w}_slope" for w in means]
         + [f"(close-lo{w})/(hi{w}-lo{w}+1e-12) pos_{w}" for w in (60, 120, 250)]
         + [f"close/(hi{w}+1e-12)-1 dd_{w}" for w in (60, 120, 250)] + [f"hi{w}/(close+1e-12)-1 to_high_{w}" for w in (60, 120, 250)])
    return f"""q0 as (select s.*, k, d, {', '.join(a)} from s join kd using (code, seq)), q1 as (select *, {', '.join(b)} from q0),
q2 as (select *, {', '.join(c)} from q1), q3 as (select *, {', '.join(d)} from q2), q4 as (select *, {', '.join(e)} from q3)"""


_MKT = f"""dly as (select date, avg(ret1) mkt_ret1, avg(up) mkt_breadth, stddev_samp(ret1) mkt_dispersion from q4 group by 1),
dly2 as (select *, {', '.join(f"case when count(mkt_ret1) over w{w}>=2 then sum(mkt_ret1) over w{w} end mkt_ret{w}" for w in (5, 20, 60))},
  case when count(mkt_ret1) over w20>=2 then stddev_samp(mkt_ret1) over w20 end mkt_vol20 from dly
  window w5 as (order by date rows 4 preceding), w20 as (order by date rows 19 preceding), w60 as (order by date rows 59 preceding)),
q5 as (select q4.*, mkt_ret1, mkt_breadth, mkt_dispersion, mkt_ret5, mkt_ret20, mkt_ret60, mkt_vol20, ret1*mkt_ret1 xy,
  mkt_ret1*mkt_ret1 yy from q4 join dly2 using (date)),
q6 as (select *, {', '.join(f"{gate('avg', x, -59, 0, 20)} m_{n}" for x, n in (('ret1', 'x'), ('mkt_ret1', 'y'), ('xy', 'xy'), ('yy', 'yy')))} from q5),
q7 as (select *, case when m_xy is not null and m_x is not null then greatest(-5e0,least(5e0,(m_xy-m_x*m_y)/(m_yy-m_y*m_y+1e-12))) end beta_60 from q6),
q8 as (select *, ret1-beta_60*mkt_ret1 resid_ret1 from q7)"""

_CS = "q9 as (select *, " + ", ".join(
    f"case when {c} is not null then (rank() over (partition by date order by {c} nulls last)"
    f"+(count(*) over (partition by date, {c})-1)/2e0)/count({c}) over (partition by date) end {n}_rank, "
    f"({c}-avg({c}) over (partition by date))/(stddev_samp({c}) over (partition by date)+1e-12) {n}_z"
    for n, c in CROSS_SOURCES.items()) + " from q8)"

PRICE_PARTS = (q.BARS, q.SEQ, q.KDJ, _price_sql())
MATRIX_PARTS = (*PRICE_PARTS, _MKT, _CS)
PRICE_COLUMNS = [c for g in ("momentum", "volatility", "volume", "limitup", "position", "candle", "kdj") for c in FEATURE_GROUPS[g]]


@query("w13_price_features", q.with_(*PRICE_PARTS) + "select code, date, " + ", ".join(
    f"{q.r6(c)} {c}" for c in PRICE_COLUMNS) + " from q4")
def _w13(spark, folder):
    return rounded(matrix.with_price_features(bars(spark, folder)), PRICE_COLUMNS)


@query("w14_mean_slope_identity", q.with_(*PRICE_PARTS) + """select count(*) bars_known,
  sum((abs(ma20_slope-(1/(1+dist_ma20)-1/(1+ret20)))>1e-9)::int)::bigint broken from q4 where ma20_slope is not null""")
def _w14(spark, folder):
    df = matrix.with_price_features(bars(spark, folder)).filter("ma20_slope is not null")
    gap = F.col("ma20_slope") - (1 / (1 + F.col("dist_ma20")) - 1 / (1 + F.col("ret20")))
    return df.agg(F.count(F.lit(1)).alias("bars_known"), F.sum((F.abs(gap) > 1e-9).cast("int")).alias("broken"))


@query("w15_market_features", q.with_(*PRICE_PARTS, _MKT) + "select code, date, " + ", ".join(
    f"{q.r6(c)} {c}" for c in FEATURE_GROUPS["market"]) + " from q8")
def _w15(spark, folder):
    return rounded(matrix.with_market_features(matrix.with_price_features(bars(spark, folder))), list(FEATURE_GROUPS["market"]))


@query("w16_cross_section", q.with_(*MATRIX_PARTS) + "select code, date, " + ", ".join(
    f"{q.r6(c, 5)} {c}" for c in FEATURE_GROUPS["cross"]) + " from q9")
def _w16(spark, folder):
    price = matrix.with_price_features(bars(spark, folder))
    df = matrix.cross_section(staged(price.select("code", "date", *CROSS_SOURCES.values())))
    return df.select("code", "date", *[r6(F.col(c), 5).alias(c) for c in FEATURE_GROUPS["cross"]])


_ALL = [c for fs in FEATURE_GROUPS.values() for c in fs]
MATRIX_SQL = q.with_(*MATRIX_PARTS, q.label_cte("webpro"), """fc as (select a.code, a.seq, count(b.close) n, max(b.close) mc
  from s a left join s b on b.code=a.code and b.seq between a.seq+1 and a.seq+10 group by 1,2)""",
  """mx as (select q9.*, l.entry_open, l.forward_max_return fwd_max_high, l.forward_min_return fwd_min_low,
  l.label_bull label_high, l.label_resolved::int resolved,
  case when n>=10 and l.entry_open>0 then mc/l.entry_open-1 end fwd_max_close,
  case when n>=10 and l.entry_open>0 then (mc>l.entry_open*(1e0+0.3))::int end label_close
  from q9 join lab_webpro l using (code, date) join fc on fc.code=q9.code and fc.seq=q9.seq)""")


@query("m14_feature_matrix", MATRIX_SQL + "select code, date, label_high, label_close, resolved, " + ", ".join(
    f"{q.r6(c, 5)} {c}" for c in [*_ALL, "entry_open", "fwd_max_high", "fwd_min_low", "fwd_max_close"]) + " from mx")
def _m14(spark, folder):
    df = matrix.feature_matrix(bars(spark, folder))
    return df.select("code", "date", "label_high", "label_close", "resolved", *[r6(F.col(c), 5).alias(c) for c in (
        *_ALL, "entry_open", "fwd_max_high", "fwd_min_low", "fwd_max_close")])


@query("l03_close_label", MATRIX_SQL + f"select code, date, {q.r6('fwd_max_close')} fwd_max_close, label_close, "
       "case when entry_open is null then 'no_entry' when entry_open<=0 then 'bad_entry' else 'ok' end entry_state from mx")
def _l03(spark, folder):
    from ..operators.outcomes import close_outcomes
    return close_outcomes(bars(spark, folder), 10, 0.30).select(
        "code", "date", r6(F.col("fwd_max_close")).alias("fwd_max_close"), "label_close", "entry_state")
