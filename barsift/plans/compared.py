"""Stored artefacts against their source, ways to one number against each other, and the controls that go with both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import back
from ..operators import audits as au
from ..operators import context, crosssec as xs, matrix
from ..operators import nullbattery as nb
from ..operators import tablediff as td
from ..session import staged
from ..sources.tables import bars
from . import sqltext as q
from .features import PRICE_PARTS
from .nulls import _normal
from .registry import query
from .selection import _auc_sql, popq, population, six

CUT = "2000-01-03"
STORED = ["ret5", "vol20", "pos_60", "dist_ma20"]
KEYS, WITHIN = ["code", "date"], ["code", "year"]


def _artefact(spark, folder) -> DataFrame:
    """Price features as they are stored."""
    rows = matrix.with_price_features(bars(spark, folder)).select("code", "date", F.year("date").alias("year"), *STORED)
    return staged(rows)


def _edited(rows: DataFrame) -> DataFrame:
    """The same table with planted faults, each in other codes and years."""
    code, year = F.col("code"), F.col("year")
    out = rows.filter(~((code == "000023") & (year < 1995))).withColumns({
        "ret5": F.when(code.endswith("3") & (year == 1996), F.col("ret5") + 0.01).otherwise(F.col("ret5")),
        "vol20": F.when(code == "000011", F.col("vol20") * (1 + 2.0 ** -52)).otherwise(F.col("vol20")),
        "pos_60": F.when((code != "000017") | (year != 1997), F.col("pos_60"))})
    extra = rows.filter((code == "000002") & (year == 1998)).withColumn("code", F.lit("999902"))
    return out.unionByName(rows.filter((code == "000031") & (year == 1994))).unionByName(extra)


_LEFT = f"ar as materialized (select code, date, year(date) as yr, {', '.join(STORED)} from q4)"
_SIDE = """ed as materialized (select * from (select code, date, yr, case when code like '%3' and yr=1996 then ret5+0.01::double else ret5 end ret5,
  case when code='000011' then vol20*(1e0+pow(2e0,-52)) else vol20 end vol20, case when code<>'000017' or yr<>1997 then pos_60 end pos_60, dist_ma20 from ar where not (code='000023' and yr<1995))
  union all select * from ar where code='000031' and yr=1994 union all select '999902', date, yr, ret5, vol20, pos_60, dist_ma20 from ar where code='000002' and yr=1998),
na as (select code, date, count(*) n from ar group by all), nd as (select code, date, count(*) n from ed group by all),
ky as (select coalesce(na.code, nd.code) code, coalesce(na.date, nd.date) date, na.n a, nd.n b from na full join nd on na.code=nd.code and na.date=nd.date),
kk as (select *, case when a>1 or b>1 then 'repeated' when b is null then 'only_left' when a is null then 'only_right' end kind from ky)"""


def _bits(x: str) -> str:
    return f"((abs({x})::double::bit)::bigint*sign({x})::bigint)"


def _class(a: str, b: str, steps: str, near: int = 4) -> str:
    return f"""case when {a} is null and {b} is null then 'exact' when {a} is null or {b} is null then 'one_unknown' when {a}={b} then 'exact'
  when {steps}<={near} then 'rounding' else 'real' end"""


_CELLS = " union all ".join(f"""select '{c}' as "column", {_class(f'ar.{c}', f'ed.{c}', f"abs({_bits(f'ar.{c}')}-{_bits(f'ed.{c}')})")} kind, code||'|'||date::varchar k, ar.{c} l, ed.{c} r
  from ar join ed using (code, date) join kk using (code, date) where kk.kind is null""" for c in STORED)


@query("q02_artefact_diff", q.with_(*PRICE_PARTS, _LEFT, _SIDE, f"""al as (select * from ({_CELLS}) where kind<>'exact'
  union all select '(key)', kind, code||'|'||date::varchar, null, null from kk where kind is not null)""")
       + f"""select "column", kind, count(*) as "rows", min(k) first_key, {q.r6('arg_min(l,k)')} left_value, {q.r6('arg_min(r,k)')} right_value from al group by 1, 2""")
def _q02d(spark, folder):
    """The stored table against one with planted edits: changed, nudged, erased, missing, added and doubled rows."""
    stored = _artefact(spark, folder)
    return six(td.table_diff(stored, _edited(stored), KEYS, STORED, WITHIN), "left_value", "right_value")


@query("q02_opened_buckets", q.with_(*PRICE_PARTS, _LEFT, _SIDE) + f"""select code, yr "year", count(*) filter (s=0) left_rows, count(*) filter (s=1) right_rows from (
  select code, yr, date, {', '.join(STORED)}, 0 s from ar union all select code, yr, date, {', '.join(STORED)}, 1 from ed) where (code, yr) in (
    select (code, yr) from (select code, yr, date, {', '.join(STORED)}, sum(s) n from (select code, yr, date, {', '.join(STORED)}, 1 s from ar union all
      select code, yr, date, {', '.join(STORED)}, -1 from ed) group by all) where n<>0) group by 1, 2""")
def _q02b(spark, folder):
    """Only parts that hold an edit are opened."""
    stored = _artefact(spark, folder)
    got = td.unequal_buckets(stored, _edited(stored), KEYS, STORED, WITHIN)
    return got.withColumnsRenamed({"_b0": "code", "_b1": "year"})


@query("q02_artefact_from_source", q.with_(*PRICE_PARTS) + "select count(*) as \"rows\", 0 unequal_parts from q4")
def _q02s(spark, folder):
    """The stored table equals what the source gives when it is built again."""
    stored = _artefact(spark, folder)
    again = matrix.with_price_features(bars(spark, folder)).select("code", "date", F.year("date").alias("year"), *STORED)
    parts = td.unequal_buckets(stored, again, KEYS, STORED, WITHIN).agg(F.count(F.lit(1)).alias("unequal_parts"))
    return stored.agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(parts))


KDJ = ["kdj_k", "kdj_d", "kdj_j"]


@query("q02_kdj_truncation", q.with_(q.BARS, q.SEQ, q.KDJ) + " union all ".join(
    f"""select '{c}' feature, count(*) compared, 0 differing, {q.r6(f"avg({e}) filter (r.seq=0)")} mean_of_first_bars from rsv r join kd using (code, seq) where date<=date '{CUT}'"""
    for c, e in zip(KDJ, ("k", "d", "3*k-2*d"))))
def _q02k(spark, folder):
    """KDJ rebuilt on bars up to a date, beside its mean on first bars, which start from the fixed value."""
    panel = bars(spark, folder)
    got = au.truncation_test(panel, context.with_kdj, KDJ, CUT, 1e-9).select("feature", "compared", "differing")
    first = context.with_kdj(panel).withColumn("_prev", back("date", 1)).filter("_prev is null")
    means = xs.melt(first.filter(F.col("date") <= F.lit(CUT).cast("date")), ["code"], KDJ).groupBy("feature").agg(F.avg("x").alias("mean_of_first_bars"))
    return six(got.join(means, "feature"), "mean_of_first_bars")


RANKED = ["close", "volume", "score", "noise"]
_NOISY = "lg as (" + " union all ".join(f"select code, date, y, '{c}' feature, {c} x from nz" for c in RANKED) + ")"


@query("q02_noise_control", popq(f"nz as (select *, {_normal(repr('5'))} noise from pop)", _NOISY, """lp as (select feature, date, y,
  (rank() over (partition by feature, date order by x)+(count(*) over (partition by feature, date, x)-1)/2e0)/count(*) over (partition by feature, date) x from lg)""",
    f"ra as ({_auc_sql('lp', 'feature')})", f"rb as (select feature, avg(auc) m, count(auc) n from ({_auc_sql('lp', 'feature, date')}) where auc is not null group by 1)")
    + f"select feature, {q.r6('auc')} auc, {q.r6('m')} mean_session_auc, rb.n n_sessions from ra join rb using (feature)")
def _q02n(spark, folder):
    """What a rank inside the session tells about the label, pooled and by session, beside a rank of noise."""
    rows = population(spark, folder).withColumn("noise", nb.normal(F.lit("5"), F.col("code"), F.col("date")))
    return six(xs.rank_evidence(rows, RANKED), "auc", "mean_session_auc")


_WAYS = {
    "return": ("close/open-1e0", "(close-open)/open", 64, "0.05::double"),
    "middle": ("(high+low)/2e0", "low+(high-low)/2e0", 64, "close"),
    "target": ("open*1.05::double", "open+0.05::double*open", 64, "high"),
    "stored": ("open", "(open::float)::double", 32, "high/1.05::double"),
    "lagged": ("close", "lc", 64, "open"),
}


def _steps(a: str, b: str, width: int) -> str:
    if width == 64:
        return f"abs({_bits(a)}-{_bits(b)})"
    return f"abs((abs({a})::double::bit)::bigint//pow(2,29)::bigint-(abs({b})::double::bit)::bigint//pow(2,29)::bigint)"


_LONG = " union all ".join(f"""select '{n}' as "check", {_class('a', 'b', 'st')} as "class", st, ((a>m)<>(b>m))::int flip from (
  select ({a})::double a, ({b})::double b, ({m})::double m, {_steps(f'({a})', f'({b})', w)} st from lgd)""" for n, (a, b, w, m) in _WAYS.items())


@query("q07_tolerance_classes", q.with_(q.BARS, "lgd as (select *, lag(close) over (partition by code order by date) lc from bars)", f"wy as ({_LONG})")
       + """select "check", "class", count(*) as "rows", max(st)::bigint most_steps, sum(flip)::bigint flips from wy group by 1, 2""")
def _q07t(spark, folder):
    """Two ways to five numbers: how far apart they land, and how many decisions that turns."""
    c = {n: F.col(n) for n in ("open", "high", "low", "close")}
    rows = bars(spark, folder).withColumn("_before", back("close", 1))
    pairs = {
        "return": (c["close"] / c["open"] - 1, (c["close"] - c["open"]) / c["open"], 64),
        "middle": ((c["high"] + c["low"]) / 2, c["low"] + (c["high"] - c["low"]) / 2, 64),
        "target": (c["open"] * 1.05, c["open"] + 0.05 * c["open"], 64),
        "stored": (c["open"], c["open"].cast("float").cast("double"), 32),
        "lagged": (c["close"], F.col("_before"), 64)}
    bound = {"return": F.lit(0.05), "middle": c["close"], "target": c["high"], "stored": c["high"] / 1.05, "lagged": c["open"]}
    return td.tolerance_classes(rows, pairs, bound)
