"""SQL building blocks for checking queries in a second engine.

These restate the definitions with joins, recursion and plain windows. They are the yardstick
of the Spark operators, never part of their execution.
"""

from __future__ import annotations

from ..functions.fixed import REGIMES


def bars_cte(every: str = "week") -> str:
    day = "date_trunc('week', l_shipdate)::date" if every == "week" else "l_shipdate::date"
    return f"""l as (select lpad(l_suppkey::varchar,6,'0') code, {day} d,
  floor((20+l_extendedprice/10000.0)*100)/100 px,
  (l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_quantity) k, l_quantity q from lineitem),
bars as (select code, d as date, arg_min(px,k) as open, max(px) high, min(px) low,
  arg_max(px,k) as close, sum(q) volume from l group by 1,2)"""


BARS = bars_cte()

SEQ = "s as (select *, row_number() over (partition by code order by date)-1 as seq from bars)"

KDJ = """rsv as (select code, date, seq,
  case when max(high) over w - min(low) over w > 1e-12
    then (close - min(low) over w)/(max(high) over w - min(low) over w)*100e0 else 50e0 end rsv
  from s window w as (partition by code order by date rows between 8 preceding and current row)),
kd as (
  select code, seq, (1e0-1e0/3e0)*50e0+1e0/3e0*rsv k,
    (1e0-1e0/3e0)*50e0+1e0/3e0*((1e0-1e0/3e0)*50e0+1e0/3e0*rsv) d from rsv where seq=0
  union all
  select r.code, r.seq, (1e0-1e0/3e0)*kd.k+1e0/3e0*r.rsv,
    (1e0-1e0/3e0)*kd.d+1e0/3e0*((1e0-1e0/3e0)*kd.k+1e0/3e0*r.rsv)
  from kd join rsv r on r.code=kd.code and r.seq=kd.seq+1)"""


def label_cte(regime: str, name: str | None = None, source: str = "s", spec: tuple | None = None) -> str:
    """Outcomes by self joins: the path, the first exceed, and the low up to it."""
    h, ret, floor = spec or REGIMES[regime]
    n = name or f"lab_{regime}"
    return f"""{n}_e as (select a.code, a.date, a.seq, b.open entry from {source} a
  left join {source} b on b.code=a.code and b.seq=a.seq+1),
{n}_f as (select a.code, a.seq, count(b.high) fb, max(b.high) fh, min(b.low) fl
  from {source} a left join {source} b on b.code=a.code and b.seq between a.seq+1 and a.seq+{h} group by 1,2),
{n}_h as (select a.code, a.seq, min(b.seq) hit from {n}_e a join {source} b
  on b.code=a.code and b.seq between a.seq+1 and a.seq+{h} and b.high > a.entry*(1e0+{ret}) group by 1,2),
{n}_p as (select a.code, a.seq, any_value(a.hit) hit, min(b.low) hl from {n}_h a join {source} b
  on b.code=a.code and b.seq between a.seq+1 and a.hit group by 1,2),
{n} as (select e.code, e.date, e.seq, e.entry entry_open, f.fb future_bars,
  f.fh/(e.entry+1e-12)-1 forward_max_return, f.fl/(e.entry+1e-12)-1 forward_min_return,
  p.hit-e.seq bars_to_target,
  case when f.fb>={h} and e.entry is not null then (f.fh > e.entry*(1e0+{ret}))::int end label_bull,
  case when f.fb>={h} and e.entry is not null then (coalesce(p.hl,f.fl) >= {floor}*e.entry)::int end label_strict_low,
  (f.fb>={h} and e.entry is not null) label_resolved
  from {n}_e e join {n}_f f using (code,seq) left join {n}_p p using (code,seq))"""


def r6(x: str, digits: int = 6) -> str:
    return f"(round(({x})::double+3.7e-9,{digits})+0e0)"


def wilson_sql(hits: str, n: str, z: float = 1.959963984540054) -> tuple[str, str]:
    p, m = f"(({hits})/({n})::double)", f"({n})::double"
    half = f"{z}*sqrt(greatest({p}*(1-{p})/{m}+{z}*{z}/(4*{m}*{m}),0))"
    mid, den = f"({p}+{z}*{z}/(2*{m}))", f"(1+{z}*{z}/{m})"
    return (f"case when ({n})>0 then greatest(0e0,({mid}-{half})/{den}) end",
            f"case when ({n})>0 then least(1e0,({mid}+{half})/{den}) end")


def with_(*parts: str, recursive: bool = True) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"


GRID = "s.seq>=60 and s.seq%5=0"


def dedupe_cte(source: str, name: str, keys: list[str], cooldown: int, clock: str | None = None) -> str:
    """Greedy cooldown by recursion: from each kept signal to the next one far enough away."""
    k = "".join(f"{c}," for c in keys)
    same = "".join(f" and a.{c}=b.{c}" for c in keys)
    pos = clock or f"dense_rank() over ({'partition by ' + ','.join(keys) if keys else ''} order by date)"
    return f"""{name}_p as (select *, {pos} pos from {source}),
{name}_n as (select {''.join(f'a.{c},' for c in keys)} a.code, a.pos, min(b.pos) nxt from {name}_p a
  left join {name}_p b on b.code=a.code{same} and b.pos>=a.pos+{cooldown} group by all),
{name}_k as (select {k} code, min(pos) pos from {name}_p group by all
  union all select {''.join(f'b.{c},' for c in keys)} b.code, b.nxt from {name}_k a join {name}_n b
  on a.code=b.code{same} and a.pos=b.pos where b.nxt is not null),
{name} as (select p.* from {name}_p p join {name}_k k using ({k} code, pos))"""
