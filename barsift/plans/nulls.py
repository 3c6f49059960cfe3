"""The null battery over the population of resolved bars, with its shuffles and draws stated in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import nullbattery as nb
from ..operators.strategies import close_location
from ..session import staged
from . import sqltext as q
from .labels import labelled
from .registry import query
from .selection import FOLDS, plan_of, popq

FEATURES = ["close", "volume", "high", "low", "score"]
RATE, FLOORS = 0.02, [100, 500, 2000]


def _test_rows(spark, folder):
    rows = labelled(spark, folder, "webpro").filter("label_resolved")
    score = (30.5 - F.col("close")) / 10.5 * 0.7 + 0.3 * close_location()
    pop = staged(rows.select("code", "date", F.col("label_bull").alias("y"), F.col("forward_max_return").alias("ahead"), score.alias("score"),
                             "close", "volume", "high", "low"))
    plan = staged(plan_of(pop))
    test = nb.published(nb.scored(nb.variants(pop, plan, FEATURES)), RATE)
    return staged(test.select("variant", "fold", "y", "score", "out", "n_train"))


def _draw(*parts: str) -> str:
    return f"('0x'||substr(md5(concat_ws(':',{','.join(parts)})),1,8))::bigint"


def _bijection(name: str, source: str, tag: str, group: str = "") -> list[str]:
    """CTEs that send ``i`` of ``source`` to ``x``, one per round."""
    out = [f"{name}0 as materialized (select *, i x from {source})"]
    for r in range(nb.ROUNDS):
        bit = f"ascii(md5(concat_ws(':',{tag},{group}'{r}',greatest(x,o))))%2"
        k = _draw(tag, f"'{r}'")
        out.append(f"""{name}{r + 1} as materialized (select * exclude (x, o), case when {bit}=1 then o else x end x
  from (select *, (({k}-x)%n+n)%n o from {name}{r}))""")
    return out


_OWN = [f"f{i}" for i in range(len(FEATURES))]
_X = [f"x{i}" for i in range(len(FEATURES) + 1)]
_TAGS = [*((str(s), "y") for s in nb.GLOBAL), *((f"{nb.SHUFFLED}-{i}", f) for i, f in enumerate(_OWN))]


def _normal(key: str) -> str:
    a, b = (f"(({_draw(side, key, 'code', 'date')}+0.5::double)/4294967296e0)" for side in ("'a'", "'b'"))
    return f"(sqrt(-2*ln({a}))*cos(2*pi()*{b}))"


def _case(name: str, y: str, xs: list[str], plant: str = "null::double") -> str:
    return f"select fold, role, date, code, '{name}' as variant, {y} y, " + ", ".join(f"{v} {x}" for v, x in zip([*xs, plant], _X)) + " from wf"


def _drawn(seed: int) -> str:
    return f"""(({_draw(f"'{seed}'", 'code', 'date')}+0.5::double)/4294967296e0<(select avg(y) from nk))::int::double"""


def _noise(seed: int) -> list[str]:
    return [_normal(f"'{seed}-{i}'") for i in range(len(_OWN))]


_CASES = " union all ".join([
    _case("real", "y", _OWN),
    *[_case(f"labels_shuffled_{s}", f"y{s}", _OWN) for s in nb.GLOBAL],
    _case("labels_shuffled_in_session", f"y{nb.WITHIN}", _OWN),
    _case("labels_drawn", _drawn(nb.DRAWN), _OWN),
    *[_case(f"normal_features_{s}", "y", _noise(s)) for s in nb.NORMAL],
    _case("normal_features_drawn_labels", _drawn(nb.DOUBLE), _noise(nb.DOUBLE)),
    _case("features_shuffled", "y", [f"p{i}" for i in range(len(_OWN))]),
    _case("train_labels_shuffled", "case role when 'train' then own else y end", _OWN),
    _case("test_labels_shuffled", "case role when 'test' then own else y end", _OWN),
    _case("outcome_planted", "y", _OWN, f"ahead+{nb.STRONG_NOISE}::double*{_normal(repr(str(nb.STRONG)))}"),
    _case("label_planted", "y", _OWN, f"y+{nb.WEAK_NOISE}::double*{_normal(repr(str(nb.WEAK)))}"),
])

_PARTS = [
    FOLDS,
    "nk as (select p.code, p.date, y::double y, forward_max_return ahead, " + ", ".join(f"{c}::double f{i}" for i, c in enumerate(FEATURES))
    + ", row_number() over (order by p.date, p.code)-1 i, count(*) over () n from pop p join lab_webpro using (code, date))",
    "ga as (select tag, i, n, case tag " + " ".join(f"when '{t}' then {c}" for t, c in _TAGS) + " end v from nk, (values "
    + ",".join(f"('{t}')" for t, _ in _TAGS) + ") t(tag))",
    *_bijection("gb", "ga", "tag"),
    "gd as (select x i, " + ", ".join(f"max(case when tag='{t}' then v end) {n}" for (t, _), n in zip(
        _TAGS, [*(f"y{s}" for s in nb.GLOBAL), *(f"p{i}" for i in range(len(_OWN)))])) + f" from gb{nb.ROUNDS} group by 1)",
    "wa as (select date, y v, row_number() over (partition by date order by code)-1 i, count(*) over (partition by date) n from nk)",
    *_bijection("wb", "wa", f"'{nb.WITHIN}'", "date,"),
    f"wd as (select k.code, k.date, b.v y{nb.WITHIN} from (select code, date, row_number() over (partition by date order by code)-1 i from nk) k join wb{nb.ROUNDS} b on b.date=k.date and b.x=k.i)",
    "fa as (select fold, role, code, date, y v, row_number() over (partition by fold, role order by date, code)-1 i, count(*) over (partition by fold, role) n from nk join fold using (date) where role is not null)",
    *_bijection("fb", "fa", "'fold'", "fold,role,"),
    f"zf as (select a.fold, a.role, a.code, a.date, b.v own from fa a join fb{nb.ROUNDS} b on b.fold=a.fold and b.role=a.role and b.x=a.i)",
    "wf as (select * from zf join nk using (code, date) join gd using (i) join wd using (code, date))",
    f"vr as ({_CASES})",
    "wt as (select variant, fold, " + ", ".join(
        f"case when var_pop({x})>0 then (avg({x}) filter (y=1)-avg({x}) filter (y<>1))/var_pop({x}) end w_{x}" for x in _X) + " from vr where role='train' group by all)",
    "sc as (select variant, fold, role, date, code, y, " + "+".join(f"coalesce({x}*w_{x},0e0)" for x in _X) + " score from vr join wt using (variant, fold))",
    f"""th as (select variant, fold, min(score) threshold, any_value(n) n_train from (select variant, fold, score, row_number() over (partition by variant, fold order by score desc) rn,
  count(*) over (partition by variant, fold) n from sc where role='train') where rn<=greatest(1,round_even(n*{RATE}::double,0)) group by all)""",
    "te as (select sc.*, n_train, (score>=threshold)::int as pub from sc join th using (variant, fold) where role='test')",
]


def _auc(keys: str) -> str:
    return f"""(select {keys}, case when sum(y)>0 and sum(y)<count(*) then (sum(y*rr)-sum(y)*(sum(y)+1)/2e0)/(sum(y)*(count(*)-sum(y))) end auc from (
  select *, rank() over (partition by {keys} order by score)+(count(*) over (partition by {keys}, score)-1)/2e0 rr from te) group by all)"""


@query("i05_null_battery", popq(*_PARTS, f"au as {_auc('variant, fold')}") + f"""select variant, fold, any_value(n_train) n_train, count(*) n_test, sum(pub)::bigint signals,
  {q.r6('avg(y)')} base_rate, {q.r6('avg(y) filter (pub=1)')} "precision", {q.r6('any_value(auc)')} auc, {q.r6('avg(y) filter (pub=1)/nullif(avg(y),0)')} lift
  from te join au using (variant, fold) group by 1, 2""")
def _i05b(spark, folder):
    got = nb.fold_rows(_test_rows(spark, folder))
    return got.withColumns({c: r6(F.col(c)) for c in ("base_rate", "precision", "auc", "lift")})


_POOL = [
    "pf as (select variant, fold, count(*) n, sum(y) pos, sum(pub) s, sum(pub*y) h from te group by all)",
    "pp as (select variant, count(*) n_folds, sum(n)::bigint n_test, sum(s)::bigint signals, sum(h)/nullif(sum(s),0) p, sum(pos)/sum(n) b, sum(s*pos/n)/nullif(sum(s),0) bs, "
    "count(*) filter (h/nullif(s,0)>pos/n) folds_above_base from pf group by 1)",
    "cu as (select variant, sum(count(*)) over (partition by variant order by score desc) n, sum(sum(y)) over (partition by variant order by score desc) h from te group by variant, score)",
    "bo as (select variant, " + ", ".join(f"{q.r6(f'max(h/n) filter (n>={f})')} best_of_{f}" for f in FLOORS) + " from cu group by 1)",
    f"au as {_auc('variant')}"]


@query("i05_null_battery_pooled", popq(*_PARTS, *_POOL) + f"""select variant, n_folds, n_test, signals, folds_above_base, {q.r6('p')} "precision", {q.r6('b')} base_rate, {q.r6('bs')} base_rate_by_signals,
  {q.r6('p/nullif(bs,0)')} lift, {q.r6('auc')} auc, bo.* exclude (variant) from pp join bo using (variant) join au using (variant)""")
def _i05p(spark, folder):
    got = nb.pooled(_test_rows(spark, folder), FLOORS)
    return got.withColumns({c: r6(F.col(c)) for c in ("precision", "base_rate", "base_rate_by_signals", "lift", "auc", *[f"best_of_{f}" for f in FLOORS])})


SEEDS = (11, 22)
_OWN_X = _X[:len(FEATURES)]
_FORMS = [
    FOLDS,
    "nk as (select p.code, p.date, y::double y, " + ", ".join(f"{c}::double x{i}" for i, c in enumerate(FEATURES)) + " from pop p)",
    "fa as (select tag, fold, role, code, date, y v, row_number() over (partition by tag, fold, role order by date, code)-1 i, count(*) over (partition by tag, fold, role) n "
    "from nk join fold using (date), (values " + ",".join(f"('null-{s}')" for s in SEEDS) + ") t(tag) where role is not null)",
    *_bijection("fb", "fa", "tag", "fold,role,"),
    f"""vr as (select 'real' as variant, fold, role, code, date, y, {', '.join(_OWN_X)} from nk join fold using (date) where role is not null
  union all select replace(a.tag,'-','_'), a.fold, a.role, a.code, a.date, b.v, {', '.join(_OWN_X)} from fa a join fb{nb.ROUNDS} b on b.tag=a.tag and b.fold=a.fold and b.role=a.role and b.x=a.i
  join nk k on k.code=a.code and k.date=a.date)""",
    "wt as (select variant, fold, " + ", ".join(f"case when var_pop({x})>0 then (avg({x}) filter (y=1)-avg({x}) filter (y<>1))/var_pop({x}) end w_{x}" for x in _OWN_X)
    + " from vr where role='train' group by all)",
    "sc as (select variant, fold, role, date, code, y, " + "+".join(f"coalesce({x}*w_{x},0e0)" for x in _OWN_X) + " score from vr join wt using (variant, fold))",
    _PARTS[-2], _PARTS[-1],
    "fr as (select variant, fold, count(*) n, avg(y) b, sum(pub) s, sum(pub*y) h, avg(y) filter (pub=1) p from te group by all)",
    """pa as (select a.variant, count(*) k, sum(a.s)::bigint s, sum(a.h)/nullif(sum(a.s),0) p, sum(a.b*a.n)/sum(a.n) b, count(*) filter (a.p>a.b) up,
  count(*) filter (r.p>a.p) w, count(*) filter (r.p<a.p) l, avg(r.p-a.p) d from fr a left join (select fold, p from fr where variant='real') r using (fold) group by 1)""",
    "tp as (select s, h from fr where variant='real' order by s desc, fold limit 1)",
    "al as (select pa.*, case when variant='real' then (p*s-(select h from tp))/nullif(s-(select s from tp),0) end rest, (select avg(p) from pa where variant<>'real') np from pa)",
]


@query("m12_paired_verdict", popq(*_FORMS) + f"""select variant, k n_folds, s signals, {q.r6('p')} "precision", {q.r6('b')} base_rate, up folds_above_base,
  case when variant<>'real' then w end folds_real_above, case when variant<>'real' then {q.r6('d')} end mean_difference,
  case when variant<>'real' then {q.r6('list_sum(list_transform(range(w, w+l+1), lambda j: factorial((w+l)::int)/(factorial(j::int)*factorial((w+l-j)::int))))/pow(2e0,w+l)')} end sign_p,
  {q.r6('rest')} without_largest, case when variant='real' then case when up=k and np<1.6::double*b and rest>2*b then 'TRUSTWORTHY' else 'NEEDS REVIEW' end end verdict from al""")
def _m12p(spark, folder):
    """Real labels against labels permuted inside every fold and role, over the same folds."""
    rows = labelled(spark, folder, "webpro").filter("label_resolved")
    score = (30.5 - F.col("close")) / 10.5 * 0.7 + 0.3 * close_location()
    pop = staged(rows.select("code", "date", F.col("label_bull").alias("y"), score.alias("score"), "close", "volume", "high", "low"))
    forms = nb.fold_permutations(pop, staged(plan_of(pop)), FEATURES, SEEDS)
    got = nb.paired_verdict(nb.fold_rows(nb.published(nb.scored(forms), RATE), area=False))
    return got.withColumns({c: r6(F.col(c)) for c in ("precision", "base_rate", "mean_difference", "sign_p", "without_largest")})
