"""SQL statement of the rules, over the weekly bars."""

from __future__ import annotations

from ..functions.fixed import SELECTORS, STRATEGIES
from . import sqltext as q

LAGS = (1, 2, 3, 5, 6, 9, 10, 15, 19, 20, 21, 25, 34, 35, 39, 40, 41)


def over(expr: str, a: int, b: int) -> str:
    def edge(n: int) -> str:
        return "current row" if n == 0 else f"{abs(n)} {'preceding' if n < 0 else 'following'}"
    return f"{expr} over (partition by code order by date rows between {edge(a)} and {edge(b)})"


def lag(x: str, n: int) -> str:
    return f"lag({x},{n}) over (partition by code order by date)"


def c01(x: str) -> str:
    return f"greatest(0e0,least(1e0,{x}))"


def _prims() -> str:
    first = ",\n".join(
        [f"{lag('close', n)} c{n}" for n in LAGS]
        + [f"{lag('open', 1)} o1",
           f"greatest(high-low,abs(high-{lag('close', 1)}),abs(low-{lag('close', 1)})) tr",
           "case when high-low<=1e-12 then 0.5e0 else greatest(0e0,least(1e0,(close-low)/(high-low))) end cl",
           "greatest(0e0,high-greatest(open,close))/(abs(open)+1e-12) uw",
           "greatest(0e0,least(open,close)-low)/(abs(open)+1e-12) lw",
           "(high-low)/(abs(open)+1e-12) hls",
           "k-d kd"]
        + [f"{over(e, a, b)} {n}" for n, e, a, b in (
            ("v5", "avg(volume)", -4, 0), ("vb", "avg(volume)", -20, -5),
            ("v5_1", "avg(volume)", -5, -1), ("vb_1", "avg(volume)", -21, -6),
            ("v5_5", "avg(volume)", -9, -5), ("vb_5", "avg(volume)", -25, -10),
            ("vs10", "sum(volume)", -9, 0), ("vm20", "avg(volume)", -19, 0), ("vm10", "avg(volume)", -9, 0),
            ("vsd10", "stddev_pop(volume)", -9, 0), ("vm20_5", "avg(volume)", -24, -5),
            ("m5p", "max(close)", -5, -1), ("m20p", "max(close)", -20, -1), ("m40p", "max(close)", -40, -1),
            ("m20pp", "max(close)", -21, -2), ("n20p", "min(close)", -20, -1), ("m20", "max(close)", -19, 0),
            ("m10", "max(close)", -9, 0), ("n10", "min(close)", -9, 0),
            ("m20_10", "max(close)", -29, -10), ("n20_10", "min(close)", -29, -10),
            ("m20_21", "max(close)", -40, -21), ("n20_21", "min(close)", -40, -21),
            ("bc", "min(close)", -34, -15), ("bl", "min(low)", -14, -5),
            ("h10", "max(high)", -9, 0), ("h10_10", "max(high)", -19, -10),
            ("l10", "min(low)", -9, 0), ("l10_10", "min(low)", -19, -10),
            ("a20", "avg(close)", -19, 0), ("s20", "stddev_pop(close)", -19, 0),
            ("s5", "stddev_pop(close)", -4, 0), ("s15", "stddev_pop(close)", -19, -5),
            ("kmin", "min(k)", -4, 0))])
    second = ",\n".join([
        "close/(c1+1e-12)-1 r", "case when close>c1 then volume else 0e0 end uv",
        "sign(close-c1)*volume sv", "greatest(close-c1,0e0) gn", "greatest(c1-close,0e0) ls"])
    third = ",\n".join(
        [f"{lag('r', n)} r{n}" for n in (1, 2, 7, 8, 9)] + [f"{lag('kd', n)} kd{n}" for n in (2, 4)]
        + [f"{over(e, a, b)} {n}" for n, e, a, b in (
            ("rm5", "max(r)", -4, 0), ("ru10", "sum((r>0)::int)", -9, 0), ("ev", "sum((r>=0.085)::int)", -19, 0),
            ("uv10", "sum(uv)", -9, 0), ("ob", "sum(sv)", -18, 0), ("g14", "sum(gn)", -13, 0),
            ("l14", "sum(ls)", -13, 0), ("atr", "avg(tr)", -13, 0), ("cn", "avg(cl)", -4, 0),
            ("co", "avg(cl)", -9, -5))]
        + [f"{over('max(case when r>=0.085 then date end)', -19, 0)} ed"])
    fourth = ",\n".join([
        "v5/(vb+1e-12) vr", "v5_1/(vb_1+1e-12) vr1", "v5_5/(vb_5+1e-12) vr5",
        "close/(m5p+1e-12)-1 p5", "close/(m20p+1e-12)-1 p20", "close/(m40p+1e-12)-1 p40",
        "c1/(m20pp+1e-12)-1 p20b", "(m10-n10)/(abs(n10)+1e-12) g10", "(m20p-n20p)/(abs(n20p)+1e-12) g20b",
        "(m20_10-n20_10)/(abs(n20_10)+1e-12) g20_10", "(m20_21-n20_21)/(abs(n20_21)+1e-12) g20_21",
        "uv10/(vs10+1e-12) pv", "ob/(vm20+1e-12) os", "atr/(close+1e-12) ap", "kd-kd2 dk3", "kd-kd4 dk5",
        "v5/(vm20_5+1e-12) tq",
        "case when l14/14<=1e-12 then case when g14/14>1e-12 then 100e0 else 50e0 end "
        "else 100e0-100e0/(1e0+(g14/14)/(l14/14)) end rsi",
        "(select any_value(e.close) from bars e where e.code=t3.code and e.date=t3.ed) ec"])
    return f"""t1 as (select s.*, kd.k, kd.d from s join kd using (code, seq)),
t1b as (select *, {first} from t1),
t2 as (select *, {second} from t1b),
t3 as (select *, {third} from t2),
p as (select *, {fourth} from t3 where seq>=60 and seq%5=0)"""


def ret(n: int, k: int = 0) -> str:
    return f"({'close' if k == 0 else f'c{k}'}/(c{n + k}+1e-12)-1)"


def slope(w: int) -> str:
    return f"((close-c{w - 1})/(abs(c{w - 1})+1e-12))"


def yes(cond: str) -> str:
    return f"({cond})::int::double"


VUP = c01("(vr-1)/1e0")

SCORES = {
    "leader_momentum": [
        f"(({c01('r2/0.08')}+{c01('r1/0.08')}+{c01('r/0.08')})/3e0)", "cl", "ru10/10e0", c01("v5/4e0"), c01("vr/2e0")],
    "first_board_breakout": [yes("rm5<0.09"), yes("p20>=0.01 and p20b<=0"), "cl", yes("vr>=1.2 and vr<=2.5")],
    "reversal_engulf": [
        c01(f"-{ret(4, 1)}/0.08"), c01(f"-{ret(1, 1)}/0.04"),
        c01("greatest(0e0,close-open)/(greatest(0e0,o1-c1)+1e-12)"), c01("p5/0.03"), c01("lw/0.03"), c01("(vr-1)/0.5")],
    "washout_complete": [
        f"(0.5*{c01(f'({ret(35)}+0.04)/0.20')}+0.5*{c01(f'({slope(35)}+0.02)/0.16')})",
        f"(0.55*{c01(f'-{ret(4, 5)}/0.06')}+0.45*{c01('(1.10-vr5)/0.60')})",
        c01("((bl-bc)/(abs(bc)+1e-12))/0.05"), f"(0.5*{c01('(kd+4)/18e0')}+0.5*{c01('dk5/20e0')})",
        f"(0.55*cl+0.45*{c01(f'({ret(3)}+0.01)/0.07')})"],
    "accumulation_base": [
        c01("(g20_10-g10)/(0.50*g20_10+1e-12)"), c01("(pv-0.50)/0.25"), c01("(0.20-vsd10/(vm10+1e-12))/0.20"),
        f"(0.70*{c01('(cn-co)/0.25')}+0.30*cl)"],
    "platform_breakout": [
        yes("g20b<=0.70*g20_21"), yes("p20>=0.01 and p40>=0.01"), VUP, c01(f"(0.30-{ret(20, 1)})/0.30")],
    "main_wave_acceleration": [
        yes(f"{ret(5)}>=0.03 and {ret(10)}>=0.05 and {ret(20)}>=0.10"),
        yes(f"{slope(10)}>0 and {slope(20)}>0 and {slope(40)}>0"), yes("h10>h10_10 and l10>l10_10"),
        yes("(r2+r1+r)/3e0>(r9+r8+r7)/3e0 and r>0"),
        f"(case when {ret(20)}<=0.20 then 1e0 else {c01(f'(0.40-{ret(20)})/0.20')} end)"],
    "oversold_rebound": [
        c01("-(c1/(m20p+1e-12)-1)/0.15"), c01("1-(c1-n20p)/(m20p-n20p+1e-12)"),
        f"(0.55*{c01(f'-{ret(4, 1)}/0.05')}+0.45*{c01('(1.10-vr1)/0.70')})",
        f"(0.40*{c01('(30-kmin)/20e0')}+0.35*{c01('dk5/15e0')}+0.25*{c01('kd/5e0')})", c01("lw/0.06"),
        f"(0.55*cl+0.45*{c01(f'{ret(3)}/0.06')})"],
    "turnover_weak_to_strong": [
        c01(f"-{ret(20, 5)}/0.15"), f"least({c01('tq-1')},{c01(f'{ret(5)}/0.10')})", "cl", c01("hls/0.12"), VUP],
    "high_level_consensus": [
        yes(f"{ret(20, 1)}>=0.08 and {ret(40, 1)}>=0.12"),
        yes(f"{ret(5, 1)}>=-0.08 and {ret(5, 1)}<=0.05 and kd>=-8 and dk3>=0"),
        yes(f"{ret(3)}>=0.04 and cl>=0.75 and vr>=1.25"), yes("p20>=0.02 and uw<=0.10 and hls<=0.08")],
    "donchian_turtle": [
        c01("(p20+0.01)/0.04"), c01(f"{slope(20)}/0.12"), VUP,
        f"(case when ap>=0.015 and ap<=0.08 then 1e0 when ap<0.015 then {c01('ap/0.015')} "
        f"else {c01('(0.12-ap)/0.04')} end)"],
    "bollinger_squeeze": [
        c01("(0.12-s20/(a20+1e-12))/0.06"), c01("(close-a20)/(2*s20+1e-12)+0.5"), c01("(s5/(s15+1e-12)-1)/1e0"),
        VUP, "cl"],
    "rsi_mean_reversion": [
        c01("(45-rsi)/20e0"), c01("-(close/(m20+1e-12)-1)/0.20"), c01("0.65*lw/0.08+0.35*cl"), c01("dk3/8e0"),
        c01("(3-vr)/1.5")],
    "gap_follow_through": [
        f"(case when open/(c1+1e-12)-1>0 then {c01('(open/(c1+1e-12)-1-0.005)/0.055')} else 0e0 end)", "cl", VUP,
        yes("close>c1 and low>=c1*0.985"), c01("1-uw/0.12")],
    "pullback_retest": [
        c01("(c5/(c15+1e-12)-1)/0.12"),
        f"(case when {ret(5)}<=0.02 then {c01(f'(0.02-{ret(5)})/0.10')} else 0e0 end)", c01("(p20+0.08)/0.06"),
        c01("(1.5-vr)/0.75"), "cl"],
    "obv_volume_price": [
        c01(f"{slope(20)}/0.12"), c01("os/2e0"), c01("(pv-0.35)/0.45"), VUP, "cl"],
    "turnover_regime_switch": [
        f"least({c01('(tq-1)/1e0')},{c01(f'{ret(5)}/0.10')})", f"least({c01(f'-{ret(3)}/0.08')},{c01('(1.5-tq)/1e0')})",
        c01("dk3/8e0"), c01("abs(tq-1)/0.75")],
    "relative_strength_rank": [
        c01(f"{ret(5)}/0.12"), c01(f"{ret(20)}/0.25"), c01(f"{ret(40)}/0.50"),
        c01(f"({slope(20)}+{slope(40)})/2e0/0.15"), "cl"],
    "atr_trend_follow": [
        c01("(p20+0.02)/0.05"), c01(f"{slope(20)}/0.15"),
        f"(case when ap<0.02 then {c01('(ap-0.01)/0.01')} else {c01('(0.12-ap)/0.04')} end)", "cl",
        c01("(close-l10)/(1.5*atr+1e-12)")],
    "limit_up_retest": [
        c01("least(ev,2)/2e0"), f"(case when ev>0 then {c01('(close/(ec+1e-12)-0.98)/0.12')} else 0e0 end)",
        c01("rm5/0.08"), VUP, f"(0.65*cl+0.35*{c01('1-uw/0.12')})"],
}


def score_sql(name: str) -> str:
    weights = STRATEGIES[name][1].values()
    return "(" + "+".join(f"{w}::double*{x}" for w, x in zip(weights, SCORES[name], strict=True)) + ")"


PRIMS = ",\n".join([q.BARS, q.SEQ, q.KDJ, _prims()])


def rule_of(name: str) -> tuple[str, float]:
    return (name, STRATEGIES[name][0]) if name in STRATEGIES else SELECTORS[name]


def decisions_cte(names: list[str], keep: str = "") -> str:
    """CTE ``dec``: long decisions of the named strategies on the grid."""
    base = "\n union all ".join(
        f"select code,date,seq,{keep} '{n}' strategy_id, {score_sql(rule_of(n)[0])} score, "
        f"{rule_of(n)[1]}::double threshold from p" for n in names)
    return f"dec as (select *, (score>=threshold)::int prediction from ({base}))"
