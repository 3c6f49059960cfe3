"""Per-code windows: one partitioning and ordering shared by every rolling expression."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import col


_KEYS: ContextVar[tuple[str, ...]] = ContextVar("keys of a history", default=("code",))
_ORDER: ContextVar[tuple[str, ...]] = ContextVar("order of a history", default=("date",))

#: Bars of a block, and the column that numbers a code's blocks (see ``blocked``).
BLOCK, BLOCK_NO = 512, "_block"


@contextmanager
def histories(*keys: str) -> Iterator[None]:
    """Window expressions built inside run over the rows of these keys, not of a code.

    With ``code`` among them, rows that lie together by code need no further shuffle.
    """
    mark = _KEYS.set(keys)
    try:
        yield
    finally:
        _KEYS.reset(mark)


@contextmanager
def in_blocks() -> Iterator[None]:
    """Window expressions built inside are ordered by block, then date, over rows that ``blocked`` has numbered.

    That is the order by date, spelled as the windows inside a block need it: all of them share one sort.
    """
    mark = _ORDER.set((BLOCK_NO, "date"))
    try:
        yield
    finally:
        _ORDER.reset(mark)


def blocked(df: DataFrame) -> DataFrame:
    """Rows with the number of their block of bars inside their code, for ``in_blocks``."""
    return df.withColumn(BLOCK_NO, F.floor(seq() / BLOCK))


def history_keys() -> tuple[str, ...]:
    return _KEYS.get()


def history_order() -> tuple[str, ...]:
    return _ORDER.get()


def by_code():
    return Window.partitionBy(*_KEYS.get()).orderBy(*_ORDER.get())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over all shuffle partitions, whatever their bytes: for steps that make much of few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def span(first: int, last: int):
    return by_code().rowsBetween(first, last)


def back(c: str | Column, n: int) -> Column:
    """Value ``n`` bars ago (negative looks ahead)."""
    return (F.lag(col(c), n) if n >= 0 else F.lead(col(c), -n)).over(by_code())


def seq() -> Column:
    """Zero-based bar index of a code."""
    return F.row_number().over(by_code()) - F.lit(1)


_AGGREGATES = {
    "mean": F.avg, "std": F.stddev_samp, "pstd": F.stddev_pop, "max": F.max, "min": F.min,
    "sum": F.sum, "count": F.count,
}


def roll(c: str | Column, window: int, how: str = "mean", least: int = 1, skip: int = 0) -> Column:
    """Backward statistic over ``window`` bars ending ``skip`` bars ago.

    Known only where at least ``least`` of the values are known.
    """
    frame = span(-(window - 1) - skip, -skip)
    value = _AGGREGATES[how](col(c)).over(frame)
    if least <= 1:
        return value
    return F.when(F.count(col(c)).over(frame) >= least, value)


def half_window(c: str | Column, window: int, how: str = "mean") -> Column:
    """Rolling statistic that needs half of its window, and two values at least."""
    return roll(c, window, how, least=max(2, window // 2))


def by_doubling(df: DataFrame, out: dict[str, tuple[str, str, int, int]]) -> DataFrame:
    """Backward statistics of long windows, at the logarithm of a window's bars for each row.

    ``out`` maps a new column to ``(source, "max" | "min" | "sum" | "mean", bars, least)``. A span of 2p bars is two spans of p bars;
    an extreme is that of two spans that may overlap, a sum is cut into spans by the binary digits of its length. Counts of
    known values are differences of running counts. A statistic is known only where at least ``least`` values are.
    """
    def kind(how: str) -> str:
        return "sum" if how == "mean" else how

    def name(c: str, how: str, p: int) -> str:
        return f"_d_{how}_{c}_{p}"

    join = {"max": F.greatest, "min": F.least, "sum": lambda a, b: a + F.coalesce(b, F.lit(0.0))}
    widest: dict[tuple[str, str], int] = {}
    for c, how, window, _ in out.values():
        widest[c, kind(how)] = max(window, widest.get((c, kind(how)), 0))
    first = {name(c, how, 1): F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if how == "sum" else F.col(c) for c, how in widest}
    counts = {f"_n_{c}": F.count(c).over(by_code().rowsBetween(Window.unboundedPreceding, 0)) for c, _ in widest}
    df = df.withColumns({**first, **counts})
    made, p = [*first, *counts], 1
    while 2 * p <= max(widest.values()):
        level = {name(c, how, 2 * p): join[how](F.col(name(c, how, p)), back(name(c, how, p), p))
                 for (c, how), w in widest.items() if 2 * p <= w}
        df = df.withColumns(level)
        made += level
        p *= 2

    def value(c: str, how: str, window: int) -> Column:
        top = 1 << (window.bit_length() - 1)
        if how != "sum":
            whole = F.col(name(c, how, top))
            return whole if window == top else join[how](whole, back(name(c, how, top), window - top))
        total, past = None, 0
        for bit in reversed(range(window.bit_length())):
            if window >> bit & 1:
                part = F.coalesce(back(name(c, how, 1 << bit), past), F.lit(0.0)) if past else F.col(name(c, how, 1 << bit))
                total, past = part if total is None else total + part, past + (1 << bit)
        return total

    done = {}
    for o, (c, how, window, least) in out.items():
        n = F.col(f"_n_{c}") - F.coalesce(back(f"_n_{c}", window), F.lit(0))
        got = value(c, kind(how), window)
        done[o] = F.when(n >= max(least, 1), got / n if how == "mean" else got)
    return df.withColumns(done).drop(*made)


def half_windows(df: DataFrame, out: dict[str, tuple[str, str, int]]) -> DataFrame:
    """``by_doubling`` where half of a window, and two values at least, must be known."""
    return by_doubling(df, {o: (c, how, w, max(2, w // 2)) for o, (c, how, w) in out.items()})


def forward_extreme(df: DataFrame, out: dict[str, tuple[str, str]], window: int) -> DataFrame:
    """Maximum / minimum over the next ``window`` bars in time linear in the history.

    The history is cut into blocks of ``window`` bars; a running extreme from each end of a
    block covers any forward window with two values. ``out`` maps a new column to
    ``(source, "max" | "min")``. Rows with fewer than ``window`` later bars get NULL.
    """
    cut = df.withColumn("_p", seq()).withColumn("_b", F.floor(F.col("_p") / window))
    up = Window.partitionBy("code", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("code", "_b").orderBy(F.desc("date")).rowsBetween(
        Window.unboundedPreceding, 0)
    pick = {"max": (F.max, F.greatest), "min": (F.min, F.least)}
    heads = {f"_h_{n}": pick[how][0](c).over(up) for n, (c, how) in out.items()}
    tails = {f"_t_{n}": pick[how][0](c).over(down) for n, (c, how) in out.items()}
    cut = cut.withColumns(tails).withColumns(heads)
    cut = cut.withColumn("_last", back("_p", -window))
    cut = cut.withColumns({
        n: F.when(F.col("_last").isNotNull(),
                  pick[how][1](back(f"_t_{n}", -1), back(f"_h_{n}", -window)))
        for n, (c, how) in out.items()})
    return cut.drop("_p", "_b", "_last", *heads, *tails)


# One block of a weighted running sum spans at most this many natural-log units of decay.
_BLOCK_DECAY = 600.0
# A gap that ages a state by more than this leaves nothing of it in a double.
_LONGEST_GAP = 80.0

Specs = dict[str, tuple[str, float, float | None, int]]


def _decayed_by(factor: float):
    return lambda state, end: state * factor + end


def _in_shared_blocks(df: DataFrame, alphas: list[float]) -> bool:
    """Whether the rows are numbered by shared blocks, and these means may run over such a block."""
    steepest = max(-math.log(1.0 - a) for a in alphas)
    return history_order()[0] == BLOCK_NO and BLOCK_NO in df.columns and BLOCK * steepest <= _BLOCK_DECAY


def ewm(df: DataFrame, specs: Specs, gaps: bool = False) -> DataFrame:
    """Exponentially weighted means as weighted running sums, exact to rounding.

    ``specs`` maps a new column to ``(source, alpha, start, least)``. With a start value the
    recursion begins there; without one it begins at the first known value. A mean is unknown
    until ``least`` values are known. With ``gaps`` an unknown value ages the state without
    changing it, and the next known value is weighed against the aged state; without it the
    source must have no unknown value.

    ``E_t = a_t E_{t-1} + b_t`` is solved as ``A_t * sum(b_i / A_i)`` with ``A`` the running
    product of ``a``. Blocks bound the exponent of the fastest mean; the ends of all earlier blocks
    carry over, each decayed by the blocks in between, so slow means keep their whole history. A
    code has one end per few hundred bars. Under ``in_blocks`` the shared blocks serve, and no sort is added.
    """
    if gaps:
        for out, spec in specs.items():
            df = _ewm_with_gaps(df, out, *spec)
        return df
    decay = {o: math.log(1.0 - alpha) for o, (_, alpha, _, _) in specs.items()}
    df = df.withColumn("_p", seq())
    if _in_shared_blocks(df, [alpha for _, alpha, _, _ in specs.values()]):
        size, block = BLOCK, BLOCK_NO
        df = df.withColumn("_b", F.col(BLOCK_NO))
    else:
        size, block = max(1, int(_BLOCK_DECAY / max(-d for d in decay.values()))), "_b"
        df = df.withColumn("_b", F.floor(F.col("_p") / size))
    # Block, then date: the same order as by date alone, shared by both windows below.
    inside = Window.partitionBy("code", block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("code").orderBy(block, "date").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_p") - F.col("_b") * size
    local = {}
    for o, (c, alpha, start, _) in specs.items():
        first = F.col(c) if start is None else F.col(c) * alpha + start * (1.0 - alpha)
        weight = F.when(F.col("_p") == 0, first).otherwise(F.col(c) * alpha)
        local[f"_e_{o}"] = F.exp(at * decay[o]) * F.sum(weight * F.exp(-at * decay[o])).over(inside)
    df = df.withColumns(local)
    df = df.withColumns({
        f"_z_{o}": F.collect_list(F.when(at == size - 1, F.col(f"_e_{o}"))).over(before) for o in specs})
    done = {}
    for o, (_, _, _, least) in specs.items():
        ends = F.aggregate(f"_z_{o}", F.lit(0.0), _decayed_by(math.exp(size * decay[o])))
        carried = ends * F.exp((at + 1) * decay[o])
        done[o] = F.when(F.col("_p") + 1 >= least, F.col(f"_e_{o}") + carried)
    return df.withColumns(done).drop("_p", "_b", *local, *[f"_z_{o}" for o in specs])


def _ewm_with_gaps(df: DataFrame, out: str, source: str, alpha: float, start: float | None, least: int) -> DataFrame:
    """One mean over a source with unknown values; the decay between rows varies with the gap."""
    if start is not None:
        raise ValueError("a start value needs a source without gaps")
    to_now = by_code().rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(source)
    decay = math.log(1.0 - alpha)
    df = df.withColumn("_p", seq())
    df = df.withColumn("_prev", F.max(F.when(x.isNotNull(), F.col("_p"))).over(
        by_code().rowsBetween(Window.unboundedPreceding, -1)))
    gap = (F.col("_p") - F.col("_prev")).cast("double")
    aged = F.exp(gap * decay)
    opens = F.col("_prev").isNull()
    df = df.withColumns({
        "_l": F.when(x.isNull() | opens, F.lit(0.0)).otherwise(gap * decay - F.ln(aged + alpha)),
        "_w": F.when(x.isNull(), F.lit(0.0)).when(opens, x).otherwise(x * alpha / (aged + alpha))})
    if _in_shared_blocks(df, [alpha]):
        # The decay inside a block is bounded, so the blocks that other means use serve here as well.
        df = df.withColumn("_l", F.greatest(F.col("_l"), F.lit(-_LONGEST_GAP)))
        inside = Window.partitionBy("code", BLOCK_NO).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy("code").orderBy(BLOCK_NO, "date").rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumns({"_c": F.sum("_l").over(inside), "_seen": F.count(x).over(to_now)})
        df = df.withColumn("_e", F.exp("_c") * F.sum(F.col("_w") * F.exp(-F.col("_c"))).over(inside))
        ends = F.when(F.col("_p") % BLOCK == BLOCK - 1, F.struct(F.col("_e").alias("e"), F.col("_c").alias("c")))
        df = df.withColumn("_z", F.collect_list(ends).over(before))
        state = F.aggregate("_z", F.lit(0.0), lambda s, end: s * F.exp(end["c"]) + end["e"])
        return df.withColumn(out, F.when(F.col("_seen") >= max(least, 1), F.col("_e") + state * F.exp("_c"))).drop(
            "_p", "_prev", "_l", "_w", "_c", "_seen", "_e", "_z")
    df = df.withColumns({"_c": F.sum("_l").over(to_now), "_seen": F.count(x).over(to_now)})
    df = df.withColumn("_b", F.floor(-F.col("_c") / _BLOCK_DECAY))
    inside = Window.partitionBy("code", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ordered = Window.partitionBy("code").orderBy("_b", "date")
    rest = F.col("_c") + F.col("_b") * _BLOCK_DECAY
    df = df.withColumn("_e", F.exp(rest) * F.sum(F.col("_w") * F.exp(-rest)).over(inside))
    df = df.withColumn("_next", F.lead("_b").over(ordered))
    df = df.withColumn("_z", F.last(
        F.when(F.col("_next") != F.col("_b"), F.struct(F.col("_e").alias("e"), F.col("_c").alias("c"))),
        ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    carried = F.coalesce(F.col("_z.e") * F.exp(F.col("_c") - F.col("_z.c")), F.lit(0.0))
    return df.withColumn(out, F.when(F.col("_seen") >= max(least, 1), F.col("_e") + carried)).drop(
        "_p", "_prev", "_l", "_w", "_c", "_seen", "_b", "_e", "_next", "_z")
