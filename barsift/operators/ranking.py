"""Ranks, running totals and quantiles of groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

# Distinct positions of one range, on average; the ranges of a group grow with its size.
RANGE_ROWS = 200_000


def cumulative(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None,
               split_rows: int = RANGE_ROWS, unique: bool = False) -> DataFrame:
    """Running totals over the distinct ``order`` positions of each group, ascending.

    Returns one row per group and position with ``n`` (rows there) and, for ``n`` and every
    entry of ``sums``, ``before_*`` (total of smaller positions) and ``all_*`` (total of the
    group). Equal positions are combined before the shuffle. A group is cut at positions chosen by a
    hash of the position itself, one in ``split_rows``, so every run and every retry cuts alike and a
    range has about as many positions at any size; each range is summed on its own and the ranges'
    totals are added up. A group of few positions has no cut and is one range.

    ``unique`` says that positions seldom repeat and that ``df`` is cheap to read: rows then go to their range in one shuffle,
    without being combined and stored before. The result is the same.
    """
    sums = {"n": F.count(F.lit(1)), **(sums or {})}
    names = list(sums)
    df, keys = _keyed(df, group)
    if unique:
        placed = _in_ranges(df, keys, order, split_rows)
        ranges = placed.groupBy("_k").agg(*[s.alias(n) for n, s in sums.items()])
        cells = placed.repartition("_k").groupBy("_k", *order).agg(*[s.alias(n) for n, s in sums.items()])
    else:
        cells = _in_ranges(staged(df.groupBy(*keys, *order).agg(*[s.alias(n) for n, s in sums.items()])), keys, order, split_rows)
        ranges = cells.groupBy("_k").agg(*[F.sum(n).alias(n) for n in names])
    inside = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cells.select("_k", *order, *names, *[F.sum(n).over(inside).alias(f"_c_{n}") for n in names])
    out = local.join(_offsets(ranges, keys, names), "_k")
    return out.select(
        *[F.col(f"_k.{k}") for k in group], *order, *names,
        *[(F.col(f"_o_{n}") + F.col(f"_c_{n}") - F.col(n)).alias(f"before_{n}") for n in names],
        *[f"all_{n}" for n in names])


def _keyed(df: DataFrame, group: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows and the columns of their group; the whole table is one group where none is named."""
    return (df, list(group)) if group else (df.withColumn("_all", F.lit(0)), ["_all"])


def _in_ranges(df: DataFrame, keys: list[str], order: list[str], split_rows: int) -> DataFrame:
    """Rows with ``_k``, their group and the range of positions they lie in.

    Group and range are one column, since windows and joins on it then share a layout where null equals null.
    """
    spot = F.struct(*order)
    # One row in ``split_rows``.
    cuts = df.filter(F.pmod(F.xxhash64(*keys, *order), F.lit(split_rows)) == 0)
    cuts = cuts.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.sort_array(F.collect_set(spot)).alias("_cuts"))
    placed = df.join(F.broadcast(cuts), _same([(k, f"_k_{k}") for k in keys]), "left")
    return placed.select(*df.columns, F.struct(*keys, F.coalesce(_passed("_cuts", spot), F.lit(0)).alias("_range")).alias("_k"))


def _offsets(ranges: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """For each range the totals of earlier ranges of its group (``_o_*``) and of the group (``all_*``)."""
    # One row per range of a group meets in these two windows.
    whole = Window.partitionBy(*[F.col(f"_k.{k}") for k in keys])
    earlier = whole.orderBy("_k._range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(
        "_k", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_o_{n}") for n in names],
        *[F.sum(n).over(whole).alias(f"all_{n}") for n in names])


def _passed(cuts: str, spot: Column) -> Column:
    """How many of the sorted ``cuts`` are not above ``spot``, by halving: a row costs the logarithm of their number."""
    def halve(found: Column, width: Column) -> Column:
        # The cuts up to here are passed; try a step of this width beyond them.
        ahead = found + width
        return F.when((ahead <= F.size(cuts)) & (F.get(cuts, ahead - 1) <= spot), ahead).otherwise(found)

    widths = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.size(cuts))).cast("int")),
                         lambda i: F.pow(F.lit(2.0), F.floor(F.log2(F.size(cuts))) - i).cast("int"))
    return F.when(F.size(cuts) > 0, F.aggregate(widths, F.lit(0), halve))


def _same(pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of several columns."""
    return F.expr(" and ".join(f"({a} <=> {b})" for a, b in pairs))


def _looked_up(df: DataFrame, ranks: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on columns of the same names where null equals null."""
    other = ranks.select(*[F.col(c).alias(f"_k_{c}") if c in on else c for c in ranks.columns])
    return df.join(other, _same([(c, f"_k_{c}") for c in on]), how).drop(*[f"_k_{c}" for c in on])


def average_rank(dist: DataFrame) -> Column:
    """Mean rank of the tied rows at a position, counted from one."""
    return F.col("before_n") + (F.col("n") + 1) / 2


def percentile_rank(df: DataFrame, group: list[str], value: str, out: str, **kw) -> DataFrame:
    """Average rank over the count of known values; unknown values get no rank."""
    dist = cumulative(df.filter(F.col(value).isNotNull()), group, [value], **kw)
    ranks = dist.select(*group, value, ((F.col("before_n") + (F.col("n") + 1) / 2) / F.col("all_n")).alias(out))
    return _looked_up(df, ranks, [*group, value], "left")


def row_numbers(df: DataFrame, group: list[str], order: list[str], out: str = "row_no", split_rows: int = RANGE_ROWS) -> DataFrame:
    """Zero-based position of each row in a total order, and the group's size as ``group_rows``. Rows travel once, to their range."""
    keyed, keys = _keyed(df, group)
    placed = _in_ranges(keyed, keys, order, split_rows)
    ranges = placed.groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
    local = placed.withColumn("_at", F.rank().over(Window.partitionBy("_k").orderBy(*order)).cast("bigint") - 1)
    return local.join(_offsets(ranges, keys, ["n"]), "_k").select(
        *df.columns, (F.col("_o_n") + F.col("_at")).alias(out), F.col("all_n").alias("group_rows"))


def quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float], **kw) -> DataFrame:
    """Exact quantiles with linear interpolation; one row per group, a column per entry."""
    dist = cumulative(df.filter(F.col(value).isNotNull()), group, [value], **kw)
    first, last = F.col("before_n"), F.col("before_n") + F.col("n") - 1
    aggs = []
    for name, p in probs.items():
        at = (F.col("all_n") - 1) * F.lit(p)
        lo, hi = F.floor(at), F.ceil(at)
        aggs += [
            F.max(F.when((first <= lo) & (lo <= last), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((first <= hi) & (hi <= last), F.col(value))).alias(f"_hi_{name}"),
            F.max(at - lo).alias(f"_w_{name}")]
    got = dist.groupBy(*group).agg(*aggs)
    return got.select(*group, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
        for n in probs])
