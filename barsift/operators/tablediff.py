"""Tables compared by parts, and floating-point differences sorted by how many representable numbers lie between."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Bits after the leading one, and the least exponent of numbers that have one.
DIGITS, LEAST = 52, -1022
#: Bits that a 32-bit float lacks.
_LESS = 29
#: A bucket of keys that a diff opens or passes over as a whole.
BUCKETS = 1_024


def with_places(df: DataFrame, places: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``out: column``, the number of a finite double among all doubles.

    Neighbours differ by one, both zeros are 0, NaN, infinity and NULL are NULL. Made of exact steps only: powers of two,
    comparisons and divisions by powers of two. Each step is a column of its own, so that none is written out again in the next.
    """
    two = F.lit(2.0)
    size = {o: F.when(F.abs(c) < float("inf"), F.abs(F.col(c).cast("double"))) for o, c in places.items()}
    df = df.withColumns({f"_a_{o}": a for o, a in size.items()})
    df = df.withColumns({f"_g_{o}": F.floor(F.log2(f"_a_{o}")).cast("double") for o in places})

    def exponent(o: str) -> Column:
        # The logarithm may round over the next power of two.
        a, g = F.col(f"_a_{o}"), F.col(f"_g_{o}")
        return g - (F.pow(two, g) > a).cast("double") + (F.pow(two, g + 1) <= a).cast("double")

    df = df.withColumns({f"_e_{o}": exponent(o) for o in places})

    def number(o: str, c: str) -> Column:
        a, e = F.col(f"_a_{o}"), F.col(f"_e_{o}")
        normal = (e - LEAST + 1).cast("bigint") * (1 << DIGITS) + ((a / F.pow(two, e) - 1) * 2.0 ** DIGITS).cast("bigint")
        # In two steps, as the least double has no inverse.
        small = (a * 2.0 ** 600 * 2.0 ** (DIGITS - LEAST - 600)).cast("bigint")
        return F.when(a < 2.0 ** LEAST, small).otherwise(normal) * F.when(F.col(c) < 0, -1).otherwise(1)

    df = df.withColumns({o: number(o, c) for o, c in places.items()})
    return df.drop(*[f"_{x}_{o}" for o in places for x in "age"])


def classified(df: DataFrame, a: str, b: str, near: int = 4, narrow: str | None = None) -> DataFrame:
    """``df`` with ``class`` and ``steps``: how two double columns differ.

    ``exact``: equal, or unknown (NULL, NaN) on both sides; ``rounding``: at most ``near`` steps between neighbouring doubles
    apart; ``real``: further; ``one_unknown``. Where the boolean column ``narrow`` holds, steps are those of 32-bit floats
    (numbers under their least normal one aside).
    """
    df = with_places(df, {"_pa": a, "_pb": b})
    if narrow:
        df = df.withColumns({p: F.when(F.col(narrow), F.signum(p).cast("bigint") * F.shiftright(F.abs(p), _LESS)).otherwise(F.col(p)) for p in ("_pa", "_pb")})
    df = df.withColumn("steps", F.abs(F.col("_pa") - F.col("_pb"))).drop("_pa", "_pb")
    known_a, known_b = (F.col(c).isNotNull() & ~F.isnan(c) for c in (a, b))
    return df.withColumn("class", F.when(~known_a & ~known_b, "exact").when(~known_a | ~known_b, "one_unknown").when(F.col(a) == F.col(b), "exact")
                         .when(F.coalesce(F.col("steps") <= near, F.lit(False)), "rounding").otherwise("real"))


def tolerance_classes(rows: DataFrame, pairs: dict[str, tuple[Column, Column, int]], bound: dict[str, Column] | None = None, near: int = 4) -> DataFrame:
    """(check, class, rows, most_steps, flips): how two ways to one number differ.

    ``pairs`` names a check and gives both columns and the width of their floats, 64 or 32. ``flips`` counts rows of which only
    one way exceeds the check's ``bound`` (NULL without a bound). Counts are combined before the shuffle.
    """
    bound = bound or {}
    cells = F.array(*[F.struct(F.lit(n).alias("check"), a.cast("double").alias("a"), b.cast("double").alias("b"), F.lit(width == 32).alias("narrow"),
                               bound.get(n, F.lit(None)).cast("double").alias("bound")) for n, (a, b, width) in pairs.items()])
    long = classified(rows.select(F.explode(cells).alias("_r")).select("_r.*"), "a", "b", near, "narrow")
    flip = ((F.col("a") > F.col("bound")) != (F.col("b") > F.col("bound"))).cast("int")
    return long.groupBy("check", "class").agg(F.count(F.lit(1)).alias("rows"), F.max("steps").alias("most_steps"), F.sum(flip).alias("flips"))


def _bucket(keys: list[str], within: list[str] | None, buckets: int) -> list[Column]:
    if within:
        return [F.col(c).alias(f"_b{i}") for i, c in enumerate(within)]
    return [F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_b0")]


def unequal_buckets(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], within: list[str] | None = None,
                    buckets: int = BUCKETS) -> DataFrame:
    """Buckets of keys whose rows differ: ``_b0 ..``, ``left_rows``, ``right_rows``.

    A bucket is a value of ``within``, columns that a key determines, or a hash of the key. Each side is read once and shuffles one
    row per task and bucket: a count, the xor and the sum of its rows' hashes. A doubled row cancels in the xor, not in the sum.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64(*[F.col(c) for c in (*keys, *columns)])
        # NULL and absence of a column's value hash alike, so the places of unknown values are hashed as well.
        h = F.xxhash64(h, *[F.col(c).isNull() for c in (*keys, *columns)])
        at = _bucket(keys, within, buckets)
        return df.select(*at, h.alias("_h"), F.lit(name).alias("_side"))

    both = side(left, "l").unionByName(side(right, "r"))
    at = [c for c in both.columns if c.startswith("_b")]
    mine = {s: F.when(F.col("_side") == s, F.col("_h")) for s in "lr"}
    got = both.groupBy(*at).agg(
        *[F.count(mine[s]).alias(f"{n}_rows") for s, n in (("l", "left"), ("r", "right"))],
        *[F.coalesce(F.bit_xor(mine[s]), F.lit(0)).alias(f"_x{s}") for s in "lr"],
        *[F.coalesce(F.sum(mine[s].cast("decimal(38,0)")), F.lit(0)).alias(f"_s{s}") for s in "lr"])
    same = (F.col("left_rows") == F.col("right_rows")) & (F.col("_xl") == F.col("_xr")) & (F.col("_sl") == F.col("_sr"))
    return got.filter(~same).select(*at, "left_rows", "right_rows")


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], within: list[str] | None = None,
               buckets: int = BUCKETS, near: int = 4) -> DataFrame:
    """Differences between two tables of one key: one row per ``column`` and ``kind``, with ``rows`` and the first key.

    Kinds: ``rounding``, ``real`` and ``one_unknown`` for a numeric column (see ``classified``); for the column ``(key)``:
    ``only_left``, ``only_right``, and ``repeated`` for a key that has several rows on a side, whose values aren't compared then (the same rows as often on both sides are no difference).
    ``first_key`` is the least of the keys, as text, joined by ``|``; ``left_value`` and ``right_value`` are its values. Equal
    tables give no row. Null keys are keys like others.

    Only rows of buckets with unequal fingerprints are looked at: equal buckets are neither joined nor shuffled. Rows of the
    others are counted by key and values on both sides, so a repeated row is one row before the shuffle.
    """
    opened = staged(unequal_buckets(left, right, keys, columns, within, buckets))
    at = [c for c in opened.columns if c.startswith("_b")]

    def rows_of(df: DataFrame, name: str) -> DataFrame:
        kept = df.select(*_bucket(keys, within, buckets), *keys, *[F.col(c).cast("double").alias(c) for c in columns])
        cond = [F.col(f"k.{c}").eqNullSafe(F.col(f"o.{c}")) for c in at]
        kept = kept.alias("k").join(opened.alias("o"), reduce(lambda a, b: a & b, cond), "left_semi")
        return kept.select(*keys, *columns, *[(F.lit(1) if s == name else F.lit(0)).alias(f"_n{s}") for s in "lr"])

    both = rows_of(left, "l").unionByName(rows_of(right, "r"))
    rows = both.groupBy(*keys, *columns).agg(F.sum("_nl").alias("_nl"), F.sum("_nr").alias("_nr"))
    values = F.struct(*columns)
    per = rows.groupBy(*keys).agg(F.sum("_nl").alias("_nl"), F.sum("_nr").alias("_nr"), F.sum(F.abs(F.col("_nl") - F.col("_nr"))).alias("_off"),
                                  F.max(F.when(F.col("_nl") > 0, values)).alias("_l"), F.max(F.when(F.col("_nr") > 0, values)).alias("_r")).filter("_off > 0")
    many = (F.col("_nl") > 1) | (F.col("_nr") > 1)
    none = F.lit(None).cast("double")
    whole = F.when(many, "repeated").when(F.col("_nr") == 0, "only_left").when(F.col("_nl") == 0, "only_right")

    def cell(column: str, left_value: Column = none, right_value: Column = none) -> Column:
        return F.struct(F.lit(column).alias("column"), left_value.alias("left_value"), right_value.alias("right_value"))

    cells = F.when(F.col("_whole").isNotNull(), F.array(cell("(key)"))).otherwise(F.array(*[cell(c, F.col(f"_l.{c}"), F.col(f"_r.{c}")) for c in columns]))
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    long = per.select(key.alias("_key"), whole.alias("_whole"), "_l", "_r").select("_key", "_whole", F.explode(cells).alias("_c")).select("_key", "_whole", "_c.*")
    kinds = classified(long, "left_value", "right_value", near).withColumn("kind", F.coalesce("_whole", "class")).filter("kind <> 'exact'")
    got = kinds.groupBy("column", "kind").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("_key", "left_value", "right_value")).alias("_first"))
    return got.select("column", "kind", "rows", F.col("_first._key").alias("first_key"), "_first.left_value", "_first.right_value")
