"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import EPS, LIMIT_MAIN, LIMIT_WIDE, WIDE_PREFIXES, Z_EXACT


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Bound ``x``; unknown stays unknown (least/greatest alone would skip the NULL)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def over_eps(a: Column, b: Column) -> Column:
    """``a / (b + EPS)`` for a denominator that cannot be ``-EPS``."""
    return a / (b + F.lit(EPS))


def guarded(a: Column, b: Column) -> Column:
    """``a / b``, unknown where the denominator vanishes."""
    return F.when(F.abs(b) >= F.lit(EPS), a / b)


def flag(cond: Column) -> Column:
    """1.0 / 0.0 with unknown counted as not met."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def both(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, cols)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def ln_guarded(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


# Far below the reported digits: moves exact halves off the rounding boundary.
NUDGE = 3.7e-9


def r6(x: Column, digits: int = 6) -> Column:
    """Rounded report value; adding zero turns -0.0 into 0.0.

    Spark rounds a double by way of a decimal number's text. Away from a half, and below the size where a double's own steps
    show, the nearest integer of the scaled value divided by the scale is the same double; the rest is rounded by Spark.
    """
    moved, scale = x + F.lit(NUDGE), F.lit(10.0 ** digits)
    scaled = moved * scale
    plain = (F.abs(scaled) < 1e11) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(plain, F.rint(scaled) / scale).otherwise(F.round(moved, digits)) + F.lit(0.0)


def known(x: Column) -> Column:
    """NaN to NULL, the only spelling of unknown inside the panel."""
    return F.when(~F.isnan(x), x)


def wilson(hits: Column, n: Column, z: float = Z_EXACT) -> tuple[Column, Column]:
    """Lower and upper Wilson bound, clamped to [0, 1]."""
    size = n.cast("double")
    p = hits / size
    z2 = F.lit(z * z)
    spread = p * (F.lit(1.0) - p) / size + z2 / (F.lit(4.0) * size * size)
    # A share of exactly 0 or 1 may leave a rounding remainder below zero.
    half = F.lit(z) * F.sqrt(F.greatest(spread, F.lit(0.0)))
    centre = p + z2 / (F.lit(2.0) * size)
    denom = F.lit(1.0) + z2 / size
    low = F.when(n > 0, F.greatest(F.lit(0.0), (centre - half) / denom))
    high = F.when(n > 0, F.least(F.lit(1.0), (centre + half) / denom))
    return low, high


def six_digit_code(c: str | Column) -> Column:
    """Integer code as text padded to six digits; longer codes keep every digit."""
    text = col(c).cast("bigint").cast("string")
    return F.when(F.length(text) >= 6, text).otherwise(F.lpad(text, 6, "0"))


def price_limit(code: str | Column) -> Column:
    return F.when(F.substring(col(code), 1, 3).isin(*WIDE_PREFIXES), F.lit(LIMIT_WIDE)).otherwise(
        F.lit(LIMIT_MAIN))


def hash_draw(*parts: Column) -> Column:
    """Engine-independent 32-bit draw from a key; used for resampling."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
