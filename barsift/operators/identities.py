"""Identities between report tables, declared as rows and checked in one pass over a long form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Identity:
    """Per ``key``, the sum of ``left`` over the rows of one table equals that of ``right`` over another's, or a constant.

    ``left`` and ``right`` are SQL expressions; without ``right_table``, ``right`` is the constant.
    """

    name: str
    key: tuple[str, ...]
    left_table: str
    left: str
    right: str
    right_table: str | None = None
    tolerance: float = 1e-9


def broken(tables: dict[str, DataFrame], identities: list[Identity]) -> DataFrame:
    """One row per identity and key that doesn't hold: ``identity, key, left_value, right_value``.

    A key that only one of two tables has is broken, and so is one whose sum is unknown. Sums are combined before the shuffle.
    """
    def side(table: str, rule: Identity, left: Column, right: Column) -> DataFrame:
        key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in rule.key])
        return tables[table].select(F.lit(rule.name).alias("identity"), key.alias("key"), F.lit(rule.tolerance).alias("_t"),
                                    left.cast("double").alias("_l"), right.cast("double").alias("_r"), F.lit(rule.right_table is None).alias("_fixed"))

    none, long = F.lit(None), None
    for rule in identities:
        parts = [side(rule.left_table, rule, F.expr(rule.left), F.expr(rule.right) if rule.right_table is None else none)]
        if rule.right_table is not None:
            parts.append(side(rule.right_table, rule, none, F.expr(rule.right)))
        for part in parts:
            long = part if long is None else long.unionByName(part)
    got = long.groupBy("identity", "key", "_t", "_fixed").agg(
        F.sum("_l").alias("left_value"), F.when(F.col("_fixed"), F.max("_r")).otherwise(F.sum("_r")).alias("right_value"))
    holds = F.abs(F.col("left_value") - F.col("right_value")) <= F.col("_t")
    return got.filter(~F.coalesce(holds, F.lit(False))).select("identity", "key", "left_value", "right_value")
