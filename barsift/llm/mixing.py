"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import unused, words_in

#: Draws are the first 13 hex digits of an md5, so 52 bits.
_DRAW_RANGE = float(1 << 52)


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / _DRAW_RANGE


def source_targets(sizes: DataFrame, weights=(1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Target size of every source.

    ``sizes`` has one row per source (source, source_size). Sources ordered by code point, null
    last, take the weights in turn; the targets share the whole size by weight. A target above
    ``max_repeat`` times its source stops there and the excess goes to the others by weight. With
    sources in the order in which they fill up, the level after the k-th is what is left over the
    weight that is left; the level at which filling stops is the largest of these. The windows run
    over one row per source, never over documents. No words at all: every target is 0.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.array(*[F.lit(int(x)) for x in weights])[place % len(weights)]
    ranked = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_repeat)
    ranked = ranked.withColumn("_fills", F.col("cap").cast("double") / F.col("weight"))
    order = Window.orderBy("_fills", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(
        F.sum("cap").over(before), F.lit(0))
    level = ranked.withColumn("_level", left.cast("double") / F.sum("weight").over(after))
    level = level.withColumn("_level", F.max("_level").over(whole.partitionBy(F.lit(1))))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("_level"))
    return level.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights=(1, 2, 3), max_repeat: int = 3, seed: str = "mix", doc_id: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """How often each document is taken so that sources come near their target weights.

    Adds ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken`` (size x copies) to
    every row; columns of ``docs`` with these names are replaced. A document is taken
    floor(rate) times, and once more with probability equal to the fraction, where rate is its
    source's target over its size. The draw hashes the id and the seed, so reruns and retries agree;
    repeated ids draw alike, and where the id is null the text is hashed. A null text has size 0,
    a null source is a source, a source without words has rate 0. An empty table stays empty.
    """
    size, key_of = words_in(F.col(text)), unused("_source", docs)
    rows = docs.drop("size", "source_size", "target", "copies", "taken").withColumn("size", size)
    sizes = rows.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    # One row per source, written: the size on disk then decides between broadcast and shuffle join.
    targets = staged(source_targets(staged(sizes), weights, max_repeat)).select(
        F.col("source").alias(key_of), "source_size", "target")
    rows = rows.join(targets, F.col(source).eqNullSafe(F.col(key_of)), "left").drop(key_of)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    key = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text).cast("binary")), F.lit(""))
    copies = (whole + (draw(key, seed) < rate - whole).cast("long")).cast("long")
    return rows.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """Each document as many times as it is taken, numbered from 1 in a new column ``copy`` (with underscores behind it where that is taken)."""
    return mixed.filter("copies > 0").withColumn(unused("copy", mixed), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
