"""Input tables and the bar panels Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import six_digit_code


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bars(spark: SparkSession, folder: str, every: str = "week") -> DataFrame:
    """Weekly (or daily) bars per supplier; one row per code and date.

    Grouping keys stay numeric and the partial aggregate comes before the shuffle, so a
    supplier holding much of the table shrinks to one row per session first.
    """
    time = F.col("l_shipdate")
    day = F.date_trunc("week", time).cast("date") if every == "week" else time.cast("date")
    trades = table(spark, folder, "lineitem").select(
        "l_suppkey",
        day.alias("date"),
        (F.floor((20 + F.col("l_extendedprice") / 10000.0) * 100) / 100).alias("px"),
        F.col("l_quantity").alias("qty"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("k"))
    grouped = trades.groupBy("l_suppkey", "date").agg(
        F.min_by("px", "k").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "k").alias("close"),
        F.sum("qty").alias("volume"))
    return grouped.select(
        six_digit_code("l_suppkey").alias("code"), "date", "open", "high", "low", "close", "volume")
