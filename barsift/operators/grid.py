"""Observation grids and strides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import MIN_HISTORY, STRIDE
from ..functions.windows import seq
from ..sources.panel import session_index
from .ranking import cumulative


def scan_grid(panel: DataFrame, stride: int = STRIDE, min_history: int = MIN_HISTORY) -> DataFrame:
    """Bars at index ``min_history`` or later whose index is a multiple of ``stride``."""
    return panel.withColumn("seq", seq()).filter(
        (F.col("seq") >= min_history) & (F.col("seq") % stride == 0))


def scan_targets(panel: DataFrame, stride: int = STRIDE, min_history: int = MIN_HISTORY,
                 start: str | None = None, end: str | None = None) -> DataFrame:
    """Grid keys; the date range is applied before the bar index is counted."""
    if start is not None:
        panel = panel.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        panel = panel.filter(F.col("date") <= F.lit(end).cast("date"))
    return scan_grid(panel.select("code", "date"), stride, min_history).select("code", "date")


def with_row_no(panel: DataFrame) -> DataFrame:
    """``row_no``: the position of each row in the panel ordered by code and date.

    The global row number is a per-code offset plus the bar index, so only code counts are
    summed up across the data.
    """
    counts = panel.groupBy("code").agg(F.count(F.lit(1)).alias("bars"))
    offsets = cumulative(counts, [], ["code"], {"bars": F.sum("bars")}).select(
        "code", F.col("before_bars").alias("_offset"))
    numbered = panel.withColumn("seq", seq()).join(offsets, "code")
    return numbered.withColumn("row_no", F.col("_offset") + F.col("seq")).drop("_offset", "seq")


def row_stride(panel: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th row of the panel ordered by code and date."""
    return with_row_no(panel).filter(F.col("row_no") % stride == 0)


def session_stride(panel: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th distinct session, with all of its codes."""
    kept = session_index(panel).filter(F.col("session_id") % stride == 0).select("date")
    return panel.join(kept, "date", "left_semi")
