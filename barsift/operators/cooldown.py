"""Collapsing overlapping signals to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import COOLDOWN


def _walk(signals: DataFrame, group: list[str], cooldown: int) -> DataFrame:
    """Greedy pass over the positions of each group: keep one, skip until ``cooldown`` later.

    What is kept depends on what was kept before, so a group is folded in order. A group is one
    code (and strategy), so its size is bounded by the number of sessions; the whole row rides
    along, which saves joining the kept positions back.
    """
    rest = [c for c in signals.columns if c not in group and c != "_pos"]
    packed = signals.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("_pos", *rest))).alias("_rows"))
    start = F.slice("_rows", 1, 1)

    def step(kept, row):
        return F.when(row["_pos"] - F.element_at(kept, -1)["_pos"] >= cooldown,
                      F.concat(kept, F.array(row))).otherwise(kept)

    kept = packed.select(*group, F.explode(F.aggregate("_rows", start, step)).alias("_r"))
    return kept.select(*group, *[F.col(f"_r.{c}").alias(c) for c in rest])


def dedupe(signals: DataFrame, cooldown: int = COOLDOWN, by: list[str] | None = None) -> DataFrame:
    """First signal of each cluster per code, counted in sessions that occur in the signals.

    ``by`` names further keys (such as the strategy); each has its own session clock.
    """
    keys = list(by or [])
    clock = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")
    # Distinct dates per strategy: bounded by the calendar, whatever the number of signals.
    sessions = signals.select(*keys, "date").distinct().withColumn("_pos", F.row_number().over(clock))
    return _walk(signals.join(sessions, [*keys, "date"]), [*keys, "code"], cooldown)


def off_calendar(signals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Signals on a date the calendar does not know."""
    return signals.join(calendar.select("date").distinct(), "date", "left_anti")


def dedupe_on_calendar(signals: DataFrame, calendar: DataFrame, cooldown: int = COOLDOWN,
                       by: list[str] | None = None) -> DataFrame:
    """As :func:`dedupe` on an independent calendar. A date outside it fails the job."""
    sessions = calendar.select("date").distinct().withColumn(
        "_pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))
    placed = signals.join(sessions, "date", "left").withColumn(
        "_pos", F.when(F.col("_pos").isNull(), F.raise_error(F.concat(
            F.lit("signal date absent from the calendar: "), F.col("date").cast("string"))).cast("int")
        ).otherwise(F.col("_pos")))
    return _walk(placed, [*(by or []), "code"], cooldown)


def first_per_year(signals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whole first row of each code and year."""
    keys = [*(by or []), "code", "_year"]
    df = signals.withColumn("_year", F.year("date"))
    rest = [c for c in signals.columns if c not in (*keys, "date")]
    best = df.groupBy(*keys).agg(F.min(F.struct("date", *rest)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in signals.columns])
