"""Long-horizon event labels on a market calendar, candidates, and the split arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import observed_calendar, session_index


# Part of every candidate id.
CANDIDATE_VERSION = "lowzone-tier-v1"


def candidates(layers: DataFrame, min_tier: int = 1, version: str = CANDIDATE_VERSION) -> DataFrame:
    """Layer rows of at least a tier, with an id hashed from code, date and version."""
    if min_tier < 1:
        raise ValueError("min_tier must be at least 1")
    rows = layers.filter(F.col("recall_tier") >= min_tier).select("code", "date", "recall_tier")
    raw = F.concat_ws("|", "code", F.date_format("date", "yyyy-MM-dd"), F.lit(version))
    return rows.select(
        F.substring(F.sha2(raw, 256), 1, 24).alias("candidate_id"), "code", "date",
        F.col("date").alias("candidate_known_at"), F.lit("close").alias("decision_time"),
        F.lit(version).alias("candidate_version"), F.lit(f"recall_tier>={min_tier}").alias("candidate_reason"),
        "recall_tier")


def repeated_candidates(manifest: DataFrame) -> DataFrame:
    """Candidate ids that occur more than once."""
    return manifest.groupBy("candidate_id").count().filter("count > 1")


def prefix_differences(on_prefix: DataFrame, on_full: DataFrame, cutoff: str) -> DataFrame:
    """Rows that a result on data up to the cutoff has and the full result lacks, or the reverse."""
    full = on_full.filter(F.col("date") <= F.lit(cutoff).cast("date"))
    gone = on_prefix.exceptAll(full).withColumn("side", F.lit("prefix_only"))
    new = full.exceptAll(on_prefix).withColumn("side", F.lit("full_only"))
    return gone.unionByName(new)


def label_events(panel: DataFrame, picks: DataFrame, calendar: DataFrame | None = None, horizon: int = 504,
                 target_multiple: float = 4.0, floor_multiple: float = 0.8) -> DataFrame:
    """First event of each candidate within ``horizon`` market sessions after its signal.

    Per session a missing price comes before the floor break and that before the target. Rows
    of the panel meet a candidate through session buckets of the horizon's size, so a candidate
    sees at most twice its horizon of bars; absent bars are found by counting, not by filling in.
    """
    if "candidate_id" not in picks.columns:
        picks = picks.withColumn("candidate_id", F.concat_ws("|", "code", F.date_format("date", "yyyy-MM-dd")))
    days = session_index(panel if calendar is None else observed_calendar(panel, calendar))
    twice = repeated_candidates(picks).agg(F.count(F.lit(1)).alias("_twice"))
    picks = picks.join(F.broadcast(twice)).filter(
        F.when(F.col("_twice") > 0, F.raise_error(F.lit("repeated candidate ids")).cast("boolean")).otherwise(True))
    size = days.agg(F.count(F.lit(1)).alias("_size"))
    where = days.withColumnRenamed("session_id", "_sid")
    c = picks.select("candidate_id", "code", F.col("date").alias("signal_date")).join(
        where.select(F.col("date").alias("signal_date"), "_sid"), "signal_date", "left").join(F.broadcast(size))
    off = F.raise_error(F.concat(F.lit("bar off the calendar: "), F.col("date").cast("string"))).cast("bigint")
    bars = panel.join(where, "date", "left").select("code", F.coalesce(F.col("_sid").cast("bigint"), off).alias("_sid"), "open", "low", "close")
    # Entry bar of the next session.
    entry = bars.select("code", (F.col("_sid") - 1).alias("_sid"), F.col("open").alias("_open"))
    c = c.join(entry, ["code", "_sid"], "left")
    c = c.withColumns({
        "_e": F.when(F.col("_open") > 0, F.col("_open")), "_mature": F.col("_sid") + horizon < F.col("_size"),
        "_stop": F.least(F.col("_sid") + horizon, F.col("_size") - 1)})
    seek = c.filter(F.col("_e").isNotNull()).select("candidate_id", "code", "_sid", "_stop", "_e")
    probe = seek.withColumn("_bucket", F.explode(F.array_distinct(F.array(
        F.floor((F.col("_sid") + 1) / horizon), F.floor(F.col("_stop") / horizon)))))
    path = bars.withColumn("_bucket", F.floor(F.col("_sid") / horizon)).select(
        "code", "_bucket", F.col("_sid").alias("_at"), "low", "close")
    met = probe.join(path, ["code", "_bucket"]).filter(
        (F.col("_at") > F.col("_sid")) & (F.col("_at") <= F.col("_stop")))
    bad = ~F.coalesce((F.col("low") > 0) & (F.col("close") > 0), F.lit(False))
    kind = F.when(bad, F.lit(0)).when(F.col("low") < F.col("_e") * floor_multiple, F.lit(1)).when(
        F.col("close") > F.col("_e") * target_multiple, F.lit(2))
    event = met.filter(kind.isNotNull()).groupBy("candidate_id").agg(F.min(F.struct(
        F.col("_at").alias("at"), kind.alias("kind"))).alias("_event"))
    # Present sessions form a gap-free run while session minus position stays constant.
    run = Window.partitionBy("candidate_id").orderBy("_at")
    gap = met.withColumn("_expect", F.col("_sid") + F.row_number().over(run)).filter(
        F.col("_at") != F.col("_expect")).groupBy("candidate_id").agg(F.min("_expect").alias("_gap"))
    seen = met.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("_present"))
    c = c.join(event, "candidate_id", "left").join(gap, "candidate_id", "left").join(seen, "candidate_id", "left")
    # Without an inner gap, the first absent session is the one after the last present bar.
    tail = F.col("_sid") + F.coalesce("_present", F.lit(0)) + 1
    absent = F.coalesce(F.col("_gap"), F.when(tail <= F.col("_stop"), tail))
    at = F.col("_event.at")
    first_absent = F.when(at.isNull() | (absent < at), absent)
    pending = F.col("_sid") + 1 >= F.col("_size")
    outcome = (
        F.when(F.col("_sid").isNull(), "invalid_candidate").when(pending, "pending_entry_calendar")
        .when(F.col("_e").isNull(), "no_entry").when(first_absent.isNotNull(), "unknown_missing_bar")
        .when(F.col("_event.kind") == 0, "unknown_missing_price").when(F.col("_event.kind") == 1, "risk")
        .when(F.col("_event.kind") == 2, "success").when(F.col("_mature"), "timeout").otherwise("pending_maturity"))
    c = c.withColumns({"outcome_class": outcome, "_absent": first_absent})
    k = F.col("outcome_class")
    decided = k.isin("risk", "success", "timeout")
    missing = k.startswith("unknown")
    stop = F.when(k == "no_entry", F.col("_sid") + 1).when(k == "unknown_missing_bar", F.col("_absent")).when(
        k.isin("unknown_missing_price", "risk", "success"), at).when(k == "timeout", F.col("_sid") + horizon)
    c = c.withColumns({
        "_end": stop, "_first": F.when(~pending, F.col("_sid") + 1),
        "_due": F.when(F.col("_mature"), F.col("_sid") + horizon),
        "bars_scanned": F.when(missing, stop - F.col("_sid") - 1).when(k.isin("risk", "success"), stop - F.col("_sid"))
        .when(k == "timeout", F.lit(horizon)).when(k == "pending_maturity", F.col("_stop") - F.col("_sid")).otherwise(F.lit(0)),
        "label_joint": F.when(k == "success", 1).when(decided, 0),
        "label_resolved": F.coalesce(decided, F.lit(False)),
        "training_eligible": F.coalesce(decided & F.col("_mature"), F.lit(False)),
        "entry_open": F.col("_e"), "target_price": F.col("_e") * target_multiple,
        "risk_floor": F.col("_e") * floor_multiple})
    # Session ids back to dates: the calendar has one row per session.
    for out, sid in (("entry_session", "_first"), ("deadline", "_due"), ("label_end", "_end")):
        c = c.join(where.select(F.col("_sid").alias(sid), F.col("date").alias(out)), sid, "left")
    return c.withColumns({
        "terminal_session": F.when(F.col("label_resolved"), F.col("label_end")),
        "label_known_at": F.col("label_end"), "training_eligible_at": F.col("deadline"),
        "first_missing_session": F.when(missing, F.col("label_end"))}).select(
        "candidate_id", "code", "signal_date", "entry_session", "deadline", "label_end", "entry_open", "target_price",
        "risk_floor", "terminal_session", "label_known_at", "training_eligible_at", "training_eligible", "outcome_class",
        "label_joint", "label_resolved", "bars_scanned", "first_missing_session")


def minimum_sessions(horizon: int) -> int:
    """Shortest dense calendar with one fully matured split."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    return 2 * horizon + 2


def mature_splits(calendar: DataFrame, picks: DataFrame, horizon: int = 504, min_train: int = 1, min_dev: int = 1,
                  dev_block: int = 63, panel: DataFrame | None = None) -> DataFrame:
    """Every development start with enough matured training and development candidates.

    One row per session: counts of candidates per session and their running sums. With a ``panel`` the
    calendar ends with its last bar.
    """
    days = session_index(calendar if panel is None else observed_calendar(panel, calendar))
    counts = picks.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(F.lit(0))
    past = every.orderBy("session_id")
    d = days.join(counts, "date", "left").withColumns({
        "_last": F.max("session_id").over(every)})
    d = d.withColumn("_m", F.when(F.col("session_id") <= F.col("_last") - horizon, F.coalesce("_n", F.lit(0))).otherwise(0))
    d = d.withColumns({
        "n_train": F.coalesce(F.sum("_m").over(past.rowsBetween(Window.unboundedPreceding, -horizon - 1)), F.lit(0)),
        "n_dev": F.sum("_m").over(past.rowsBetween(0, dev_block - 1)),
        "dev_end": F.last("date").over(past.rowsBetween(0, dev_block - 1))})
    return d.filter((F.col("session_id") >= 1) & (F.col("n_train") >= min_train) & (F.col("n_dev") >= min_dev)).select(
        F.col("date").alias("dev_start"), "dev_end", "n_train", "n_dev", F.lit(horizon).alias("horizon"))


def split_support(calendar: DataFrame, splits: DataFrame, horizon: int) -> DataFrame:
    """Calendar length, the least it would need, and how many legal splits it has."""
    a = calendar.agg(F.countDistinct("date").alias("calendar_sessions"))
    b = splits.agg(F.count(F.lit(1)).alias("n_legal_splits"), F.min("dev_start").alias("first_dev_start"))
    return a.join(F.broadcast(b)).withColumns({
        "horizon": F.lit(horizon), "minimum_sessions": F.lit(minimum_sessions(horizon))})
