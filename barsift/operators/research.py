"""Research features: volume pressure, low-zone occupancy, volume impact, next-session targets, ECDF families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import guarded, ln_guarded
from ..functions.fixed import EPS
from ..functions.windows import back, by_code, roll, span
from ..sources.panel import session_index
from .context import true_range
from .crosssec import melt
from .ranking import cumulative, quantiles



def with_volume_pressure(panel: DataFrame, windows: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Volume on falling, rising and flat bars over full windows, and their imbalance."""
    ret = F.col("close") / back("close", 1) - 1.0
    df = panel.withColumn("_ret", ret)
    sides = {"down": F.col("_ret") < 0, "up": F.col("_ret") > 0, "flat": F.col("_ret") == 0}
    df = df.withColumns({
        **{f"_v_{s}": F.when(F.coalesce(c, F.lit(False)), F.col("volume")).otherwise(0.0) for s, c in sides.items()},
        **{f"_n_{s}": F.coalesce(c, F.lit(False)).cast("double") for s, c in sides.items()}})
    for w in windows:
        df = df.withColumns({
            **{f"vp_{s}_vol_{w}": roll(f"_v_{s}", w, "sum", w) for s in sides},
            **{f"vp_n_{s}_{w}": roll(f"_n_{s}", w, "sum", w) for s in ("down", "up")}})
        down, up = F.col(f"vp_down_vol_{w}"), F.col(f"vp_up_vol_{w}")
        one_sided = ((F.col(f"vp_n_down_{w}") == 0) | (F.col(f"vp_n_up_{w}") == 0)) & (down + up).isNotNull()
        df = df.withColumns({
            f"vp_pressure_{w}": F.when(down + up > 0, (down - up) / (down + up)),
            f"vp_one_sided_{w}": F.coalesce(one_sided, F.lit(False)).cast("double")})
    return df.drop("_ret", *[f"_{k}_{s}" for k in "vn" for s in sides])


def with_kdj_path(df: DataFrame, windows: tuple[int, ...] = (21, 63)) -> DataFrame:
    """Share of recent bars in the low zone, and the current run of them."""
    low = F.coalesce((F.col("kdj_k") < 20) & (F.col("kdj_d") < 20), F.lit(False)).cast("int")
    df = df.withColumn("_low", low)
    running = by_code().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({
        **{f"kdj_low_occ_{w}": roll("_low", w, least=w) for w in windows},
        # Each bar outside the zone opens a new island.
        "_island": F.sum(1 - F.col("_low")).over(running)})
    island = Window.partitionBy("code", "_island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("kdj_low_streak", F.sum("_low").over(island)).drop("_low", "_island")


def with_volume_impact(panel: DataFrame, block: int = 10, atr_window: int = 14, volume_window: int = 20,
                       min_up: int = 2, min_down: int = 2) -> DataFrame:
    """How far price moves per unit of volume, up against down, lately against before.

    Needs ``session_id``. Valid only over ``2 * block`` consecutive sessions with enough moves
    on both sides in both blocks; a control repeats it without volume.
    """
    if block <= 1:
        raise ValueError("block must exceed 1")
    df = panel.withColumns({"_tr": true_range(), "_pc": back("close", 1),
                            "_step": F.coalesce(F.col("session_id") - back("session_id", 1) == 1, F.lit(False)).cast("int")})
    df = df.withColumns({
        "_atr": roll("_tr", atr_window, least=atr_window, skip=1),
        "_base": roll("volume", volume_window, least=volume_window, skip=1)})
    z = guarded(ln_guarded(guarded(F.col("close"), F.col("_pc"))), guarded(F.col("_atr"), F.col("_pc")))
    df = df.withColumns({"_z": z, "_rv": guarded(F.col("volume"), F.col("_base"))})
    zc = F.col("_z")
    up_, dn_ = F.coalesce(zc > 0, F.lit(False)), F.coalesce(zc < 0, F.lit(False))
    parts = {
        "un": F.when(zc.isNotNull(), F.greatest(zc, F.lit(0.0))), "dn": F.when(zc.isNotNull(), F.greatest(-zc, F.lit(0.0))),
        "uq": F.when(up_, F.col("_rv")).otherwise(0.0), "dq": F.when(dn_, F.col("_rv")).otherwise(0.0),
        "uc": up_.cast("double"), "dc": dn_.cast("double")}
    df = df.withColumns({f"_{n}": c for n, c in parts.items()})
    df = df.withColumns({
        **{f"_r_{n}": roll(f"_{n}", block, "sum", block) for n in parts},
        **{f"_p_{n}": roll(f"_{n}", block, "sum", block, skip=block) for n in parts},
        "_steps": F.when(F.count("_step").over(span(-(2 * block - 2), 0)) == 2 * block - 1,
                         F.sum("_step").over(span(-(2 * block - 2), 0)))})

    def asym(t: str, den: str) -> Column:
        u = guarded(F.col(f"_{t}_un"), F.col(f"_{t}_u{den}"))
        d = guarded(F.col(f"_{t}_dn"), F.col(f"_{t}_d{den}"))
        return F.ln((u + EPS) / (d + EPS))

    run = F.coalesce(F.col("_steps") == 2 * block - 1, F.lit(False))
    balanced = F.coalesce((F.col("_r_uc") >= min_up) & (F.col("_r_dc") >= min_down)
                          & (F.col("_p_uc") >= min_up) & (F.col("_p_dc") >= min_down), F.lit(False))
    ok = run & balanced
    df = df.withColumns({
        "vir": F.when(ok, asym("r", "q") - asym("p", "q")),
        "vir_novol": F.when(ok, asym("r", "c") - asym("p", "c")),
        "vir_asym_recent": F.when(ok, asym("r", "q")), "vir_asym_prior": F.when(ok, asym("p", "q")),
        "vir_up_impact_recent": F.when(run, guarded(F.col("_r_un"), F.col("_r_uq"))),
        "vir_down_impact_recent": F.when(run, guarded(F.col("_r_dn"), F.col("_r_dq"))),
        "vir_up_impact_prior": F.when(run, guarded(F.col("_p_un"), F.col("_p_uq"))),
        "vir_down_impact_prior": F.when(run, guarded(F.col("_p_dn"), F.col("_p_dq"))),
        "vir_recent_n_up": F.col("_r_uc"), "vir_recent_n_down": F.col("_r_dc"),
        "vir_prior_n_up": F.col("_p_uc"), "vir_prior_n_down": F.col("_p_dc"),
        "vir_coverage20": run.cast("double"), "vir_one_sided": (run & ~balanced).cast("double")})
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def auxiliary_targets(panel: DataFrame) -> DataFrame:
    """Next-session log return and five-session realised volatility, only over consecutive sessions."""
    df = panel.withColumns({
        **{f"_c{h}": back("close", -h) for h in range(1, 6)}, **{f"_s{h}": back("session_id", -h) for h in range(1, 6)}})
    near = F.col("_s1") - F.col("session_id") == 1
    rets = [ln_guarded(guarded(F.col("_c1"), F.col("close")))] + [
        ln_guarded(guarded(F.col(f"_c{h}"), F.col(f"_c{h - 1}"))) for h in range(2, 6)]
    run = F.lit(True)
    for h in range(1, 6):
        run = run & (F.col(f"_s{h}") == F.col("session_id") + h)
    square = rets[0] * rets[0]
    for r in rets[1:]:
        square = square + r * r
    return df.select("code", "date", "session_id", F.when(near, rets[0]).alias("aux_ret1"),
                     F.when(run, F.sqrt(square / 5)).alias("aux_rv5"))


def auxiliary_split(sessions: DataFrame, dev_fraction: float = 0.2, embargo: int = 5) -> DataFrame:
    """One row: last training session, first and last development session."""
    days = sessions.select("session_id").distinct()
    n = F.count(F.lit(1))
    dev = F.greatest(F.lit(20), F.bround(n * dev_fraction).cast("bigint"))
    at = days.agg(n.alias("n"), dev.alias("_dev"), F.sort_array(F.collect_list("session_id")).alias("_u"))
    # The array holds the calendar, one value per session.
    start = F.col("n") - F.col("_dev")
    return at.select(
        F.get("_u", (start - embargo - 1).cast("int")).alias("train_end"), F.get("_u", start.cast("int")).alias("dev_start"),
        F.get("_u", (F.col("n") - 1).cast("int")).alias("dev_end"))


def sequence_anchors(df: DataFrame, window: int, split: DataFrame) -> DataFrame:
    """Bars whose last ``window`` bars are consecutive sessions and whose targets are known, with their role."""
    step = F.coalesce(F.col("session_id") - back("session_id", 1) == 1, F.lit(False)).cast("int")
    rows = df.withColumn("_step", step).withColumn("_run", F.sum("_step").over(span(-(window - 2), 0)))
    ok = rows.filter((F.col("_run") == window - 1) & F.col("aux_ret1").isNotNull() & F.col("aux_rv5").isNotNull())
    placed = ok.join(F.broadcast(split))
    sid = F.col("session_id")
    role = F.when(sid <= F.col("train_end"), "train").when((sid >= F.col("dev_start")) & (sid <= F.col("dev_end")), "dev")
    return placed.withColumn("role", role).filter("role is not null").select("code", "date", "session_id", "role")


def robust_scale(df: DataFrame, columns: list[str], train: Column, **kw) -> DataFrame:
    """Median / interquartile scaling learned on the training rows, with a missing mask per column."""
    q = quantiles(melt(df.filter(train), ["code"], columns), ["feature"], "x", {"q1": 0.25, "med": 0.5, "q3": 0.75}, **kw)
    wide = q.groupBy().agg(*[f for c in columns for f in (
        F.max(F.when(F.col("feature") == c, F.col("med"))).alias(f"_m_{c}"),
        F.max(F.when(F.col("feature") == c, F.col("q3") - F.col("q1"))).alias(f"_s_{c}"))])
    out = df.join(F.broadcast(wide))
    for c in columns:
        scale = F.when(F.col(f"_s_{c}") >= 1e-6, F.col(f"_s_{c}")).otherwise(1.0)
        out = out.withColumns({
            f"{c}_scaled": F.coalesce((F.col(c) - F.coalesce(f"_m_{c}", F.lit(0.0))) / scale, F.lit(0.0)),
            f"{c}_known": F.col(c).isNotNull().cast("double")})
    return out.drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


def family_ecdf(train: DataFrame, rows: DataFrame, families: dict[str, str], **kw) -> DataFrame:
    """Each family's share of training values at or below the row's value, and their summary.

    The training distribution is frozen: rows and training values are merged in order and the
    running count of training values alone is read off at each row's value.
    """
    cols = list(families)
    named = {f: F.col(c) for f, c in families.items()}
    t = melt(train.select("code", *[c.alias(f) for f, c in named.items()]), ["code"], cols).filter("x is not null")
    r = melt(rows.select("code", "date", *[c.alias(f) for f, c in named.items()]), ["code", "date"], cols)
    merged = t.select("feature", "x", F.lit(1).alias("_t")).unionByName(
        r.filter("x is not null").select("feature", "x", F.lit(0).alias("_t")))
    dist = cumulative(merged, ["feature"], ["x"], {"train": F.sum("_t")}, **kw)
    share = dist.select("feature", "x", F.when(
        F.col("all_train") > 0, (F.col("before_train") + F.col("train")) / F.col("all_train")).alias("q"))
    placed = r.join(share, ["feature", "x"], "left")
    wide = placed.groupBy("code", "date").agg(*[
        F.max(F.when(F.col("feature") == f, F.col("q"))).alias(f"family_q__{f}") for f in cols])
    qs = F.array(*[F.col(f"family_q__{f}") for f in cols])
    have = F.array_sort(F.filter(qs, lambda q: q.isNotNull()))
    n = F.size("_q")
    support = F.transform("_q", lambda q: 1.0 / (1.0 + F.exp(-(q - 0.75) / 0.10)))
    mid = (F.get("_q", F.floor((n - 1) / 2).cast("int")) + F.get("_q", F.floor(n / 2).cast("int"))) / 2
    out = wide.withColumn("_q", have)
    return out.withColumns({
        "meb": F.when(n > 0, F.aggregate(support, F.lit(0.0), lambda a, v: a + v) / n),
        "family_coverage": n / len(cols),
        "family_support_count_75": F.size(F.filter("_q", lambda q: q >= 0.75)),
        "family_support_count_90": F.size(F.filter("_q", lambda q: q >= 0.90)),
        "family_dominance": F.when(n > 0, F.array_max("_q") - mid)}).drop("_q")


def with_sessions(panel: DataFrame) -> DataFrame:
    return panel.join(session_index(panel), "date")
