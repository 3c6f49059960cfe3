"""Resampling over market dates, cluster-robust contrasts, and null variants.

Draws are a hash of (seed, replicate, slot), so any engine and any retry draws the same dates.
Per-date totals are one row per session; the draws multiply replicates, not signals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_draw
from ..sources.panel import session_index
from .ranking import row_numbers
from .scoring import ratio



def date_totals(rows: DataFrame, calendar: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Session-indexed totals over the whole calendar; dates without rows are zero."""
    got = rows.groupBy("date").agg(*[s.cast("double").alias(n) for n, s in sums.items()])
    return session_index(calendar).join(got, "date", "left").na.fill(0.0, list(sums))


def replicates(totals: DataFrame, names: list[str], n_boot: int, seed: int = 0, block: int = 1) -> DataFrame:
    """Totals of each bootstrap replicate: dates (or cyclic runs of ``block`` dates) drawn anew."""
    spark = totals.sparkSession
    size = totals.agg(F.count(F.lit(1)).alias("_n"))
    slots = spark.range(n_boot).withColumnRenamed("id", "rep").join(F.broadcast(size))
    drawn = slots.select("rep", "_n", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.ceil(F.col("_n") / block).cast("bigint") - 1)).alias("slot"))
    start = hash_draw(F.lit(seed), F.col("rep"), F.col("slot")) % F.col("_n")
    at = drawn.select("rep", "_n", start.alias("_s"))
    if block > 1:
        at = at.select("rep", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("_o"), "_n", "_s").withColumn(
            "_s", (F.col("_s") + F.col("_o")) % F.col("_n"))
    return at.select("rep", F.col("_s").alias("session_id")).join(totals, "session_id").groupBy("rep").agg(
        *[F.sum(n).alias(n) for n in names])


def date_bootstrap(rows: DataFrame, calendar: DataFrame, hit: str = "hit", n_boot: int = 4000, seed: int = 0,
                   level: float = 0.95, block: int = 1) -> DataFrame:
    """Precision with an interval that treats a market date, not a signal, as the unit."""
    totals = date_totals(rows, calendar, {"h": F.sum(hit), "c": F.count(F.lit(1))})
    reps = replicates(totals, ["h", "c"], n_boot, seed, block).withColumn("p", ratio("h", "c"))
    a = (1.0 - level) / 2.0
    # One row per replicate.
    boot = reps.agg(
        F.percentile("p", a).alias("ci_low"), F.percentile("p", 1 - a).alias("ci_high"),
        F.avg("p").alias("boot_mean"), F.stddev_pop("p").alias("boot_sd"))
    point = totals.agg(
        F.sum("c").cast("bigint").alias("n_signals"), F.count(F.lit(1)).alias("n_dates"), F.sum("h").alias("_h"))
    return point.withColumn("precision", ratio("_h", "n_signals")).drop("_h").join(F.broadcast(boot)).withColumns({
        "block": F.lit(block), "n_boot": F.lit(n_boot), "level": F.lit(level)})


def paired_bootstrap(rows: DataFrame, calendar: DataFrame, in_a: str, in_b: str, label: str = "y",
                     n_boot: int = 4000, seed: int = 0, block: int = 1, level: float = 0.95) -> DataFrame:
    """Difference of two selections' precision under the same draws of dates."""
    a, b, y = F.col(in_a).cast("int"), F.col(in_b).cast("int"), F.col(label)
    names = ["ha", "ca", "hb", "cb"]
    totals = date_totals(rows, calendar, {
        "ha": F.sum(a * y), "ca": F.sum(a), "hb": F.sum(b * y), "cb": F.sum(b)})
    reps = replicates(totals, names, n_boot, seed, block).withColumn(
        "d", ratio("ha", "ca") - ratio("hb", "cb")).filter("d is not null")
    q = (1.0 - level) / 2.0
    boot = reps.agg(
        F.percentile("d", q).alias("ci_low"), F.percentile("d", 1 - q).alias("ci_high"), F.avg("d").alias("boot_mean"),
        F.stddev_pop("d").alias("boot_sd"), F.avg((F.col("d") > 0).cast("int")).alias("share_draws_a_better"))
    point = totals.agg(*[F.sum(n).alias(n) for n in names], F.count(F.lit(1)).alias("n_dates"))
    out = point.join(F.broadcast(boot)).withColumns({
        "n_signals_a": F.col("ca").cast("bigint"), "n_signals_b": F.col("cb").cast("bigint"),
        "precision_a": ratio("ha", "ca"), "precision_b": ratio("hb", "cb")})
    return out.withColumns({
        "delta": F.col("precision_a") - F.col("precision_b"),
        "excludes_zero": (F.col("ci_low") > 0) | (F.col("ci_high") < 0)}).drop(*names)


def contrast(rows: DataFrame, calendar: DataFrame, arm: str, label: str = "y", n_boot: int = 1000, seed: int = 0,
             block: int = 1) -> DataFrame:
    """Rate difference of two arms with row, date-cluster and bootstrap standard errors."""
    a = F.col(arm).cast("int")
    y = F.col(label)
    names = ["ha", "ca", "hb", "cb"]
    totals = date_totals(rows, calendar, {
        "ha": F.sum(a * y), "ca": F.sum(a), "hb": F.sum((1 - a) * y), "cb": F.sum(1 - a)})
    point = totals.agg(*[F.sum(n).alias(f"t{n}") for n in names])
    d = totals.join(F.broadcast(point))
    pa, pb = F.col("tha") / F.col("tca"), F.col("thb") / F.col("tcb")
    psi = (F.col("ha") - pa * F.col("ca")) / F.col("tca") - (F.col("hb") - pb * F.col("cb")) / F.col("tcb")
    cluster = d.agg(F.sqrt(F.sum(psi * psi)).alias("se_cluster"), F.max(pa).alias("rate_a"), F.max(pb).alias("rate_b"),
                    F.max("tca").alias("n_a"), F.max("tcb").alias("n_b"))
    boot = replicates(totals, names, n_boot, seed, block).withColumn("d", ratio("ha", "ca") - ratio("hb", "cb")).agg(
        F.stddev_samp("d").alias("se_boot"),
        (2 * F.least(F.avg((F.col("d") <= 0).cast("int")), F.avg((F.col("d") >= 0).cast("int")))).alias("p_boot"))
    out = cluster.join(F.broadcast(boot)).withColumns({
        "delta": F.col("rate_a") - F.col("rate_b"),
        "se_row": F.sqrt(F.col("rate_a") * (1 - F.col("rate_a")) / F.col("n_a")
                         + F.col("rate_b") * (1 - F.col("rate_b")) / F.col("n_b"))})
    return out.withColumns({"z_row": ratio("delta", "se_row"), "z_cluster": ratio("delta", "se_cluster")})


def clustered_z(rows: DataFrame, null_rate: float, label: str = "y") -> DataFrame:
    """Distance of a rate from a null value in row, date-cluster and date-equal-weight units."""
    per = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("double").alias("h"))
    p0 = F.lit(null_rate)
    res = F.col("h") - p0 * F.col("n")
    got = per.agg(
        F.sum("n").alias("n"), F.sum("h").alias("hits"), F.count(F.lit(1)).alias("dates"),
        F.sum(res).alias("_r"), F.sum(res * res).alias("_rr"),
        F.avg(F.col("h") / F.col("n")).alias("_m"), F.stddev_samp(F.col("h") / F.col("n")).alias("_s"))
    return got.select(
        "n", "hits", "dates", ratio("hits", "n").alias("rate"),
        ratio(F.col("hits") - p0 * F.col("n"), F.sqrt(F.col("n") * p0 * (1 - p0))).alias("z_row"),
        ratio("_r", F.sqrt("_rr")).alias("z_cluster"),
        ratio(F.col("_m") - p0, F.col("_s") / F.sqrt("dates")).alias("z_date_equal"))


def subset_z(rows: DataFrame, member: str, label: str = "y") -> DataFrame:
    """Rate of a subset against its complement, by the pooled two-sample proportion test."""
    m = F.col(member).cast("int")
    got = rows.agg(F.sum(m).alias("n1"), F.sum(m * F.col(label)).alias("h1"),
                   F.sum(1 - m).alias("n0"), F.sum((1 - m) * F.col(label)).alias("h0"))
    p = (F.col("h1") + F.col("h0")) / (F.col("n1") + F.col("n0"))
    return got.withColumns({
        "rate_in": ratio("h1", "n1"), "rate_out": ratio("h0", "n0"),
        "z": (ratio("h1", "n1") - ratio("h0", "n0")) / F.sqrt(p * (1 - p) * (1 / F.col("n1") + 1 / F.col("n0")))})


def hypergeometric(total: DataFrame, draws: list[int]) -> DataFrame:
    """Mean and deviation of the hit rate of ``k`` rows drawn blindly from ``n`` with ``pos`` hits,
    and what the best of many such draws would show by chance."""
    k = F.explode(F.array(*[F.lit(d) for d in draws])).alias("k")
    at = total.select("n", "pos", k).filter(F.col("k") <= F.col("n"))
    p = F.col("pos") / F.col("n")
    sd = F.sqrt(p * (1 - p) / F.col("k") * (F.col("n") - F.col("k")) / F.greatest(F.col("n") - 1, F.lit(1)))
    out = at.withColumns({"mean": p, "sd": sd})
    return out.withColumns({
        f"best_of_{m}": F.col("mean") + F.col("sd") * F.sqrt(2 * F.ln(F.lit(float(m)))) for m in (10, 100, 1000)})


def permuted_labels(rows: DataFrame, label: str = "y", seed: int = 0, within_date: bool = True, out: str = "y_null",
                    **kw) -> DataFrame:
    """Labels handed out in hash order: the rows keep their order, the labels are shuffled.

    Two numberings of the same group are matched, so a group of any size stays distributed.
    """
    group = ["date"] if within_date else []
    h = F.xxhash64(F.lit(seed), "code", "date")
    keyed = rows.withColumn("_h", h)
    here = row_numbers(keyed, group, ["date", "code"] if not group else ["code"], "_i", **kw)
    there = row_numbers(keyed.select("code", "date", label, "_h"), group, ["_h", "code", "date"] if not group else ["_h", "code"],
                        "_i", **kw)
    given = there.select(*group, "_i", F.col(label).alias(out))
    return here.join(given, [*group, "_i"]).drop("_h", "_i", "group_rows")


def bernoulli_labels(rows: DataFrame, rate: float, seed: int = 0, out: str = "y_null") -> DataFrame:
    """Labels drawn independently at a rate, from the row's own key."""
    u = hash_draw(F.lit(seed), F.col("code"), F.col("date")) / F.lit(2.0 ** 32)
    return rows.withColumn(out, (u < rate).cast("int"))


def noise_feature(rows: DataFrame, seed: int = 0, out: str = "noise") -> DataFrame:
    """Uniform feature that knows nothing, repeatable by key."""
    return rows.withColumn(out, hash_draw(F.lit(f"n{seed}"), F.col("code"), F.col("date")) / F.lit(2.0 ** 32))


def planted_feature(rows: DataFrame, label: str = "y", strength: float = 1.0, seed: int = 0, out: str = "planted") -> DataFrame:
    """Noise plus the label: a control that every audit must find."""
    return noise_feature(rows, seed, "_u").withColumn(out, F.col("_u") + strength * F.col(label)).drop("_u")


def selection_budget(rows: DataFrame, configs: list[int], n_draws: int = 2000, seed: int = 7, label: str = "y") -> DataFrame:
    """Best of many chance results: mean and upper quantile of the maximum of K normal draws,
    scaled by the sampling error of the table's own rate."""
    spark = rows.sparkSession
    base = rows.agg(F.avg(label).alias("_p"), F.count(F.lit(1)).alias("_n"))
    grid = spark.range(n_draws).select(F.col("id").alias("draw"), F.explode(F.array(*[F.lit(k) for k in configs])).alias("configs"))
    normals = grid.select("draw", "configs", F.explode(F.sequence(F.lit(1), F.col("configs"))).alias("i"))

    def uniform(tag):
        return (hash_draw(F.lit(f"{seed}{tag}"), F.col("draw"), F.col("configs"), F.col("i")) + 0.5) / F.lit(2.0 ** 32)

    z = F.sqrt(-2 * F.ln(uniform("a"))) * F.cos(2 * F.pi() * uniform("b"))
    best = normals.groupBy("configs", "draw").agg(F.max(z).alias("z"))
    got = best.groupBy("configs").agg(F.avg("z").alias("mean_best_z"), F.percentile("z", 0.95).alias("p95_best_z"))
    se = F.sqrt(F.col("_p") * (1 - F.col("_p")) / F.col("_n"))
    return got.join(F.broadcast(base)).select(
        "configs", "mean_best_z", "p95_best_z", F.col("_p").alias("rate"),
        (F.col("_p") + F.col("mean_best_z") * se).alias("best_rate_by_chance"))


def arm_z(rows: DataFrame, arm: str, label: str = "y") -> DataFrame:
    """Two arms compared with rows, market dates, and equally weighted shared dates as the unit."""
    m = F.col(arm).cast("int")
    per = rows.groupBy("date").agg(
        F.sum(m).cast("double").alias("na"), F.sum(m * F.col(label)).cast("double").alias("ha"),
        F.sum(1 - m).cast("double").alias("nb"), F.sum((1 - m) * F.col(label)).cast("double").alias("hb"))
    tot = per.agg(*[F.sum(c).alias(f"t{c}") for c in ("na", "ha", "nb", "hb")])
    d = per.join(F.broadcast(tot)).withColumns({"pa": F.col("tha") / F.col("tna"), "pb": F.col("thb") / F.col("tnb")})
    both = (F.col("na") > 0) & (F.col("nb") > 0)
    ra, rb = F.when(both, F.col("ha") / F.col("na")), F.when(both, F.col("hb") / F.col("nb"))
    ea, eb = F.col("ha") - F.col("pa") * F.col("na"), F.col("hb") - F.col("pb") * F.col("nb")
    got = d.agg(
        F.max("tna").alias("n_a"), F.max("tnb").alias("n_b"), F.max("pa").alias("rate_a"), F.max("pb").alias("rate_b"),
        F.max((F.col("tha") + F.col("thb")) / (F.col("tna") + F.col("tnb"))).alias("_p"),
        F.sqrt(F.max(1 / F.col("tna") + 1 / F.col("tnb"))).alias("_k"),
        F.sqrt(F.sum(ea * ea) / F.max(F.col("tna") * F.col("tna")) + F.sum(eb * eb) / F.max(F.col("tnb") * F.col("tnb"))).alias("_sc"),
        F.avg(ra).alias("_ma"), F.avg(rb).alias("_mb"),
        F.sqrt(F.var_samp(ra) / F.count(ra) + F.var_samp(rb) / F.count(rb)).alias("_sd"), F.count(ra).alias("shared_dates"))
    delta = F.col("rate_a") - F.col("rate_b")
    return got.select(
        "n_a", "n_b", "rate_a", "rate_b", "shared_dates",
        ratio(delta, F.sqrt(F.col("_p") * (1 - F.col("_p"))) * F.col("_k")).alias("z_row"), ratio(delta, F.col("_sc")).alias("z_cluster"),
        ratio(F.col("_ma") - F.col("_mb"), F.col("_sd")).alias("z_date_equal"))
