"""Spark ML models under the walk-forward protocol.

Estimators are fitted on earlier sessions only, thresholds come from training scores only, and
every stage between fit and report stays a table.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import wilson
from ..functions.fixed import LOWZONE_VERSIONS, REGIMES
from ..session import staged
from .cooldown import dedupe, first_per_year
from .crosssec import auc, melt, threshold_for_rate
from .layers import LAYER_FEATURES
from .ranking import cumulative, quantiles
from .scoring import pool_folds, ratio


@dataclass(frozen=True)
class Config:
    """One model configuration: kind, label, publication rate, features and estimator settings."""

    name: str
    model: str = "gbt"
    label: str = "label_high"
    target_rate: float = 0.02
    features: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)
    seed: int = 0
    min_train: int = 5000
    min_test: int = 200


def estimator(cfg: Config):
    """Estimator of a configuration: gradient-boosted trees, random forest, or logistic regression."""
    io = {"featuresCol": "features", "labelCol": "_y"}
    if cfg.model in ("gbt", "hgb"):
        return GBTClassifier(**io, seed=cfg.seed, **{"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, **cfg.settings})
    if cfg.model == "rf":
        return RandomForestClassifier(**io, seed=cfg.seed, **{"numTrees": 30, "maxDepth": 6, **cfg.settings})
    if cfg.model == "logistic":
        return LogisticRegression(**io, **{"maxIter": 50, "regParam": 0.01, **cfg.settings})
    raise ValueError(f"unknown model: {cfg.model}")


def pipeline(cfg: Config) -> Pipeline:
    """Features without unknown values to a vector, scaling where the model needs it, then the estimator."""
    filled = [f"_f_{c}" for c in cfg.features]
    stages = [VectorAssembler(inputCols=filled, outputCol="_raw" if cfg.model == "logistic" else "features")]
    if cfg.model == "logistic":
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True))
    return Pipeline(stages=[*stages, estimator(cfg)])


# Rank error of the quantile sketch that brackets a median, as a share of the rows.
_BRACKET = 0.002


def _known(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def medians(df: DataFrame, columns: tuple[str, ...]) -> dict[str, float]:
    """Exact medians of the known values, the lower of two middle ones; each column must have a known value.

    A sketch of bounded size brackets each median, and only the values in the bracket, about one row in a hundred, are ranked.
    """
    rows = df.select(*[_known(c).alias(c) for c in columns])
    edges = dict(zip(columns, rows.approxQuantile(list(columns), [0.5 - 2 * _BRACKET, 0.5 + 2 * _BRACKET], _BRACKET), strict=True))
    sizes = rows.agg(*[x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.count_if(F.col(c) < edges[c][0]).alias(f"b_{c}"))]).first()

    def of_feature(value: dict[str, float]) -> Column:
        return F.coalesce(*[F.when(F.col("feature") == c, F.lit(v)) for c, v in value.items()])

    lows, highs = of_feature({c: e[0] for c, e in edges.items()}), of_feature({c: e[1] for c, e in edges.items()})
    near = melt(rows, [], list(columns)).filter(F.col("x").between(lows, highs))
    # How many values of the bracket come before the median.
    at = of_feature({c: (sizes[f"n_{c}"] + 1) // 2 - 1 - sizes[f"b_{c}"] for c in columns})
    dist = cumulative(near, ["feature"], ["x"])
    found = dist.filter((F.col("before_n") <= at) & (at < F.col("before_n") + F.col("n"))).select("feature", "x").collect()
    return {r["feature"]: r["x"] for r in found}


def fit_scores(train: DataFrame, rows: DataFrame, cfg: Config) -> DataFrame:
    """Rows with the ``score`` of a model fitted on the training rows.

    A feature without a single known training value carries nothing and is left out.
    """
    seen = train.agg(*[F.count(_known(c)).alias(c) for c in cfg.features]).first()
    cfg = replace(cfg, features=tuple(c for c in cfg.features if seen[c] > 0))
    middle = medians(train, cfg.features)

    def filled(df: DataFrame) -> DataFrame:
        return df.withColumns({f"_f_{c}": F.coalesce(_known(c), F.lit(middle[c])) for c in cfg.features})

    model = pipeline(cfg).fit(filled(train).select(*[f"_f_{c}" for c in cfg.features], F.col(cfg.label).cast("double").alias("_y")))
    scored = model.transform(filled(rows))
    return scored.withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")


def _fit_of(cfg: Config) -> tuple:
    """What a fit depends on: configurations alike in this share their scores."""
    return cfg.model, cfg.label, cfg.features, tuple(sorted(cfg.settings.items())), cfg.seed


def evaluate_fold(rows: DataFrame, cfg: Config, fits: dict | None = None) -> DataFrame:
    """One fold: ``rows`` carry a role of train or test. A fold too small on either side is a row that says so.

    The threshold is the training score that publishes the target rate; it is applied unchanged
    to the test rows. ``fits`` keeps the scores of this fold for configurations that differ in name, rate or least rows alone.
    """
    fits = {} if fits is None else fits
    y = F.col(cfg.label)
    live = rows.filter(y.isNotNull() & F.col("role").isin("train", "test"))
    size = {r["role"]: r["n"] for r in live.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    if size.get("train", 0) < cfg.min_train or size.get("test", 0) < cfg.min_test:
        known = {"config": cfg.name, "model": cfg.model, "target_rate": cfg.target_rate, "status": "insufficient rows",
                 "n_train": size.get("train", 0), "n_test": size.get("test", 0)}
        return live.sparkSession.createDataFrame([tuple(known.get(c.split()[0]) for c in FOLD_SCHEMA.split(", "))], FOLD_SCHEMA)
    live = live.select("code", "date", "role", cfg.label, *cfg.features)
    if _fit_of(cfg) not in fits:
        fits[_fit_of(cfg)] = staged(fit_scores(live.filter("role = 'train'"), live, cfg))
    scored = fits[_fit_of(cfg)]
    cut = threshold_for_rate(scored.filter("role = 'train'"), cfg.target_rate, []).select("threshold")
    marked = scored.join(F.broadcast(cut)).withColumn("_p", F.col("score") >= F.col("threshold"))
    test, train, p = F.col("role") == "test", F.col("role") == "train", F.col("_p")
    got = marked.agg(
        F.max("threshold").alias("threshold"),
        F.sum(train.cast("int")).alias("n_train"), F.sum(test.cast("int")).alias("n_test"),
        F.sum(F.when(test, y)).cast("bigint").alias("positives"), F.avg(F.when(test, y)).alias("base_rate"),
        F.sum((train & p).cast("int")).alias("insample_signals"), F.avg(F.when(train & p, y)).alias("insample_precision"),
        F.sum((test & p).cast("int")).alias("signals"), F.avg(F.when(test & p, y)).alias("precision"),
        F.countDistinct(F.when(test & p, F.col("code"))).alias("distinct_stocks"),
        F.countDistinct(F.when(test & p, F.col("date"))).alias("distinct_dates"))
    return got.withColumns({
        "config": F.lit(cfg.name), "model": F.lit(cfg.model), "target_rate": F.lit(cfg.target_rate), "status": F.lit("ok"),
        "lift": ratio("precision", "base_rate")}).select(*[c.split()[0] for c in FOLD_SCHEMA.split(", ")])


FOLD_SCHEMA = (
    "config string, model string, target_rate double, threshold double, n_train bigint, n_test bigint, positives bigint, "
    "base_rate double, insample_signals bigint, insample_precision double, signals bigint, precision double, "
    "distinct_stocks bigint, distinct_dates bigint, lift double, status string")


def walk_forward(rows: DataFrame, plan: DataFrame, cfg: Config, fold_ids: Iterable[int], fits: dict | None = None) -> DataFrame:
    """Fold results of one configuration; each fold is one model fit. ``fits`` shares fits with other configurations over the same rows."""
    out, fits = None, {} if fits is None else fits
    for k in fold_ids:
        part = evaluate_fold(rows.join(F.broadcast(plan.filter(F.col("fold") == k).select("date", "role")), "date"), cfg, fits.setdefault(k, {}))
        part = part.withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def search(rows: DataFrame, plan: DataFrame, configs: list[Config], fold_ids: list[int], threads: int = 8) -> DataFrame:
    """Pooled results per configuration; the loop is over fits and folds, never over data.

    A fit on one fold and the configurations that share it are one piece of work. Pieces are many small jobs of their own, so
    a few run side by side, begun by threads of the driver.
    """
    sharing: dict[tuple, list[Config]] = {}
    for c in configs:
        sharing.setdefault(_fit_of(c), []).append(c)

    def one(work: tuple[int, list[Config]]) -> list[DataFrame]:
        k, alike = work
        fits: dict = {}
        return [staged(walk_forward(rows, plan, c, [k], fits)) for c in alike]

    with ThreadPoolExecutor(threads) as pool:
        parts = [p for done in pool.map(one, [(k, alike) for k in fold_ids for alike in sharing.values()]) for p in done]
    folds = reduce(DataFrame.unionByName, parts)
    return pool_folds(staged(folds).filter("status = 'ok'"), ["config"])


PRESETS = {
    "models": [("gbt", {}), ("rf", {}), ("logistic", {})],
    "rate": [0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4],
    "label": [("label_high", 0.02), ("label_close", 0.02), ("label_close", 0.05), ("label_close", 0.1)],
}


def preset(name: str, features: tuple[str, ...], **kw) -> list[Config]:
    """Configurations of a named search: over models, publication rates, labels, or feature groups."""
    if name == "models":
        return [Config(f"model_{m}", m, features=features, settings=s, **kw) for m, s in PRESETS["models"]]
    if name == "rate":
        return [Config(f"rate_{r}", target_rate=r, features=features, **kw) for r in PRESETS["rate"]]
    if name == "label":
        return [Config(f"on_{y}_{r}", label=y, target_rate=r, features=features, **kw) for y, r in PRESETS["label"]]
    if name == "ablation":
        from ..functions.fixed import FEATURE_GROUPS
        kept = {f"without_{g}": tuple(f for f in features if f not in fs) for g, fs in FEATURE_GROUPS.items()}
        kept |= {f"only_{g}": tuple(f for f in features if f in fs) for g, fs in FEATURE_GROUPS.items()}
        return [Config("all", features=features, **kw)] + [
            Config(name, features=f, **kw) for name, f in kept.items() if 0 < len(f) < len(features)]
    raise KeyError(name)


def probability_metrics(scored: DataFrame, keys: list[str], label: str = "y", score: str = "score",
                        eps: float = 1e-8, **kw) -> DataFrame:
    """Log loss, Brier score, average precision and AUC of scores against labels."""
    rows = scored.filter(F.col(label).isNotNull())
    y, p = F.col(label), F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(score)))
    basic = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(y).alias("base_rate"),
        (-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("logloss"),
        F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"))
    dist = cumulative(rows, keys, [score], {"pos": F.sum(label)}, **kw)
    n, tp = F.col("all_n") - F.col("before_n"), F.col("all_pos") - F.col("before_pos")
    ap = dist.groupBy(*keys).agg((F.sum(F.col("pos") * tp / n) / F.sum("pos")).alias("average_precision"))
    area = auc(rows, keys, label, score, **kw).select(*keys, "auc")
    if not keys:
        return basic.join(F.broadcast(ap)).join(F.broadcast(area))
    return basic.join(ap, keys, "left").join(area, keys, "left")


def drop_largest_fold(folds: DataFrame) -> DataFrame:
    """Pooled result without the fold that published most."""
    top = folds.agg(F.max(F.struct("signals", "fold")).alias("_t")).select(F.col("_t.fold").alias("fold"))
    return pool_folds(folds.join(F.broadcast(top), "fold", "left_anti"), ["config"])


def run_rule_version(layered: DataFrame, min_tier: int, years: tuple[int, ...], horizon: int, version: str) -> DataFrame:
    """Rule version: every resolved candidate of a tier in the years, collapsed to events and scored."""
    pool = layered.filter((F.col("recall_tier") >= min_tier) & F.col("label_resolved"))
    picked = pool.filter(F.col("year").isin(*years)).select("code", "date", "label_bull", "label_joint")
    return _version_report(picked, pool, horizon, version)


def _version_report(picked: DataFrame, pool: DataFrame, horizon: int, version: str) -> DataFrame:
    events = dedupe(picked, horizon)
    got = events.agg(
        F.count(F.lit(1)).alias("signals_deduped"), F.coalesce(F.sum("label_bull"), F.lit(0)).alias("bull_hits"),
        F.coalesce(F.sum("label_joint"), F.lit(0)).alias("joint_hits"), F.countDistinct("code").alias("distinct_stocks"),
        F.countDistinct("date").alias("distinct_dates"))
    low, high = wilson(F.col("bull_hits"), F.col("signals_deduped"))
    size = pool.agg(F.count(F.lit(1)).alias("candidates_pool"))
    return got.join(F.broadcast(size)).withColumns({
        "version": F.lit(version), "bull_precision": ratio("bull_hits", "signals_deduped"),
        "joint_precision": ratio("joint_hits", "signals_deduped"), "wilson_low": low, "wilson_high": high})


def _version_score(train: DataFrame, rows: DataFrame, kind: str, alpha: float, settings: dict) -> DataFrame:
    gain = Config("gain", label="label_bull", features=LAYER_FEATURES, settings=settings, seed=20260916)
    scored = fit_scores(train, rows, gain)
    if kind == "gain":
        return scored
    lossy = train.withColumn("_loss", 1 - F.col("label_joint"))
    if lossy.select("_loss").distinct().count() < 2:
        return scored
    loss = Config("loss", label="_loss", features=LAYER_FEATURES, settings=settings, seed=20260917)
    both = fit_scores(lossy, scored.withColumnRenamed("score", "_gain"), loss)
    return both.withColumn("score", F.col("_gain") - alpha * F.col("score")).drop("_gain")


def run_model_version(layered: DataFrame, version: str, years: tuple[int, ...], regime: str = "webpro", rate: float = 0.10,
                      alpha: float = 1.0, settings: dict | None = None, min_fit: int = 200) -> DataFrame:
    """Model version of the low-zone family, one row per evaluation year.

    A year is scored by models fitted on earlier years. Its threshold is a quantile of scores
    that earlier years got from still earlier ones; a year without such scores is skipped. The
    in-sample versions take the quantile of the year's own scores and say so.
    """
    spec = {v[0]: v for v in LOWZONE_VERSIONS}[version]
    _, tier, kind, in_sample, first_only = spec
    horizon = REGIMES[regime][0]
    pool = staged(layered.filter((F.col("recall_tier") >= tier) & F.col("label_resolved")))
    counts = {r["year"]: r["n"] for r in pool.groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()}

    def before(year):
        return sum(n for y, n in counts.items() if y < year)

    scored_years = {}
    for year in sorted(counts):
        if before(year) >= min_fit:
            scored_years[year] = staged(_version_score(
                pool.filter(F.col("year") < year), pool.filter(F.col("year") == year), kind, alpha, settings or {}))
    parts = None
    for year in years:
        if year not in scored_years:
            continue
        own = scored_years[year]
        if in_sample:
            source = own
        else:
            prior = [d for y, d in scored_years.items() if y < year]
            if not prior:
                continue
            source = prior[0]
            for d in prior[1:]:
                source = source.unionByName(d)
        cut = quantiles(source, [], "score", {"threshold": 1.0 - rate})
        picked = own.join(F.broadcast(cut)).filter(F.col("score") >= F.col("threshold")).withColumn("eval_year", F.lit(year))
        parts = picked if parts is None else parts.unionByName(picked)
    if parts is None:
        none = pool.select("code", "date", "label_bull", "label_joint").filter(F.lit(False))
        return _version_report(none, pool, horizon, version).withColumn("in_sample", F.lit(in_sample))
    chosen = staged(parts.select("code", "date", "label_bull", "label_joint", "score"))
    if first_only:
        chosen = first_per_year(chosen)
    report = _version_report(chosen.select("code", "date", "label_bull", "label_joint"), pool, horizon, version)
    return report.withColumn("in_sample", F.lit(in_sample))
