"""URL filter: rules first, then the ratio of two character language models. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import lower_ascii

#: (verdict, host and path) of the rules; a rule fits its host and all subdomains.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Longest gram: up to ORDER - 1 characters of context.
ORDER = 5
#: Probability of a character before anything is known; the same in both models.
BASE = 1.0 / 256
#: Of the URLs with a rule, one in FOLDS calibrates and is not learned from.
FOLDS = 5
SALTS = 16
_START, _END = "\x02", "\x03"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no URL or no ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _URL, i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; equal lengths go to the first by text."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    table = F.array(*[F.struct(
        F.lit(r[:r.index("/")]).alias("host"), F.lit(r[r.index("/"):]).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"))
        for v, r in ordered])
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.when(F.size(fits) > 0, F.struct(fits[0]["rule"].alias("rule"), fits[0]["verdict"].alias("verdict")))


def _grams(text: Column) -> Column:
    """One gram of ``ORDER`` characters per character and end of the text, start marks before it."""
    padded = F.concat(F.lit(_START * (ORDER - 1)), text, F.lit(_END))
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER))))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log10 of the accepted over the rejected model's probability of a gram's last character.

    ``counts`` has every gram once with its number of accepted and rejected uses. Both models are of
    variable order: a context of k characters interpolates its own counts with the context of k - 1
    (Witten-Bell, weight by the number of different successors), and a context never seen gives way
    to the shorter one. Shorter contexts are suffixes of longer ones, so their counts are sums.
    """
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda k: F.substring("gram", -k, k)))
    pairs = counts.withColumn("part", suffix)
    parts = pairs.groupBy("part").agg(F.sum("accepted").alias("ca"), F.sum("rejected").alias("cr"))
    # A context's group holds one row per different successor, so it is bounded by the alphabet.
    context = Window.partitionBy(F.length("part"), F.expr("substring(part, 1, length(part) - 1)"))
    for c in ("a", "r"):
        parts = parts.withColumn(f"n{c}", F.sum(f"c{c}").over(context)).withColumn(f"t{c}", F.count_if(F.col(f"c{c}") > 0).over(context))
    level = F.struct(F.length("part").alias("k"), *["ca", "na", "ta", "cr", "nr", "tr"])
    rows = pairs.select("gram", "part").join(parts, "part").groupBy("gram").agg(F.array_sort(F.collect_list(level)).alias("levels"))

    def chance(c: str) -> Column:
        step = lambda p, x: F.when(x[f"n{c}"] > 0, (x[f"c{c}"] + x[f"t{c}"] * p) / (x[f"n{c}"] + x[f"t{c}"])).otherwise(p)
        return F.aggregate("levels", F.lit(BASE), step)

    return rows.select("gram", (F.log10(chance("a")) - F.log10(chance("r"))).alias("ratio"))


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict on every row: page_id, host, path, rule, verdict, score, threshold.

    The rule's verdict where one fits. The rest go by the score: the log-likelihood difference of two
    character models, learned from the URLs (host and path) that rules allow and block, per character.
    It is compared with a threshold between the two kinds of URLs that were kept out of learning:
    each mean moved toward the other in proportion to the deviations (all labelled URLs where one kind
    has none kept out). At or above it is allow. Different URLs are scored once, weighted by their rows.

    A null URL or one without ``://`` has empty host and path and is judged by its score; without rules
    of both kinds every score and the threshold are 0 and the verdict is allow. Repeated rows are
    repeated. No rows give none.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("text", F.concat("host", "path"))
    texts = staged(rows.groupBy("text").agg(F.count("*").alias("n"), F.first("fit.verdict").alias("said")))
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    learn = lambda v: F.sum(F.when((F.col("said") == v) & ~fold, F.col("n")).otherwise(0))
    places = texts.select("text", "n", "said", _grams(F.col("text")).alias("gram"))
    counts = staged(places.groupBy("gram").agg(learn("allow").alias("accepted"), learn("block").alias("rejected")))
    ratios = staged(log_ratios(counts))
    # Frequent grams are in every URL: the lookup is copied and the places are dealt over the copies. Copied
    # lookups are larger than their files say, so they are merged and never broadcast.
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    places = texts.select("text", F.pmod(F.hash("text"), F.lit(SALTS)).alias("salt"), _grams(F.col("text")).alias("gram"))
    scores = places.join(ratios.withColumn("salt", salts).hint("merge"), ["gram", "salt"]).groupBy("text").agg(F.avg("ratio").alias("score"))
    scored = staged(texts.join(scores, "text"))

    def of(v: str, part: Column) -> list[Column]:
        x = F.when((F.col("said") == v) & part, F.col("score"))
        return [F.avg(x), F.coalesce(F.stddev_pop(x), F.lit(0.0))]

    facts = {f"{v[0]}{i}{k}": x for v in ("allow", "block") for i, part in enumerate((fold, F.lit(True))) for k, x in zip("ms", of(v, part), strict=True)}
    one = scored.agg(*[x.alias(k) for k, x in facts.items()])
    pick = lambda v, k: F.when(F.col("a0m").isNotNull() & F.col("b0m").isNotNull(), F.col(f"{v}0{k}")).otherwise(F.col(f"{v}1{k}"))
    ma, sa, mr, sr = pick("a", "m"), pick("a", "s"), pick("b", "m"), pick("b", "s")
    cut = F.when(sa + sr > 0, (ma * sr + mr * sa) / (sa + sr)).otherwise((ma + mr) / 2)
    one = one.select(F.coalesce(cut, F.lit(0.0)).alias("threshold"))
    lookup = scored.select("text", "score", salts.alias("salt"))
    judged = rows.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(SALTS))).join(lookup.hint("merge"), ["text", "salt"]).crossJoin(F.broadcast(one))
    by_score = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                         F.coalesce("fit.verdict", by_score).alias("verdict"), "score", "threshold")
