"""The registered queries of the operators, and SQL where it can state them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staging_root
from . import ann, decontaminate, dialogue, langid, licenses, maxent, mixing, negatives, simhash, suffixes, toxicity, urlfilter, warc
from .common import crc_bucket, table

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return add


_MIX_SQL = r"""with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
p as (select *, [1, 2, 3][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from s),
c as (select *, source_size * 3 as cap, (source_size * 3)::double / weight as fills from p),
l as (select *, (sum(source_size) over ()
    - coalesce(sum(cap) over (order by fills, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
  / sum(weight) over (order by fills, source nulls last rows between current row and unbounded following) as level from c),
t as (select source, source_size, least(cap::double, weight * max(level) over ()) as target from l),
r as (select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size else 0e0 end as rate,
    ('0x' || substr(md5('mix|' || d.doc_id), 1, 13))::bigint / 4503599627370496e0 as u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (size * (floor(rate)::bigint + (u < rate - floor(rate))::bigint))::bigint as taken from r"""


@query("op6_mixing", _MIX_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


@query("op9_simhash")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op7_warc")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    archive = f"{staging_root(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write(table(spark, folder, "pages"), archive)
    return warc.read(spark, archive, manifest).drop("url", "payload")


@query("op1_lm_scoring")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(crc_bucket(F.col("doc_id"), 5) == 1, F.lit(False)))
    return maxent.score(docs, docs.filter("not held_out"), keep=("held_out",))


@query("op2_url_filter")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return urlfilter.judge(table(spark, folder, "pages"))


@query("op3_decontamination")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


@query("op8_ann")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), lambda i: i % 20 == 0)


@query("op10_suffix_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.dedupe(table(spark, folder, "documents"), keep=["doc_id"], with_text=False)


@query("op4_license_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of a tree: source, language, and a directory for every hundred ids."""
    docs = table(spark, folder, "documents")
    path = F.concat_ws("/", "source", "lang", (F.col("doc_id") / 100).cast("bigint"), "doc_id")
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"), keep=("doc_id",))


def _damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the crc32 of id and turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"),
                                crc_bucket(F.concat_ws(":", blank("conv_id"), blank("turn")), 20).alias("_d"))
    d = F.col("_d")
    return rows.filter(d != 0).select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(d == 1, "").when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(d == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy")


@query("op11_conversation_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    found = dialogue.repair(_damaged(conversations)).withColumnRenamed("conv_id", "_conv")
    every = conversations.select("conv_id").distinct()
    out = every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left").drop("_conv")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_HARD_SQL = """with q as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from q a join q b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, row_number() over w as rank, s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on p.anchor_id = s.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)
qualify row_number() over w <= 5"""


@query("op13_hard_negatives", _HARD_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label").cast("long")
    vectors = table(spark, folder, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(vectors, lambda i: i % 100 == 0)


@query("op12_toxicity")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs.filter(~held_out), table(spark, folder, "labels").filter(~held_out))
    return toxicity.score(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])
