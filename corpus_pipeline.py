"""The corpus pipeline: from documents to a deduplicated, decontaminated mix.

Each stage takes all that the one before it kept. Near-duplicates are texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more; the SimHash query's own bound (three words, two bits) is not wide enough for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsift.llm import decontaminate, langid, mixing, nearcopies, simhash, suffixes
from barsift.llm.common import short_batches, table
from barsift.session import staged

#: Least posterior of a document's language.
CONFIDENT = 0.5
#: Repeated passages of over so many words go. No such passage has fewer bytes than ``REPEAT``; its grams are ``GRAM`` bytes.
PASSAGE, REPEAT, GRAM = 50, 101, 64


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a language of at least ``CONFIDENT``, learned from those that name one."""
    short_batches(spark)
    judged = langid.identify(docs, langid.fit(docs))
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= CONFIDENT)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    short_batches(spark)
    return simhash.keep_one(docs, judge=nearcopies.judged)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the repeated passages of over ``PASSAGE`` words; an emptied document stays, with empty text."""
    short_batches(spark)
    cut = suffixes.dedupe(docs, length=REPEAT, gram=GRAM, over=PASSAGE)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    short_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    short_batches(spark)
    return mixing.emitted(mixing.mix(docs))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_dedup", repeated_text),
    ("decontamination", benchmark),
    ("mixing", mixture),
]
#: Fingerprints, suffixes and classifiers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
