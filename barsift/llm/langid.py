"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8

#: n-gram lengths, hash buckets, added count, and the most languages a model may have.
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
ADDED = 0.5
MAX_LANGUAGES = 256
#: Words whose bucket lists a task remembers before it starts anew; a matter of memory, not of results.
_REMEMBERED = 200_000
#: Words whose n-grams are listed at once.
_LISTED = 8_192
_UNKNOWN = "und"


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of every word, with a space before and after it, and where each word's list ends.

    n-grams are taken inside a word, so a text is the sum of its words.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    room = np.repeat(ends, lengths) - np.arange(len(codes))
    word = np.repeat(np.arange(len(words)), lengths)
    found, owner = [], []
    h = np.zeros(len(codes), np.uint64)
    for k in range(max(ORDERS)):
        h[: len(h) - k] = (h[: len(h) - k] + codes[k:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if k + 1 in ORDERS:
            at = room > k
            found.append(((h[at] + np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48))
            owner.append(word[at])
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order].astype(np.int64), np.cumsum(np.bincount(owner, minlength=len(words)))


def _slices(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n-grams of all words, some words at a time: number of the first word, buckets, list ends."""
    for a in range(0, len(words), _LISTED):
        yield a, *ngram_buckets(words[a:a + _LISTED])


def _words(text: bytes) -> list[str]:
    return text.decode("utf-8", "replace").lower().split()


@dataclass
class Model:
    """Languages, and the log-probability of every bucket in each (buckets x languages)."""

    languages: list[str]
    matrix: np.ndarray
    prior: np.ndarray


def bucket_counts(docs: DataFrame) -> DataFrame:
    """n-gram counts by language and bucket over all rows of ``docs`` (text as bytes, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for part in chunks(batches):
            by: dict[str, dict[str, int]] = {}
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                seen = by.setdefault(lang, {})
                texts[lang] = texts.get(lang, 0) + 1
                for w in _words(text):
                    seen[w] = seen.get(w, 0) + 1
            for lang, seen in by.items():
                total = held.setdefault(lang, np.zeros(BUCKETS))
                uses = np.fromiter(seen.values(), np.float64, len(seen))
                for a, grams, ends in _slices(list(seen)):
                    total += np.bincount(grams, np.repeat(uses[a:a + len(ends)], np.diff(ends, prepend=0)), BUCKETS)
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()),
                pa.array(np.append(total[at], texts[lang]).astype(np.int64))], ["lang", "bucket", "n"])

    rows = docs.mapInArrow(count, "lang string, bucket int, n bigint")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Model from every row with a language and a letter.

    What reaches the driver is one count per language and bucket, at most
    ``MAX_LANGUAGES * (BUCKETS + 1)`` rows whatever the corpus; more languages raise an error.
    """
    known = docs.select(utf8(F.col(text)).alias("text"), F.col(lang).alias("lang"), F.col(text).rlike(r"\p{L}").alias("_has"))
    known = known.filter(F.col("lang").isNotNull() & F.col("_has")).select("text", "lang")
    counts = bucket_counts(known).toPandas()
    languages = sorted(counts["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; a model takes {MAX_LANGUAGES}")
    code = counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    bucket, n = counts["bucket"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    matrix = np.full((BUCKETS, len(languages)), ADDED)
    at = bucket >= 0
    np.add.at(matrix, (bucket[at], code[at]), n[at])
    prior = np.zeros(len(languages))
    prior[code[~at]] = n[~at]
    with np.errstate(divide="ignore"):
        return Model(languages, np.log(matrix / matrix.sum(0)), np.log(prior / max(prior.sum(), 1)))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the posterior of that language, 0 to 1) to every row.

    A null text, a text without any letter, and every text under a model without languages get
    ``und`` and score 0. Equal scores go to the first language by name. Whole texts are scored;
    columns of ``docs`` with the two names are replaced. ``keep`` names the columns to return beside
    them (all if None).
    """
    rows = docs.drop("lang_pred", "score")
    kept = rows.columns if keep is None else keep
    held = rows.sparkSession.sparkContext.broadcast((model.languages, model.matrix, model.prior))
    rows = rows.select(F.struct(*kept).alias("row"), F.when(F.col(text).rlike(r"\p{L}"), utf8(F.col(text))).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, matrix, prior = held.value
        index: dict[str, int] = {}
        sums = np.zeros((0, len(languages)))
        for part in chunks(batches):
            if len(index) > _REMEMBERED:
                index, sums = {}, sums[:0]
            ids, ends, fresh = [], [], []
            for text in part.column("text").to_pylist():
                for w in _words(text or b""):
                    i = index.get(w)
                    if i is None:
                        i = index[w] = len(index)
                        fresh.append(w)
                    ids.append(i)
                ends.append(len(ids))
            if fresh:
                new = [np.add.reduceat(matrix[grams], np.concatenate([[0], stop[:-1]]), axis=0) for _, grams, stop in _slices(fresh)]
                sums = np.concatenate([sums, *new])
            n = np.diff(np.array(ends), prepend=0)
            total = np.tile(prior, (len(n), 1))
            if ids and languages:
                full = n > 0
                total[full] += np.add.reduceat(sums[np.array(ids)], (np.array(ends) - n)[full], axis=0)
            missing = part.column("text").is_null().to_numpy(zero_copy_only=False)
            if languages:
                best = total.argmax(1)
                p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                pred = np.array(languages, object)[best]
            else:
                pred, p = np.full(len(n), _UNKNOWN, object), np.zeros(len(n))
            pred[missing], p[missing] = _UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(pred, pa.string()), pa.array(p)], ["row", "lang_pred", "score"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(score, f"row {kind}, lang_pred string, score double").select("row.*", "lang_pred", "score")
