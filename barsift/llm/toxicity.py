"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other text is unlabelled, as clean labels are not used but for the class
prior p. The risk of a classifier f is p R+(P) + max(0, R-(U) - p R-(P)): what unlabelled texts cost as negatives, less what
the toxic ones among them would. Where that difference falls below zero the classifier has begun to learn the
sample by heart, and the step goes back along it.

Features are words and runs of letters in them, by 64-bit hashes, counted once a text, so length does not thin them out. How many texts hold
each is counted over all of them; a feature takes part if it is clearly commoner among the positives than that, by as much as it
is (few positives can't tell thousands of chance words apart). The classifiers are linear, few, and trained in numpy on a
bounded sample of the texts; the prior is taken from all labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8

#: Letters of the runs inside a word that are features beside the word.
RUN = 5
#: The sample that the classifiers are trained on: expected rows of each kind.
POSITIVES, UNLABELLED = 8_192, 24_576
#: Classifiers, passes over the sample, texts of one step, step size, weight decay, and the share of a backward step.
MODELS, PASSES, STEP_ROWS, STEP, DECAY, BACK = 3, 12, 256, 0.05, 1e-3, 1.0
#: Least positives that hold a feature, standard errors by which it must be commoner among them, texts added to either count of its lift.
LEAST, CLEAR, ADDED = 3, 4.0, 2.0
#: Margin by which a text without any feature stays clean.
APART = 0.5
_REMEMBERED = 500_000
_TOKEN = re.compile(r"\w+")
_SLICES = 1 << 20


class Features:
    """Features of texts: their 64-bit hashes, or, under a vocabulary (sorted hashes), their places in it. Words are remembered."""

    def __init__(self, vocabulary: np.ndarray | None = None):
        self.of: dict[str, list[int]] = {}
        self.place = None if vocabulary is None else {h: i for i, h in enumerate(vocabulary.tolist())}

    def _word(self, w: str) -> list[int]:
        digest = xxhash.xxh3_64_intdigest
        found = [digest(p) for p in (w, *(f"-{w[i:i + RUN]}" for i in range(len(w) - RUN + 1)))]
        if self.place is not None:
            found = [self.place[h] for h in found if h in self.place]
        self.of[w] = found
        return found

    def __call__(self, text: bytes) -> np.ndarray:
        """Sorted different features of one text."""
        if len(self.of) > _REMEMBERED:
            self.of = {}
        known, out = self.of, []
        for w in set(_TOKEN.findall(text.decode("utf-8", "replace").lower())):
            found = known.get(w)
            out += self._word(w) if found is None else found
        return np.array(sorted(set(out)), np.uint64 if self.place is None else np.int32)


@dataclass
class Model:
    """Features, their weights in the mean classifier, its bias, and the class prior."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


class _Rows:
    """Feature lists end to end."""

    def __init__(self, lists: list[np.ndarray]):
        self.ends = np.cumsum([len(x) for x in lists]) if lists else np.zeros(0, np.int64)
        self.ids = np.concatenate(lists) if lists else np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.ends)

    def part(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of some rows, and the row (as a place in ``rows``) of each."""
        size = self.ends[rows] - np.where(rows > 0, self.ends[rows - 1], 0)
        owner = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.ends[rows] - size, size)
        return self.ids[at], owner


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _margins(ids, owner, n: int, w: np.ndarray, bias: float) -> np.ndarray:
    return bias + np.bincount(owner, w[ids], n)


def lifts(seen: np.ndarray, positives: int, counts: np.ndarray, n: int) -> np.ndarray:
    """Value of every feature: the log of its lift among positives over all ``n`` texts, 0 where that isn't clear."""
    chance = positives * counts / n
    clear = seen - chance >= CLEAR * np.sqrt(chance + 1)
    return np.where(clear, np.log((seen + ADDED) / (chance + ADDED)), 0.0)


def train(positive: _Rows, unlabelled: _Rows, scale: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """One linear classifier by minibatch steps on the corrected risk, with logistic loss and adaptive step sizes.

    Every feature is commoner among positives, so no weight goes below zero: long texts would gather what copies left there.
    """
    rng = np.random.default_rng(seed)
    k = len(scale)
    w, bias = np.zeros(k), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    steps = max(1, -(-len(unlabelled) // STEP_ROWS))
    total = 0
    for _ in range(PASSES):
        order_u = np.array_split(rng.permutation(len(unlabelled)), steps)
        order_p = np.array_split(rng.permutation(max(len(positive), min(steps, 64 * len(positive)))) % len(positive), steps)
        for rows_p, rows_u in zip(order_p, order_u, strict=True):
            if not len(rows_p):
                rows_p = rng.integers(len(positive), size=1)
            total += 1
            ids_p, own_p = positive.part(rows_p)
            ids_u, own_u = unlabelled.part(rows_u)
            v = w * scale
            zp, zu = _margins(ids_p, own_p, len(rows_p), v, bias), _margins(ids_u, own_u, len(rows_u), v, bias)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gu, gp = _sigmoid(zu) / len(rows_u), -prior * _sigmoid(zp) / len(rows_p)
            if negative < 0:
                gu, gp = -BACK * gu, -BACK * gp
            else:
                gp = gp - prior * _sigmoid(-zp) / len(rows_p)
            g = np.bincount(ids_p, gp[own_p], k + 1) + np.bincount(ids_u, gu[own_u], k + 1)
            g[:k] *= scale
            g[k] = gp.sum() + gu.sum()
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            move = STEP * (first / (1 - 0.9 ** total)) / (np.sqrt(second / (1 - 0.999 ** total)) + 1e-8)
            w = np.maximum(w - move[:k] - STEP * DECAY * w, 0)
            bias -= move[k]
    return w * scale, bias


def _counts(rows: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many of the rows hold each feature of the vocabulary; a task sends one number for each."""
    held, size = rows.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = Features(held.value), np.zeros(size, np.int64)
        for part in chunks(batches):
            total += np.bincount(np.concatenate([of(t) for t in part.column("text").to_pylist()]), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    found = rows.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["at"]] = found["n"]
    return out


def _listed(rows: DataFrame, vocabulary: np.ndarray | None = None) -> list[np.ndarray]:
    """Feature lists of a bounded number of rows, on the driver."""
    held = None if vocabulary is None else rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(None if held is None else held.value)
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("h"), pa.array([of(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())], ["h", "f"])

    found = rows.select("h", "text").mapInArrow(run, "h long, f binary").toPandas().sort_values(["h", "f"])
    return [np.frombuffer(b, np.uint64 if held is None else np.int32) for b in found["f"]]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", prior: float | None = None) -> Model:
    """Classifier from the rows of ``docs`` and the labels of some of them.

    Positives are texts that ``labels`` calls toxic (1; of several labels of an id the greatest holds); all rows are unlabelled
    texts. Both are sampled by a hash of the id, POSITIVES and UNLABELLED rows on average. The prior is the toxic share of all
    labels unless given. Without a toxic text, or without a text, no weight is learned and every text scores the prior.
    """
    rows = docs.select(F.col(doc_id).alias("id"), utf8(F.col(text)).alias("text")).withColumn("h", F.xxhash64("id", F.octet_length("text")))
    known = labels.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic")).filter("id is not null and toxic is not null")
    found, all_labels = known.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    n = rows.count()
    if prior is None:
        prior = (found + 0.5) / (all_labels + 1)
    prior = float(min(max(prior, 1e-4), 1 - 1e-4))
    def share(key, bound, of):
        return F.pmod(key, F.lit(_SLICES)) < int(min(1.0, bound / of) * _SLICES)

    blank = Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), float(np.log(prior / (1 - prior))), prior)
    if not found or not n:
        return blank
    # A sample of bounded size, so it may be broadcast.
    chosen = known.filter("toxic = 1").filter(share(F.xxhash64("id"), POSITIVES, found)).select("id")
    lists = _listed(rows.join(F.broadcast(chosen), "id", "left_semi"))
    hashes, seen = np.unique(np.concatenate([*lists, np.zeros(0, np.uint64)]), return_counts=True)
    often = seen >= LEAST
    hashes, seen = hashes[often], seen[often]
    scale = lifts(seen, len(lists), _counts(rows, hashes), n)
    vocabulary, scale = hashes[scale > 0], scale[scale > 0]
    if not len(vocabulary):
        return blank
    positive = _Rows([np.flatnonzero(np.isin(vocabulary, x, assume_unique=True)).astype(np.int32) for x in lists])
    unlabelled = _Rows(_listed(rows.filter(share(F.col("h"), UNLABELLED, n)), vocabulary))
    if not len(unlabelled):
        return blank
    models = [train(positive, unlabelled, scale, prior, seed) for seed in range(MODELS)]
    weights, bias = np.mean([w for w, _ in models], axis=0), float(np.mean([b for _, b in models]))
    # As many unlabelled texts score one half or more as the prior says, but none without a feature.
    every = np.arange(len(unlabelled))
    cut = np.quantile(_margins(*unlabelled.part(every), len(every), weights, 0.0), 1 - prior)
    return Model(vocabulary, weights.astype(np.float32), -float(max(cut, min(-bias, APART))), prior)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1, higher: rather toxic) and ``predicted`` (1 from 0.5 on) to every row.

    Whole texts are scored. A null text, and one without a word, has no feature and so the score of the model's bias. Columns of
    ``docs`` with the two names are replaced; ``keep`` names the columns to return beside them (all if None). Repeated
    rows are scored each; no rows give none.
    """
    rows = docs.drop("score", "predicted")
    kept = rows.columns if keep is None else keep
    held = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.select(F.struct(*kept).alias("row"), utf8(F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        of = Features(model.vocabulary)
        for part in chunks(batches):
            z = np.array([model.bias + model.weights[of(t)].sum(dtype=np.float64) for t in part.column("text").to_pylist()])
            s = _sigmoid(z)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["row", "score", "predicted"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, score double, predicted int").select("row.*", "score", "predicted")
