"""Hard negatives by pruned inner-product search over length buckets.

Rows lie in order of length, so that each partition, and each bucket of a few thousand rows in it, is a range of lengths. A
bucket keeps a sorted list of values for every coordinate of its rows' directions. An anchor that asks for a score of at
least s asks a bucket for a cosine of at least s / (its length x the bucket's greatest length), which bounds every
coordinate of a fitting direction. The ranges of its focus coordinates, the greatest of its own, are cut out of the sorted
lists, rows in all of them are candidates, and these are scored exactly on the integers.

Anchors come in runs of bounded size, each broadcast to all rows, first for the positives and then, with the positives'
scores as bounds, for the negatives. A bounded sample of the rows is asked first: what it finds are lower bounds
that prune the rest, never results by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Components become floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies from LEAST to MOST hundredths of the positive's.
LEAST, MOST = 80, 100
#: Bytes of one run of anchors, and the most anchors in it.
RUN_BYTES, RUN_ROWS = 16 << 20, 32_768
#: Rows of one length bucket, focus coordinates of an anchor, and rows (on average) of the sample that is asked first.
BUCKET, FOCUS, PILOT = 4_096, 4, 65_536
#: Vector bytes of one partition of rows.
PART_BYTES = 64 << 20
_EXACT = 2.0 ** 53
_SLACK = 1e-9
_NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(vec_id, label, dim, norm, v): integer components packed as 16-bit integers where they fit, else as doubles.

    Rows without label, without vector, or with a null or non-finite component or length (after scaling too) are left out. Of rows
    that repeat a vec_id the one of the least label and then the least bytes stays; rows without vec_id go.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col(embedding).cast("array<double>").alias("v")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            out, dim, norm, good = [], [], [], np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = vectors[i].values
                if x.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(x.to_numpy(zero_copy_only=False) * SCALE)
                    length = float(np.linalg.norm(x))
                if np.isfinite(x).all() and np.isfinite(length):
                    good[i] = True
                    out.append(x.astype("<i2").tobytes() if (np.abs(x) < 32_768).all() else x.astype("<f8").tobytes())
                    dim.append(len(x))
                    norm.append(length)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").filter(keep), batch.column("label").filter(keep), pa.array(dim, pa.int32()), pa.array(norm, pa.float64()),
                pa.array(out, pa.binary())], ["vec_id", "label", "dim", "norm", "v"])

    rows = rows.mapInArrow(run, "vec_id long, label long, dim int, norm double, v binary")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "norm", "v")).alias("r")).select("vec_id", "r.*")


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(packed), dim))
    for i, b in enumerate(packed):
        out[i] = np.frombuffer(b, "<i2" if len(b) == 2 * dim else "<f8")
    return out


def _directions(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(x / np.where(norm > 0, norm, 1)[:, None])


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of x with y, whose parts are whole; held at the ends of a 64-bit integer."""
    bound = x.shape[-1] * (np.abs(x).max() if x.size else 0.0) * (np.abs(y).max() if y.size else 0.0)
    if bound < _EXACT:
        return (x @ y).astype(np.int64)
    ends = np.iinfo(np.int64)
    whole = [int(v) for v in y.tolist()]
    return np.array([min(max(sum(int(a) * b for a, b in zip(r, whole, strict=True)), ends.min), ends.max) for r in x.tolist()], np.int64)


class Bucket:
    """Rows of one range of lengths, with a sorted list for each coordinate of their directions."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norm: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.longest, self.shortest = norm.max(), norm.min()
        ways = _directions(x, norm)
        self.order = np.argsort(ways, axis=0, kind="stable").T.copy()
        self.lists = np.take_along_axis(ways.T, self.order, 1)

    def candidates(self, ways: np.ndarray, lengths: np.ndarray, least: np.ndarray, focus: np.ndarray) -> Iterator[tuple[int, np.ndarray | None]]:
        """(anchor, rows that may reach its least score) for the anchors that have any; None for all rows.

        ``least`` holds the score asked of each anchor, minus infinity where any will do.
        """
        with np.errstate(divide="ignore", invalid="ignore"):
            # A positive score asks least of the longest rows, a negative one of the shortest.
            cosine = np.where(least > 0, least / (lengths * self.longest), least / (lengths * self.shortest)) - _SLACK
        flat = (lengths == 0) | (self.shortest == 0) & (least <= 0) | np.isnan(cosine) & ~((least > 0) & (self.longest == 0))
        cosine[flat] = -1
        open_ = np.where(lengths > 0, cosine <= 1, least <= 0) & ~((least > 0) & (self.longest == 0))
        bounded = open_ & (cosine > -1)
        for i in np.flatnonzero(open_ & ~bounded):
            yield int(i), None
        at = np.flatnonzero(bounded)
        if not len(at):
            return
        angle = np.arccos(np.clip(cosine[at], -1, 1))
        first, stop = np.empty((2, len(at), focus.shape[1]), np.int64)
        for k in range(focus.shape[1]):
            f = focus[at, k]
            own = np.arccos(np.clip(ways[at, f], -1, 1))
            lo, hi = np.cos(np.minimum(own + angle, np.pi)) - _SLACK, np.cos(np.maximum(own - angle, 0)) + _SLACK
            for c in np.unique(f):
                of = f == c
                first[of, k] = np.searchsorted(self.lists[c], lo[of], "left")
                stop[of, k] = np.searchsorted(self.lists[c], hi[of], "right")
        size = stop - first
        by = np.argsort(size, axis=1, kind="stable")
        total = self.x.shape[0]
        for j, i in enumerate(at.tolist()):
            k = by[j, 0]
            if size[j, k] == 0:
                continue
            if size[j, k] > total // 2:
                yield i, None
                continue
            rows = self.order[focus[i, k], first[j, k]:stop[j, k]]
            for k in by[j, 1:]:
                if size[j, k] > total // 2 or len(rows) < 32:
                    break
                inside = np.zeros(total, bool)
                inside[self.order[focus[i, k], first[j, k]:stop[j, k]]] = True
                rows = rows[inside[rows]]
            if len(rows):
                yield i, rows


class Anchors:
    """One run of anchors of one dimension, with the scores asked of them."""

    def __init__(self, ids, labels, norm, packed, dim: int):
        self.ids, self.labels, self.norm = np.array(ids, np.int64), np.array(labels, np.int64), np.array(norm)
        self.x = _matrix(packed, dim)
        self.ways = _directions(self.x, self.norm)
        k = min(FOCUS, dim)
        self.focus = np.argsort(-np.abs(self.ways), axis=1, kind="stable")[:, :k]


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best, by falling score and then rising id."""
    if len(scores) > 4 * n:
        # Nothing under the n-th score can be among them.
        cut = np.partition(scores, len(scores) - n)[len(scores) - n]
        at = np.flatnonzero(scores >= cut)
        return at[np.lexsort((ids[at], -scores[at]))][:n]
    return np.lexsort((ids, -scores))[:n]


def _buckets(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[Bucket]:
    for batch in batches:
        for a in range(0, batch.num_rows, BUCKET):
            part = batch.slice(a, BUCKET)
            ids, labels, norm = (part.column(c).to_numpy() for c in ("vec_id", "label", "norm"))
            yield Bucket(ids, labels, _matrix(part.column("v").to_pylist(), dim), norm)


def _asked(rows: DataFrame, anchors: Anchors, dim: int, positive: tuple[np.ndarray, np.ndarray] | None, floor: np.ndarray) -> DataFrame:
    """(a, j, vec_id, score): the best rows each partition has for each anchor.

    ``a`` numbers the anchors of the run. Without ``positive``, the POSITIVES best rows of the anchor's own label (j is 0). With it,
    (anchor numbers, scores) of positives, the NEGATIVES best rows of other labels within the positive's bounds, for each positive j.
    ``floor`` holds a score under which nothing is needed, for each anchor or positive.
    """
    held = rows.sparkSession.sparkContext.broadcast((anchors, positive, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, positive, floor = held.value
        if positive is None:
            group, n, floor = np.arange(len(anchors.ids)), POSITIVES, floor.astype(float)
        else:
            group, n = positive[0], NEGATIVES
            floor = np.maximum(floor.astype(float), np.ceil(LEAST * positive[1] / 100))
        ends = np.searchsorted(group, np.arange(len(anchors.ids) + 1))
        some: list[list] = [[] for _ in group]
        for bucket in _buckets(batches, dim):
            least = np.full(len(anchors.ids), np.inf)
            np.minimum.at(least, group, floor)
            for i, rows in bucket.candidates(anchors.ways, anchors.norm, least, anchors.focus):
                same = bucket.labels == anchors.labels[i] if rows is None else bucket.labels[rows] == anchors.labels[i]
                fits = np.flatnonzero(same if positive is None else ~same)
                rows = fits if rows is None else rows[fits]
                ids = bucket.ids[rows]
                if positive is None:
                    rows, ids = rows[ids != anchors.ids[i]], ids[ids != anchors.ids[i]]
                if not len(rows):
                    continue
                scores = exact_scores(bucket.x[rows], anchors.x[i])
                for j in range(ends[i], ends[i + 1]):
                    fit = scores >= floor[j]
                    if positive is not None:
                        fit &= scores <= MOST * positive[1][j] // 100
                    s, at = scores[fit], ids[fit]
                    if len(s):
                        b = best(s, at, n)
                        mine = sorted([*some[j], *zip((-s[b]).tolist(), at[b].tolist(), strict=True)])[:n]
                        some[j] = mine
                        if len(mine) == n:
                            # A later row of that score may still have the smaller id.
                            floor[j] = max(floor[j], -mine[-1][0])
        found = [(int(group[j]), j - int(ends[group[j]]), v, -s) for j, best_ in enumerate(some) for s, v in best_]
        for a in range(0, len(found), 1 << 16):
            cols = zip(*found[a:a + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                                             ["a", "j", "vec_id", "score"])

    return rows.mapInArrow(run, "a int, j int, vec_id long, score long")


def _best(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("a", "j").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _floors(rows: DataFrame, anchors: Anchors, dim: int, share: int, positive, n: int, size: int, place: Callable) -> np.ndarray:
    """Scores that a sample of the rows already reaches n times, for each anchor or positive; the driver gets one number each."""
    floor = np.full(size, -np.inf)
    if share > 1:
        sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0)
        for r in _best(_asked(sample, anchors, dim, positive, floor), n).filter(F.col("rank") == n).toPandas().itertuples():
            floor[place(r.a, r.j)] = r.score
    return floor


def mine(vectors: DataFrame, is_anchor: Callable[[Column], Column], embedding: str = "embedding") -> DataFrame:
    """Hard negatives of the anchors, the rows whose vec_id ``is_anchor`` picks, among all rows of ``vectors``.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor, and each of its
    POSITIVES best other rows of the same label, the NEGATIVES best rows of another label whose score is from LEAST to MOST
    hundredths of the positive's. Scores are integer inner products of floor(SCALE x component); ties go to the smaller vec_id.
    Fewer are returned where there are fewer.

    Rows without vec_id, label or vector, or with a null or non-finite component, take no part; of rows with one vec_id the
    first by label and bytes does. Vectors of different lengths never meet; empty ones score 0. Other columns don't matter.
    No rows, or no anchors, give none.
    """
    spark = vectors.sparkSession
    flat = staged(quantised(vectors, embedding))
    sizes = flat.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_anchor(F.col("vec_id"))).alias("anchors")).filter("anchors > 0").toPandas()
    out = []
    for dim, n, chosen in sizes.itertuples(index=False):
        of = flat.filter(F.col("dim") == int(dim))
        # Ordered by length; ids part equal lengths, so no length is too common for a partition.
        parts = max(spark.sparkContext.defaultParallelism, int(n * (2 * dim + 32) // PART_BYTES))
        rows = staged(of.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"))
        runs = max(int(chosen * 8 * max(int(dim), 1) // RUN_BYTES), int(chosen // RUN_ROWS)) + 1
        share = int(n // PILOT)
        asking = staged(of.filter(is_anchor(F.col("vec_id"))).select("vec_id", "label", "norm", "v", F.pmod(F.xxhash64("vec_id"), F.lit(runs)).alias("run")))
        for run in range(runs):
            got = asking.filter(F.col("run") == run).orderBy("vec_id").toPandas()
            if not len(got):
                continue
            anchors = Anchors(got["vec_id"], got["label"], got["norm"], list(got["v"]), int(dim))
            floor = _floors(rows, anchors, int(dim), share, None, POSITIVES, len(anchors.ids), lambda a, j: a)
            found = _best(_asked(rows, anchors, int(dim), None, floor), POSITIVES).orderBy("a", "rank").toPandas()
            group, score = found["a"].to_numpy(np.int64), found["score"].to_numpy(np.int64)
            if not len(group):
                continue
            begin = np.searchsorted(group, np.arange(len(anchors.ids)))
            floor = _floors(rows, anchors, int(dim), share, (group, score), NEGATIVES, len(group), lambda a, j, b=begin: b[a] + j)
            hard = _best(_asked(rows, anchors, int(dim), (group, score), floor), NEGATIVES)
            pairs = spark.createDataFrame(
                [(int(a), int(j - begin[a]), int(anchors.ids[a]), int(v), int(s)) for j, (a, v, s) in enumerate(zip(group, found["vec_id"], score, strict=True))],
                "a int, j int, anchor_id long, positive_id long, positive_score long")
            hard = hard.join(F.broadcast(pairs), ["a", "j"])
            out.append(staged(hard.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, out)
