"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Rows that the tree is fitted on, children of a node, and rows of the sample below which a node is a leaf.
SAMPLE = 20_000
BRANCH = 8
LEAF = 256
#: Queries that calibrate, and the recall that is asked of them.
CALIBRATION = 128
RECALL = 0.97
#: Rows of a block, the unit that is compared: neighbouring small leaves share one, large leaves are split.
BLOCK = 4_096
#: Queries that are compared with a block at once.
QUERIES = 4_096
_ROUNDS = 8


class Tree:
    """Centroids of all nodes, children of the inner ones, and the number of each leaf."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.centroids: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self._grow(vectors, vectors.mean(0) if len(vectors) else np.zeros(0), rng)

    def _grow(self, x: np.ndarray, centre: np.ndarray, rng) -> int:
        me = len(self.centroids)
        self.centroids.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        parts = self._split(x, rng) if len(x) > LEAF else []
        if len(parts) < 2:
            self.leaf[me] = self.leaves
            self.leaves += 1
        else:
            self.children[me] = [self._grow(p, p.mean(0), rng) for p in parts]
        return me

    @staticmethod
    def _split(x: np.ndarray, rng) -> list[np.ndarray]:
        c = x[rng.choice(len(x), BRANCH, replace=False)]
        for _ in range(_ROUNDS):
            near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
            c = np.stack([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(BRANCH)])
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        return [x[near == k] for k in range(BRANCH) if (near == k).any()]

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row, down the nearest children."""
        out = np.zeros(len(x), np.int64)

        def down(node, rows):
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                return
            kids = self.children[node]
            c = np.stack([self.centroids[k] for k in kids])
            near = (x[rows] @ c.T - (c * c).sum(1) / 2).argmax(1)
            for i, k in enumerate(kids):
                if len(of := rows[near == i]):
                    down(k, of)

        down(0, np.arange(len(x)))
        return out

    def best_first(self, q: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves in the order of a queue of open nodes, the largest product with the query first."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                continue
            kids = self.children[node]
            products = np.stack([self.centroids[k] for k in kids]) @ q
            for k, p in zip(kids, products.tolist(), strict=True):
                heapq.heappush(queue, (-p, k))
        return found


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: no null, zero or partly null vector, no NaN or infinity."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _top(queries: np.ndarray, qids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of a block for each query, itself left out; ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    longest = np.linalg.norm(x, axis=1).max()
    out_q, out_v, out_s = [], [], []
    for a in range(0, len(qids), 256):
        s = queries[a:a + 256] @ x.T
        own = qids[a:a + 256]
        s[own[:, None] == ids[None, :]] = -np.inf
        if s.shape[1] > k:
            bar = -np.partition(-s, k - 1, axis=1)[:, k - 1:k]
        else:
            bar = np.full((len(own), 1), -np.inf)
        # A little under the bar, by what sums of products may round, so that the later exact product decides ties.
        slack = 1e-12 * np.linalg.norm(queries[a:a + 256], axis=1, keepdims=True) * longest
        r, c = np.nonzero((s >= bar - slack) & (s > -np.inf))
        rank = np.lexsort((ids[c], -s[r, c], r))
        r, c = r[rank], c[rank]
        start = np.searchsorted(r, r, "left")
        exact = np.einsum("ij,ij->i", queries[a:a + 256][r], x[c])
        rank = np.lexsort((ids[c], -exact, r))
        keep = rank[(np.arange(len(r)) - start) < k]
        out_q.append(own[r[keep]])
        out_v.append(ids[c[keep]])
        out_s.append(exact[keep])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query. A query has at most k rows from each block it visited."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_FOUND = "query_id bigint, vec_id bigint, score double"


def _dealt(sizes: dict[int, int], leaves: int, room: int) -> tuple[dict[int, int], dict[int, int]]:
    """First bin and number of bins of each leaf. Neighbouring small leaves share a bin of about ``room`` rows, large leaves are split."""
    first, count, at, left = {}, {}, 0, room
    for leaf in range(leaves):
        n = sizes.get(leaf, 0)
        if n > left and left < room:
            at, left = at + 1, room
        first[leaf], count[leaf] = at, max(1, -(-n // room))
        if n >= room:
            at, left = at + count[leaf], room
        else:
            left -= n
    return first, count


def _binned(placed: DataFrame, sizes: dict[int, int], leaves: int, room: int, name: str) -> DataFrame:
    """Rows with the bin that their leaf and the hash of their id give them. The table of leaves is bounded by the tree's sample."""
    first, count = _dealt(sizes, leaves, room)
    table = placed.sparkSession.createDataFrame([(leaf, first[leaf], count[leaf]) for leaf in range(leaves)], "leaf bigint, first int, count int")
    at = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("count")).cast("int")
    return placed.join(F.broadcast(table), "leaf").select(at.alias(name), "vec_id", "v")


def copied(blocked: DataFrame, sought: DataFrame) -> DataFrame:
    """Rows of each block, once for each run that visits the block: (block, run, vec_id, v)."""
    # Aliases tell these columns from those of the queries that they meet.
    wanted = sought.select(F.col("run").alias("run"), F.explode("blocks").alias("block")).distinct()
    return blocked.join(wanted.hint("merge"), "block").select(F.col("block").alias("block"), F.col("run").alias("run"), "vec_id", "v")


def exhaustive(queries: list, rows: DataFrame, k: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries among all rows, block by block."""
    held = rows.sparkSession.sparkContext.broadcast((np.array([q for q, _ in queries]), np.array([v for _, v in queries])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = held.value
        for batch in batches:
            if batch.num_rows:
                cols = _top(q, qids, _matrix(batch.column("v")), batch.column("vec_id").to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    return _best(rows.select("vec_id", "v").mapInArrow(run, _FOUND), k)


def search(rows: DataFrame, is_query, k: int = 20, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k nearest found by inner product.

    ``is_query`` is a condition on ``vec_id``. The tree is fitted on a bounded sample of at most
    ``SAMPLE`` different vectors (those with the least hashes) and every row is then placed in a leaf.
    Rows are compared in blocks of about ``BLOCK``: a visited leaf brings its block, with the leaves
    beside it, or its blocks, if it is large; each block gives a query at most k rows. Products rank vectors of
    unequal length as well: the queue takes the largest product with a centroid first. Leaf visits
    are widened until ``CALIBRATION`` queries, compared with all rows by brute force, reach ``recall``;
    so many leaves are visited for every query. Scores are double precision on the given vectors, ties go to
    the smaller id.

    Equal vectors can't be told apart by a query: of each group the k + 1 smallest ids are candidates,
    which loses nothing and keeps one hot vector from filling a leaf. Rows whose vector is null, empty,
    zero, or holds a null or non-finite number take no part, nor do null ids. Repeated ids are
    one candidate each time but never their own query's. No queries or no rows give no rows. Vectors of
    different lengths raise an error.
    """
    good = staged(usable(rows, vec_id, embedding))
    spark = good.sparkSession
    sizes = [r[0] for r in good.select(F.size("v")).distinct().limit(2).collect()]
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if len(sizes) > 1:
        raise ValueError("vectors of different lengths")
    key = F.xxhash64("v")
    # Each task hands on its k + 1 smallest ids of a vector before the shuffle.
    part = Window.partitionBy("v").orderBy("vec_id")
    distinct = staged(good.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= k + 1))
    one = distinct.filter("_n = 1")
    sample = one.orderBy(key, "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    tree = Tree(_matrix(sample))
    held = spark.sparkContext.broadcast(tree.__dict__)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tree.__new__(Tree)
        t.__dict__ = held.value
        for batch in batches:
            leaf = t.place(_matrix(batch.column("v"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf)], ["vec_id", "v", "leaf"])

    placed = staged(distinct.select("vec_id", "v").mapInArrow(place, "vec_id bigint, v array<double>, leaf bigint"))
    # One row per leaf, and the tree's sample bounds the leaves.
    sizes = dict(placed.groupBy("leaf").agg(F.count("*").alias("n")).collect())
    first, count = _dealt(sizes, tree.leaves, BLOCK)
    blocked = staged(_binned(placed, sizes, tree.leaves, BLOCK, "block"))

    queries = good.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min_by("v", key).alias("v"))
    trial = [(r[0], r[1]) for r in queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).collect()]
    if not trial:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    truth = exhaustive(trial, distinct, k).join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toPandas()
    vectors = dict(trial)
    place_of = {q: {leaf: i for i, leaf in enumerate(tree.best_first(np.array(v), tree.leaves))} for q, v in vectors.items()}
    needed = np.sort([place_of[q][leaf] + 1 for q, leaf in truth.itertuples(index=False)])
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1

    # Queries of neighbouring leaves form a run, so that a run visits few blocks, and a block is copied only to runs that visit it.
    asked = staged(queries.select("vec_id", "v").mapInArrow(place, "vec_id bigint, v array<double>, leaf bigint"))
    runs = _binned(asked, dict(asked.groupBy("leaf").agg(F.count("*").alias("n")).collect()), tree.leaves, QUERIES, "run")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tree.__new__(Tree)
        t.__dict__ = held.value
        for batch in batches:
            of = [sorted({first[leaf] + i for leaf in t.best_first(q, visits) for i in range(count[leaf])}) for q in _matrix(batch.column("v"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "run")), pa.array(of, pa.list_(pa.int32()))],
                                             ["query_id", "q", "run", "blocks"])

    sought = staged(runs.mapInArrow(visit, "query_id bigint, q array<double>, run int, blocks array<int>"))
    visited = sought.withColumn("block", F.explode("blocks")).drop("blocks")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            cols = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            cols = _top(_matrix(left.column("q").combine_chunks()), left.column("query_id").to_numpy(),
                        _matrix(right.column("v").combine_chunks()), right.column("vec_id").to_numpy(), k)
        return pa.table([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    pairs = visited.groupBy("block", "run").cogroup(copied(blocked, sought).groupBy("block", "run")).applyInArrow(compare, _FOUND)
    return _best(pairs, k)
