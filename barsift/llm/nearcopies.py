"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them.

SimHash comes first: fingerprints of the sets that link at two bits form groups, and members are checked against the
first of their group on the whole sets. What is confirmed is one component from then on.

A bound on 64 fingerprint bits that is wide enough for that similarity (about 17) leaves no selective key, so the
candidates that two bits miss come from the shingles themselves, between different components only. In any one order of all shingles, two such sets share one among the
first fifth of each (prefix filter), and the first they share lies early in both (position filter). The order is by
how often a shingle occurs, so common passages come last; it is read from counters of fixed size, which
may err without losing a pair, as every order will do. Candidates are checked on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import chunks, hash_field, in_field, split_by_hash, utf8
from .simhash import PAIRED, SALTS, components, links, majority

WORDS = 5
#: Counters of shingles, as bits of their hash; only the order of shingles depends on them.
COUNTER_BITS = 20
_BLOCK = 1 << 15
#: Longs of a set's parity bits: bit b is set if an odd number of its shingles falls on b.
PARITIES = 8
#: Bytes of sets that a task keeps while it compares pairs.
_KEPT = 32 << 20


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted different hashes of all runs of ``words`` words; one of all words where there are fewer, none without words."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    stops = ends[min(words, len(tokens)) - 1:].tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, stops, strict=False)], np.uint64))


def _node(s: np.ndarray) -> int:
    """Equal sets are one node."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else 0


def _parities(s: np.ndarray) -> bytes:
    """Parity bits. Two sets differ in at least as many shingles as their parity bits differ."""
    return np.packbits(np.bincount((s & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1).tobytes()


def _counters(texts: DataFrame) -> np.ndarray:
    """How many texts hold the shingles of each counter; the driver gets ``2 ** COUNTER_BITS`` numbers."""
    shift, size = np.uint64(64 - COUNTER_BITS), 1 << COUNTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(size, np.int64), False
        for part in chunks(batches):
            any_row = True
            found = [shingles(t) >> shift for t in part.column("text").to_pylist()]
            np.add.at(total, np.concatenate(found).astype(np.int64), 1)
        for i in range(0, size if any_row else 0, _BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([i // _BLOCK], pa.int32()), pa.array([total[i:i + _BLOCK].tobytes()])], ["block", "held"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("held").to_pylist(), strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(x, np.int64)
        for b, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.tobytes()])], ["block", "held"])

    kind = "block int, held binary"
    out = np.zeros(size, np.int64)
    for b, x in texts.select("text").mapInArrow(run, kind).repartition("block").mapInArrow(add, kind).toPandas().itertuples(index=False):
        out[b * _BLOCK:(b + 1) * _BLOCK] = np.frombuffer(x, np.int64)
    return out


def _prefixes(texts: DataFrame, counters: np.ndarray) -> DataFrame:
    """(doc_id, t, node, fp, bits, size, prefix): the set's fingerprint, its parity bits, and the shingles by which a set of that size must meet its near copies, in order."""
    held = texts.sparkSession.sparkContext.broadcast(counters)
    shift = np.uint64(64 - COUNTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            node, prints, bits, size, prefix = [], [], [], [], []
            for t in part.column("text").to_pylist():
                s = shingles(t)
                n = len(s)
                first = np.lexsort((s, held.value[(s >> shift).astype(np.int64)]))[:n - (4 * n + 4) // 5 + 1 if n else 0]
                node.append(_node(s))
                prints.append(majority(s))
                bits.append(np.frombuffer(_parities(s), np.int64))
                size.append(n)
                prefix.append(s[first].view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(node, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)),
                                              pa.array(bits, pa.list_(pa.int64())), pa.array(size, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))],
                                             ["doc_id", "t", "node", "fp", "bits", "size", "prefix"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, t bigint, node bigint, fp bigint, bits array<bigint>, size int, prefix array<bigint>")


def _may(na: Column, i: Column, nb: Column, j: Column) -> Column:
    """Whether sets of these sizes, whose first common shingle is at these places, can reach the similarity."""
    return 9 * F.least(na - i, nb - j) >= 4 * (na + nb)


def _met(found: DataFrame) -> DataFrame:
    """(node, size, at, prefix) without the shingles that no other row has in its prefix; ``at`` is their place. Copies may keep theirs."""

    def listed(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column("prefix").flatten().to_numpy().view(np.uint64)]

    held = found.sparkSession.sparkContext.broadcast(hash_field(found.select("prefix"), listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("prefix").value_lengths().to_numpy().astype(np.int64)
            h = listed(batch)[0]
            again, starts = in_field(held.value, h), np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(lengths)), lengths)[again]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(lengths)))]), pa.int32())
            at = (np.flatnonzero(again) - starts[owner]).astype(np.int32)
            out = pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), pa.ListArray.from_arrays(ends, pa.array(at)),
                                              pa.ListArray.from_arrays(ends, pa.array(h[again].view(np.int64)))], ["node", "size", "at", "prefix"])
            yield out.filter(pa.array(np.diff(ends.to_numpy()) > 0))

    return found.select("node", "size", "prefix").mapInArrow(run, "node bigint, size int, at array<int>, prefix array<bigint>")


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of 0.8 or more."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    asked = staged(nodes.join(asked, "node", "left_semi").select("node", "t"))
    # Only texts that may be asked for are shuffled, whatever the table's size; texts, as they take less than their sets.
    near, _ = split_by_hash(texts.select("t", "text"), "t", asked, "t")
    held = staged(near.dropDuplicates(["t"]).join(asked.hint("merge"), "t").select("node", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            out = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for i, pair in enumerate(zip(a, b, strict=True)):
                if size > _KEPT:
                    sets, size = {}, 0
                for node, text in zip(pair, ("x", "y"), strict=True):
                    if node not in sets:
                        sets[node] = shingles(batch.column(text)[i].as_py())
                        size += sets[node].nbytes
                x, y = (sets[node] for node in pair)
                out.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    both = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(
        held.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def by_fingerprint(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): each node whose fingerprint links it to a group, with the group's first node, where their sets reach the similarity."""
    prints = staged(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    groups = components(links(prints.select("fp"))).withColumnRenamed("node", "fp")
    placed = nodes.select("node", "fp").join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    pairs = placed.join(prints.select(F.col("fp").alias("root"), "first"), "root").filter("first != node")
    return _confirmed(staged(pairs.select(F.col("first").alias("a"), F.col("node").alias("b"))), nodes, texts)


def _linked(found: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have a near copy."""
    close = staged(by_fingerprint(nodes, texts))
    rows = _met(found).dropDuplicates(["node"])
    rows = rows.join(close.select(F.col("b").alias("node"), F.col("a").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = rows.select("node", "root", "size", F.explode(F.arrays_zip(F.col("at").alias("i"), F.col("prefix").alias("h"))).alias("_at")).select("node", "root", "size", "_at.i", "_at.h")
    bucket = Window.partitionBy("h")
    apart = F.min("root").over(bucket) < F.max("root").over(bucket)
    hub = F.min(F.struct("node", "root", "size", "i")).over(bucket).alias("hub")
    many = (F.count("*").over(bucket) > PAIRED).alias("many")
    shared = staged(rows.select("*", apart.alias("apart"), hub, many).filter("apart").drop("apart"))
    # First each member with the least of its bucket: in a large group of near copies that links nearly all.
    far = (F.col("hub.root") != F.col("root")) & _may(F.col("hub.size"), F.col("hub.i"), F.col("size"), F.col("i"))
    stars = staged(shared.filter(far).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct())
    edges = staged(close.unionByName(_confirmed(stars, nodes, texts)))
    # Then all pairs of a bucket that aren't in one component yet. In large buckets a pair meets once, under the first shingle of a large
    # bucket that both have, and only if its parity bits differ in no more places than sets of that similarity may differ in shingles.
    joined = shared.select("node", "size", "i", "h", "many").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = joined.join(nodes.select("node", "bits"), "node").withColumn("bits", F.when(F.col("many"), F.col("bits")))
    earlier = F.collect_list(F.when(F.col("many"), F.col("h"))).over(Window.partitionBy("node").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    joined = joined.withColumn("before", F.when(F.col("many"), earlier)).drop("many")
    left = staged(joined.withColumn("apart", apart).filter("apart").drop("apart"))
    x, y = (left.select("h", *[F.col(c).alias(c + k) for c in ("node", "size", "i", "root", "bits", "before")]) for k in "ab")
    differ = sum(F.bit_count(F.col("bitsa")[k].bitwiseXOR(F.col("bitsb")[k])) for k in range(PARITIES))
    once = ~F.coalesce(F.arrays_overlap("beforea", "beforeb"), F.lit(False))
    pairs = x.join(y, "h").filter((F.col("nodea") < F.col("nodeb")) & (F.col("roota") != F.col("rootb")) & _may(
        F.col("sizea"), F.col("ia"), F.col("sizeb"), F.col("ib")) & F.coalesce(9 * differ <= F.col("sizea") + F.col("sizeb"), F.lit(True)) & once)
    pairs = pairs.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()
    pairs = staged(pairs.join(stars, ["a", "b"], "left_anti"))
    return components(edges.unionByName(_confirmed(pairs, nodes, texts)))


def judged(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, t, component_id) of every row: a hash of its text, and the least id that near copies lead to.

    Texts with the same shingles are one node, so copies are never paired. Texts without a word are
    one node. Null ids are never chosen.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("t"), utf8(F.col(text)).alias("text"))
    found = staged(_prefixes(texts, _counters(texts)))
    nodes = staged(found.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("t").alias("t"), F.first("fp").alias("fp"), F.first("bits").alias("bits")))
    roots = staged(_linked(found, nodes, texts))
    ids = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = staged(ids.groupBy("root").agg(F.min("least").alias("component_id")))
    looked = ids.join(groups, "root").select("node", "component_id")
    salted = found.select("doc_id", "t", "node", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    looked = looked.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(looked.hint("merge"), ["node", "_salt"]).select("doc_id", "t", "component_id")
