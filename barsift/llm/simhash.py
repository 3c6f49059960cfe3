"""Near-duplicates by SimHash, with pigeonring candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled, staged
from .common import chunks, split_by_hash, unused, utf8

SHINGLE = 3
SEED = 42
DIFFER = 2
#: The ring: three segments of the 64 bits, as (first bit, width).
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Bucket members that are compared pair by pair; larger buckets are linked through masks instead.
PAIRED = 256
#: Copies of each lookup row, so that one hot fingerprint is joined by several tasks.
SALTS = 16


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text: a bit is 1 if it is set in over half of the shingles' hashes."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    k = min(words, len(tokens))
    stops = ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=False)], np.uint64))


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE) -> DataFrame:
    """(doc_id, t, fp): a hash of the text, and the 64 bits of the whole text as a signed long; 0 where it has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            fp = [fingerprint(t, words) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("t"), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "t", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("t"), utf8(F.col(text)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, t bigint, fp bigint")


def _bits(first: int, width: int) -> int:
    return ((1 << width) - 1) << first


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DIFFER


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints at ``DIFFER`` = 2 or fewer differing bits.

    Pigeonring: of three segments in a ring whose differences add up to at most 2, one starts a
    chain whose running differences stay within 2/3, 4/3 and 2, that is 0, at most 1, at most 2.
    The first two links of that chain are a hash key: the first segment as it is and the second
    with one bit masked, 43 - 1 bits, so buckets stay small at any corpus size. A fingerprint has 64
    keys, one per masked bit. The last link, the whole Hamming distance, is checked on the pairs.

    A bucket of over ``PAIRED`` members is not paired. Its members get keys with a further bit of
    the third segment masked (or two, where the second agrees); all that share such a key differ by
    at most 2 bits, so each is linked to the least of them. That joins the same components, in
    proportion to the bucket.
    """
    keys = []
    for s, (first, width) in enumerate(SEGMENTS):
        before = SEGMENTS[(s + 2) % 3]
        for bit in range(first, first + width):
            keys.append((bit, (_bits(*before) | _bits(first, width)) & ~(1 << bit)))
    cells = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("m")) for t, m in keys])
    spread = prints.select("fp", F.explode(cells).alias("c")).select("fp", "c.t", "c.m")
    bucket = Window.partitionBy("t", "m")
    shared = staged(spread.withColumn("n", F.count("*").over(bucket)).filter("n > 1"))

    # A pair meets under the bit in which the second segments differ, or, where they agree, under their lowest bit.
    small = shared.filter(F.col("n") <= PAIRED)
    left, right = small.select("t", "m", F.col("fp").alias("a")), small.select("t", "m", F.col("fp").alias("b"))
    lowest = F.col("t").isin([first for first, _ in SEGMENTS])
    differ = F.getbit(F.col("a").bitwiseXOR(F.col("b")), F.col("t").cast("int")) == 1
    second = F.lit(0).cast("long")
    for first, width in SEGMENTS:
        second = F.when(F.col("t").between(first, first + width - 1), F.lit(_signed(_bits(first, width)))).otherwise(second)
    agree = F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(second) == 0
    pairs = left.join(right, ["t", "m"]).filter(
        (F.col("a") < F.col("b")) & _near("a", "b") & (differ | (lowest & agree))).select("a", "b")

    # Masks of the third segment for the large buckets.
    masks = []
    for s, (first, width) in enumerate(SEGMENTS):
        start, stop = SEGMENTS[(s + 1) % 3][0], sum(SEGMENTS[(s + 1) % 3])
        one = [~(1 << q) for q in range(start, stop)]
        two = [~(1 << p | 1 << q) for p in range(start, stop) for q in range(p)]
        to_array = lambda ms: F.array(*[F.lit(_signed(x & (1 << 64) - 1)) for x in ms])
        at = F.col("t").between(first, first + width - 1)
        masks.append((at, to_array(one), F.when(F.col("t") == first, to_array(two))))
    large = shared.filter(F.col("n") > PAIRED)
    stars = None
    for at, one, two in masks:
        # "open": the second segment's bit t may differ; "fixed": it may not, so two bits of the third may.
        rows = large.filter(at)
        open_ = rows.select("fp", "t", F.concat(F.lit("o"), F.col("t").cast("string")).alias("k"), F.explode(one).alias("mask"))
        open_ = open_.select("fp", "k", "mask", F.expr("fp & mask & ~shiftleft(1L, cast(t as int))").alias("v"))
        fixed = rows.filter(two.isNotNull()).select("fp", F.lit("f").alias("k"), F.explode(two).alias("mask"))
        fixed = fixed.select("fp", "k", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("v"))
        both = open_.unionByName(fixed)
        stars = both if stars is None else stars.unionByName(both)
    hub = F.min("fp").over(Window.partitionBy("k", "mask", "v"))
    stars = stars.select("fp", hub.alias("hub")).filter("hub < fp").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected edge list (a, b); root is the least node reachable.

    Each round takes the least label among the neighbours and then the label of that label, and is
    written to the shared folder, so a lost executor costs one round. The rounds needed grow with
    the logarithm of a component's diameter in common cases; the driver sees only counts.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        by_b = labels.select(F.col("node").alias("b"), "root")
        least = both.join(by_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(least, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = staged(step.join(up, "root").select("node", "was", F.least("root", "next").alias("root")))
        changed = step.filter("root < was").limit(1).count()
        labels = step.select("node", "root")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id.

    ``component_id`` is the smallest id reachable over links of at most two differing bits, the
    row's own included. Equal fingerprints are one node with its smallest id, so copies are never
    expanded into pairs. Texts without a word (null, empty, blank) have fingerprint zero and link
    like any other. A null id is kept on its row and never chosen; a component of null ids alone has
    a null component. Repeated rows give repeated rows. No rows give none.
    """
    return _judged(docs, text, doc_id).drop("t")


def _judged(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = staged(fingerprints(docs, text, doc_id))
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp")))
    joined = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    group = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    grouped = roots.join(group, "root").select(F.col("node").alias("fp"), "component_id")
    looked = nodes.join(grouped.withColumn("_in", F.lit(True)), "fp", "left").select(
        "fp", F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    # A hot fingerprint may hold a third of the rows: its lookup row is copied and its rows are dealt over the copies.
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    looked = looked.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(looked.hint("merge"), ["fp", "_salt"]).select(
        "doc_id", "t", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", judge: Callable[..., DataFrame] = _judged) -> DataFrame:
    """``docs`` with one row of each component that ``judge`` finds: that of its smallest id; all columns as they are.

    Of repeated rows with that id one stays, the first by the text's bytes. Of a component whose ids are all null
    one row per different text stays.
    """
    judged = settled(lambda: judge(docs, text, doc_id))
    again = judged.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n")).filter("n > 1 or _id is null").select("_id")
    again = staged(again)
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Documents none of whose id's first hash bits go stay where they are; the others meet the ids that go.
    hid = unused("_hid", docs)
    gone = staged(judged.filter(~same & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).unionByName(again).distinct().withColumn(
        hid, F.xxhash64("_id")))
    maybe, stay = (part.drop(hid) for part in split_by_hash(docs.withColumn(hid, F.xxhash64(doc_id)), hid, gone, hid))
    left = gone.drop(hid).hint("merge")
    once = stay.unionByName(maybe.join(left, maybe[doc_id].eqNullSafe(left["_id"]), "left_anti"))
    # Ids that occur again: one row of each, by its text; of rows without id, one of each text.
    stays = judged.filter(same).join(again, judged["doc_id"].eqNullSafe(again["_id"]), "left_semi")
    stays = staged(stays.select(F.col("doc_id").alias("_id"), "t").distinct())
    rows = docs.join(stays, docs[doc_id].eqNullSafe(stays["_id"]) & (F.xxhash64(docs[text]) == stays["t"]), "left_semi")
    kept = docs.columns
    keyed = rows.select(F.col(doc_id).alias("_id"), F.when(F.col(doc_id).isNull(), F.col(text)).alias("_text"),
                        F.struct(F.col(text).alias("_by"), F.struct(*kept).alias("_row")).alias("_one"))
    return once.unionByName(keyed.groupBy("_id", "_text").agg(F.min("_one").alias("_one")).select("_one._row.*"))
