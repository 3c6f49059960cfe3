"""Removal of long repeated byte strings by a hash-compared suffix sort.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts anywhere else.

* Only anchored suffixes are sorted. An anchor is a gram of ``GRAM`` bytes whose hash is the least in
  some run of ``LENGTH - GRAM + 1`` neighbouring grams, so every string of ``LENGTH`` bytes holds one, and
  equal strings hold it at the same place. That thins positions out by about 70 and loses no repeat.
* Hashes are prefix polynomials: one pass over a text gives the hash of any part of it in two steps.
* Anchors whose gram occurs once in the corpus are done. A first pass counts grams by their hash alone; those that repeat mark
  a bit each in a field of fixed size, and the second pass lists an anchor only if its bit is set, so what is written
  grows with the repeats, not with the text. A bit set by chance lets an anchor through that the counts drop later.
  Of the anchors whose gram repeats, those whose whole
  surroundings (all strings of ``LENGTH`` around the gram) occur again are done too.
* The rest lie at the edge of a repeat. Their surroundings meet by gram; there the suffixes are put in
  order by a mergesort that compares two of them by the length of their common extension, found by
  binary search over prefix hashes, and neighbours' extensions are checked on the bytes. Strings to the
  left of the gram are told apart by prefix hashes again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled, staged
from .common import chunks, field_of, hash_field, in_field, split_by_field, utf8

LENGTH = 400
GRAM = 256
#: Surroundings of one gram that one task sorts (about 9 MB); grams with more are counted by Spark instead.
GROUP = 16_384
#: Grams handled at once in one text, and context bytes sorted at once in one task.
_PIECE = 1 << 20
_SORTED = 2 << 20
#: Bits of a text's hash by which texts without any repeat are kept out of shuffles.
PREFIX_BITS = 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every prefix, as sums of (byte + 1) times a power of the base."""
    power, _ = _tables(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=out[1:])
    return out


class Joined(NamedTuple):
    """Prefix hashes of short parts laid end to end, each with powers from its own start; ``at`` is the place in the part."""

    sums: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, lengths: np.ndarray) -> Joined:
        ends = np.cumsum(lengths)
        at = np.zeros(len(data) + 1, np.int32)
        at[:-1] = np.arange(len(data)) - np.repeat(ends - lengths, lengths)
        at[-1] = lengths[-1] if len(lengths) else 0
        power, _ = _tables(int(lengths.max()) if len(lengths) else 0)
        sums = np.zeros(len(data) + 1, np.uint64)
        for a in range(0, len(data), _PIECE):
            b = min(len(data), a + _PIECE)
            np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[at[a:b]], out=sums[a + 1:b + 1])
            sums[a + 1:b + 1] += sums[a]
        return cls(sums, at)


def part_hash(prefix: np.ndarray | Joined, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to stop, wherever they lie; lengths must be compared beside it."""
    sums, at = (prefix.sums, prefix.at[start]) if isinstance(prefix, Joined) else (prefix, start)
    _, inverse = _tables(int(at.max()) + 1 if len(at) else 0)
    x = (sums[stop] - sums[start]) * inverse[at]
    x ^= x >> np.uint64(32)
    x *= _MIX
    return x ^ (x >> np.uint64(29))


def _slide(a: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """Least or greatest of every w neighbours: running values from both ends of blocks of w."""
    n = len(a)
    size = -(-n // w) * w
    full = np.full(size, a[-1], a.dtype)
    full[:n] = a
    blocks = full.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).reshape(-1)
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(behind[:n - w + 1], ahead[w - 1:n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one text."""
    grams, w = len(data) - gram + 1, length - gram + 1
    if grams < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, found = [], []
    for a in range(0, grams, _PIECE):
        b = min(grams, a + _PIECE)
        lo, hi = max(0, a - w + 1), min(grams, b + w - 1)
        prefix = prefix_hashes(data[lo:hi + gram - 1])
        start = np.arange(hi - lo)
        h = part_hash(prefix, start, start + gram)
        least = np.zeros(hi - lo + w - 1, np.uint64)
        least[w - 1:hi - lo] = _slide(h, w, np.minimum)
        chosen = np.flatnonzero(_slide(least, w, np.maximum) == h)
        chosen = chosen[(chosen >= a - lo) & (chosen < b - lo)]
        at.append(chosen + lo)
        found.append(h[chosen])
    return np.concatenate(at), np.concatenate(found)


def surroundings(x, n, length: int, gram: int):
    """For grams at x in a text of n bytes: least and greatest distance from the start of a string around it."""
    return np.maximum(0, x + length - n), np.minimum(length - gram, x)


def _repeated_grams(texts: DataFrame, length: int, gram: int) -> np.ndarray:
    """Bit field of the grams that more than one anchor has."""

    def found(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in chunks(iter([batch])):
            yield np.concatenate([anchors(np.frombuffer(t, np.uint8), length, gram)[1] for t in part.column("text").to_pylist()])

    return hash_field(texts.select("text"), found)


def _anchor_rows(texts: DataFrame, length: int, gram: int, field: np.ndarray) -> DataFrame:
    """(c, u, t1, t2, x) of all anchors whose gram's bit is set: hash of the gram and of its surroundings, hashes of the text, position."""
    held = texts.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, field = xxhash.xxh3_64_intdigest, held.value
        for part in chunks(batches):
            out = [[], [], [], [], []]
            for t1, t2, text in zip(*(part.column(k).to_pylist() for k in ("t1", "t2", "text")), strict=True):
                x, c = anchors(np.frombuffer(text, np.uint8), length, gram)
                again = in_field(field, c)
                x, c = x[again], c[again]
                if len(x):
                    lo, hi = surroundings(x, len(text), length, gram)
                    u = [digest(text[a:b], s) for a, b, s in zip((x - hi).tolist(), (x - lo + length).tolist(), (hi * 65536 + lo).tolist(), strict=True)]
                    for col, v in zip(out, (c, np.array(u, np.uint64), np.full(len(x), t1), np.full(len(x), t2, np.int32), x.astype(np.int32)), strict=True):
                        col.append(v)
            if out[0]:
                c, u, t1, t2, x = (np.concatenate(v) for v in out)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (c.view(np.int64), u.view(np.int64), t1, t2, x)], ["c", "u", "t1", "t2", "x"])

    return texts.mapInArrow(run, "c bigint, u bigint, t1 bigint, t2 int, x int")


def _common(data, prefix, a, b, limit) -> np.ndarray:
    """Length of the common extension of suffixes a and b, up to limit, by binary search over prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), limit.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = part_hash(prefix, a, a + mid) == part_hash(prefix, b, b + mid)
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
    return lo


def _before(data, prefix, a, ea, b, eb) -> np.ndarray:
    """Whether suffix a sorts strictly before suffix b."""
    limit = np.minimum(ea - a, eb - b)
    n = _common(data, prefix, a, b, limit)
    over = n == limit
    last = len(data) - 1
    return np.where(over, ea - a < eb - b, data[np.minimum(a + n, last)] < data[np.minimum(b + n, last)])


def suffix_order(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Mergesort of suffixes within groups (rows of a group adjoin): the order as indexes.

    Runs double in every round; a member's place in the merged run is its own offset plus its rank in
    the other run, found by binary search, for all members of all groups at once.
    """
    n = len(start)
    order = np.arange(n)
    first = np.searchsorted(group, group, "left")
    size = np.searchsorted(group, group, "right") - first
    offset = np.arange(n) - first
    width = 1
    while width < (size.max() if n else 0):
        run = offset // width
        other = first + (run ^ 1) * width
        stop = np.minimum(other + width, first + size)
        lo, hi = np.minimum(other, first + size), np.maximum(stop, np.minimum(other, first + size))
        base = lo.copy()
        even = run % 2 == 0
        me_s, me_e = start[order], end[order]
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            s, e = start[order[mid]], end[order[mid]]
            ms, me = me_s[open_], me_e[open_]
            # A member of the left run counts the right members before it; of the right run, the left ones not after it.
            left = even[open_]
            less = np.where(left, _before(data, prefix, s, e, ms, me), ~_before(data, prefix, ms, me, s, e))
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        place = first + (run // 2) * 2 * width + offset % width + (lo - base)
        merged = np.empty_like(order)
        merged[place] = order
        order, width = merged, width * 2
    return order


def repeated_starts(contexts: list[bytes], left: np.ndarray, group: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """For each context, which strings of ``length`` bytes around its gram occur in another of the group.

    ``left`` is where the gram starts in the context. The answer is a mask by distance from a string's
    start to the gram. Rows of a group adjoin.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    lengths = np.array([len(c) for c in contexts])
    ends = np.cumsum(lengths)
    begins = ends - lengths
    prefix = Joined.of(data, lengths)
    gram_at = begins + left
    stops = np.minimum(gram_at + length, ends)
    order = suffix_order(data, prefix, gram_at, stops, group)
    a, b = order[:-1], order[1:]
    limit = np.minimum(stops[a] - gram_at[a], stops[b] - gram_at[b])
    shared = np.where(group[a] == group[b], _common(data, prefix, gram_at[a], gram_at[b], limit), -1)
    for i in np.flatnonzero(shared > 0).tolist():
        x, y, n = gram_at[a[i]], gram_at[b[i]], shared[i]
        if contexts[a[i]][left[a[i]]:left[a[i]] + n] != contexts[b[i]][left[b[i]]:left[b[i]] + n]:
            # Two different parts with one hash: count the bytes.
            u, v = data[x:x + limit[i]], data[y:y + limit[i]]
            shared[i] = int(np.argmin(u == v)) if not (u == v).all() else limit[i]
    w = length - gram
    out = np.zeros((len(contexts), w + 1), bool)
    for d in range(w + 1):
        # Suffixes that share length - d bytes from the gram on are one stretch of the order; of these, compare the d bytes before it.
        stretch = np.concatenate([[0], np.cumsum(shared < length - d)])
        fits = (left[order] >= d) & (stops[order] - gram_at[order] >= length - d)
        at = gram_at[order]
        before = part_hash(prefix, np.where(fits, at - d, at), at)
        rank = np.lexsort((before, stretch, ~fits))
        rank = rank[:int(fits.sum())]
        same = (stretch[rank][1:] == stretch[rank][:-1]) & (before[rank][1:] == before[rank][:-1])
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(rank) else np.zeros(0, bool)
        out[order[rank[twice]], d] = True
    return list(out)


def _runs(mask: np.ndarray, x: int, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges covered by the strings that start at the marked distances before position x."""
    d = np.flatnonzero(mask)
    if len(d):
        for part in np.split(d, np.flatnonzero(np.diff(d) > 1) + 1):
            yield x - int(part[-1]), x - int(part[0]) + length


def _prefixed(texts: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Texts whose hash shares its first bits with one of the keys: at most 2 ** PREFIX_BITS rows are broadcast."""
    bits = lambda c: F.shiftrightunsigned(c, 64 - PREFIX_BITS).cast("int")
    some = keys.select(bits(F.col("t1")).alias("p")).distinct()
    return texts.withColumn("p", bits(F.col("t1"))).join(F.broadcast(some), "p", how).drop("p")


def _open_runs(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(t1, t2, a, b): byte ranges of the repeats at the edges. ``wanted``: (c, t1, t2, x, open, g)."""
    lists = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("c", "x", "open", "g")).alias("at"))
    one = _prefixed(texts, wanted, "left_semi").dropDuplicates(["t1", "t2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = []
            for t1, t2, text, at in zip(*(part.column(k).to_pylist() for k in ("t1", "t2", "text", "at")), strict=True):
                for r in at:
                    lo, hi = surroundings(r["x"], len(text), length, gram)
                    a = r["x"] - int(hi)
                    rows.append((r["c"], r["g"], t1, t2, r["x"], r["open"], int(hi), text[a:r["x"] - int(lo) + length]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 ["c", "g", "t1", "t2", "x", "open", "hi", "context"])

    contexts = staged(one.join(lists.hint("merge"), ["t1", "t2"]).mapInArrow(
        cut, "c bigint, g bigint, t1 bigint, t2 int, x int, open boolean, hi int, context binary"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def settled(rows):
            group = np.array([r[0] for r in rows])
            masks = repeated_starts([r[5] for r in rows], np.array([r[4] for r in rows], np.int64), group, length, gram)
            found = [(r[1], r[2], a, b) for r, m in zip(rows, masks, strict=True) if r[6] for a, b in _runs(m, r[3], length)]
            cols = list(zip(*found, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["t1", "t2", "a", "b"])

        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in ("c", "t1", "t2", "x", "hi", "context", "open")), strict=True):
                if size > _SORTED and r[0] != held[-1][0]:
                    yield settled(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield settled(held)

    small = contexts.filter(F.col("g") <= GROUP).repartition("c").sortWithinPartitions("c")
    sorted_ = small.mapInArrow(sort, "t1 bigint, t2 int, a int, b int")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, t1, t2, x, hi, context, open_ in zip(*(batch.column(k).to_pylist() for k in ("c", "t1", "t2", "x", "hi", "context", "open")), strict=True):
                data = np.frombuffer(context, np.uint8)
                prefix = prefix_hashes(data)
                start = np.arange(len(data) - length + 1)
                h = part_hash(prefix, start, start + length)
                check = np.array([xxhash.xxh3_64_intdigest(context[s:s + length], c & 0xFFFFFFFF) for s in start.tolist()], np.uint64)
                n = len(start)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, c)), pa.array((hi - start).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(check.view(np.int64)),
                    pa.array(np.full(n, t1)), pa.array(np.full(n, t2, np.int32)), pa.array((x - hi + start).astype(np.int32)), pa.array(np.full(n, open_))],
                    ["c", "d", "h", "k", "t1", "t2", "s", "open"])

    # Grams shared by very many different surroundings: strings are counted with a partial sum per task, then looked up.
    large = contexts.filter(F.col("g") > GROUP).select("c", "t1", "t2", "x", "hi", "context", "open")
    strings = large.mapInArrow(spread, "c bigint, d int, h bigint, k bigint, t1 bigint, t2 int, s int, open boolean")
    key = ["c", "d", "h", "k"]
    twice = strings.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    counted = strings.filter("open").join(twice, key).select("t1", "t2", F.col("s").alias("a"), (F.col("s") + length).alias("b"))
    return sorted_.unionByName(counted)


def _texts(docs: DataFrame, text: str, keep: list) -> DataFrame:
    t = F.col(text)
    return docs.select(*keep, F.xxhash64(t).alias("t1"), F.hash(t).alias("t2"), utf8(t).alias("text"))


def repeated_ranges(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(t1, t2, ranges) of every text with a repeated string; a range is (a, b), or (x, -1) for all strings around the gram at x."""
    return settled(lambda: _ranges(_texts(docs, text, []), length, gram))


def _ranges(texts: DataFrame, length: int, gram: int) -> DataFrame:
    # Written, so that the join deals its rows anew and a gram that a third of the rows share can be split.
    rows = staged(_anchor_rows(texts, length, gram, _repeated_grams(texts, length, gram)))
    kinds = staged(rows.groupBy("c", "u").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "x")).alias("at")))
    edges = staged(kinds.groupBy("c").agg(F.count("*").alias("g"), F.bool_or(F.col("n") == 1).alias("any")).filter("any and g > 1").select("c", "g"))
    # Only what bit fields can't settle meets by the whole hash: kinds whose gram may be an edge, and rows that may be alone in their kind.
    some, _ = split_by_field(kinds, "c", field_of(edges.select("c")))
    wanted = staged(some.join(edges, "c").select("c", "at.*", (F.col("n") == 1).alias("open"), "g"))
    alone = field_of(kinds.filter("n = 1").select("u"))
    asked, again = split_by_field(rows, "u", alone)
    asked = asked.join(split_by_field(kinds.filter("n > 1"), "u", alone)[0].select("c", "u"), ["c", "u"])
    done = again.unionByName(asked.select(*again.columns)).select("t1", "t2", F.col("x").alias("a"), F.lit(-1).alias("b"))
    found = done.unionByName(_open_runs(texts, wanted, length, gram))
    return found.groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def _whole_words(text: bytes, a: int, b: int) -> int:
    """Words of a text that lie whole between a and b."""
    n = len(text[a:b].split())
    for edge in {a, b}:
        if 0 < edge < len(text) and not text[edge - 1:edge].isspace() and not text[edge:edge + 1].isspace():
            n -= 1
    return n


def cut(text: bytes, ranges: list[dict], length: int, gram: int, over: int = 0) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that stay, and the maximal removed runs: of over ``over`` whole words, or ``LENGTH`` bytes, where that is given."""
    spans = []
    for r in ranges:
        if r["b"] < 0:
            lo, hi = surroundings(r["a"], len(text), length, gram)
            spans.append((r["a"] - int(hi), r["a"] - int(lo) + length))
        else:
            spans.append((r["a"], r["b"]))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    if over:
        merged = [(a, b) for a, b in merged if b - a >= LENGTH or _whole_words(text, a, b) > over]
    kept, at = [], 0
    for a, b in merged:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), merged


def dedupe(docs: DataFrame, text: str = "text", keep: list[str] | None = None, with_text: bool = True, length: int = LENGTH, gram: int = GRAM,
           over: int = 0) -> DataFrame:
    """Rows of ``docs`` without the bytes that repeats cover.

    Adds n_bytes, n_removed, n_spans and kept_sha256 and, ``with_text``, replaces the text by what is left
    (bytes of a character cut in two are left out). ``keep`` names the other columns to return (all if
    None); columns with the added names are replaced. With ``over``, covered runs of so many words or fewer, and under
    ``LENGTH`` bytes, stay. Repeats are found on the input, in the same or another
    row, and a repeated row is a repeat of itself: of equal texts of ``length`` bytes or more none keeps a
    byte. Null and empty texts have no bytes, a null text stays null; shorter texts stay as they are. No rows
    give none.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*added, text)]
    ranges = repeated_ranges(docs, text, length, gram)
    texts = _texts(docs, text, [F.struct(*[F.col(c) for c in keep]).alias("row") if keep else F.lit(0).alias("row"), F.col(text).isNull().alias("missing")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            out = []
            for t, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                left, spans = cut(t, ranges or [], length, gram, over)
                out.append((len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True))], ["row", *added, "text"])

    some = _prefixed(texts, ranges, "left_semi").join(ranges.hint("merge"), ["t1", "t2"], "left").select("row", "text", "ranges")
    kind = some.schema["row"].dataType.simpleString()
    some = some.mapInArrow(run, f"row {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string")
    other = _prefixed(texts, ranges, "left_anti").select(
        "row", F.length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), (F.when(~F.col("missing"), F.col("text").cast("string")) if with_text else F.lit(None).cast("string")).alias("text"))
    both = some.unionByName(other)
    cols = [F.col("row")[c].alias(c) for c in keep]
    return both.select(*cols, *added, *([F.col("text").alias(text)] if with_text else []))
