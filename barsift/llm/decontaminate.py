"""Benchmark decontamination by template windows and slot consistency."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled, staged
from .common import chunks, utf8

#: Tokens of a window; an item with fewer has one window, of its own length.
WINDOW = 8
#: Template windows with fewer words that are no slot are not looked for; such windows match word for word alone.
LEAST = 5
#: Windows of an item that a document must share (all, where it has fewer): 13 tokens in a row.
MATCHED = 6
#: Bits of the filter that documents pass before the join: 2 MB, whatever the benchmark's size.
FILTER_BITS = 24
#: Words that are units after a number.
UNITS = frozenset("""
mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t gram grams kilogram kilograms lb lbs pound pounds
oz ounce ounces ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days
week weeks month months year years cent cents dollar dollars euro euros usd eur percent % ° degree degrees meter meters metre
metres kilometer kilometers kilometre kilometres centimeter centimeters mph kmh w kw watt watts v volt volts hz khz mhz
""".split())
#: Words that are numbers.
NUMBERS = frozenset("""
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
""".split())
_WORD, _NUMBER, _UNIT, _CAPITAL, _MARK = range(5)
_TYPED = {k: np.uint64(xxhash.xxh3_64_intdigest(b"\x00" + name)) for k, name in ((_NUMBER, b"number"), (_UNIT, b"unit"), (_CAPITAL, b"name"))}
_DIGITS = re.compile(r"[+-]?[\d.,:/-]*\d[\d.,:/-]*(?:st|nd|rd|th|%)?$")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Scripts without spaces (U+3000 to U+9FFF, Thai, Lao, further ideographs): each character is a token.
_UNSPACED = re.compile(rb"[\xe3-\xe9][\x80-\xbf]{2}|\xe0[\xb8-\xbb][\x80-\xbf]|\xf0[\xa0-\xb3][\x80-\xbf]{2}")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_REMEMBERED = 300_000
#: Text bytes handled at once; some twenty numbers a token are held beside them.
_CHUNK = 512 << 10


class Tokens:
    """Canonical form of the tokens that a task has met."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self._hash, self._kind, self._ends = array("Q"), array("b"), array("b")

    def number(self, raw: bytes) -> int:
        i = self.index.get(raw)
        if i is None:
            text = raw.decode("utf-8", "replace")
            plain = _EDGE.sub("", text)
            low = plain.lower()
            if not plain:
                kind = _MARK
            elif _DIGITS.match(plain) or low in NUMBERS:
                kind = _NUMBER
            elif low in UNITS:
                kind = _UNIT
            else:
                kind = _CAPITAL if plain[0].isupper() and plain[1:].islower() else _WORD
            i = self.index[raw] = len(self._kind)
            self._hash.append(xxhash.xxh3_64_intdigest(low.encode()))
            self._kind.append(kind)
            self._ends.append(text[-1:] in ".!?:" or text[-2:-1] in tuple(".!?"))
        return i

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self._hash, np.uint64), np.array(self._kind, np.int8), np.array(self._ends, bool)


def _powered(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    total = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        total += h[j:j + n] * np.uint64(pow(int(_BASE), j, 1 << 64))
    total ^= total >> np.uint64(29)
    return total * _BASE


def windows(texts: list[bytes], tokens: Tokens, widths: list[int]) -> Iterator[tuple]:
    """For each width: owner, position, template hash, literal hash and valid flag of all windows, then slots.

    Numbers, units after a number, and capitalised words inside a sentence are slots. The template
    hash sees a slot's type, the literal hash its word; case and marks around words count in neither.
    A line end ends a sentence.
    """
    number, ids, owner = tokens.number, [], []
    for i, t in enumerate(texts):
        if not t.isascii():
            t = _UNSPACED.sub(rb" \g<0> ", t)
        of = [number(w) for w in t.replace(b"\n", b" . ").split()]
        ids += of
        owner += [i] * len(of)
    if not ids:
        return
    ids, owner = np.array(ids), np.array(owner)
    h, kind, ends = (x[ids] for x in tokens.arrays())
    starts = np.concatenate([[True], ends[:-1] | (owner[1:] != owner[:-1])])
    kept = kind != _MARK
    h, kind, starts, owner = h[kept], kind[kept], starts[kept], owner[kept]
    if not len(h):
        return
    after_number = np.concatenate([[False], (kind[:-1] == _NUMBER) & (owner[1:] == owner[:-1])])
    slot = np.where(kind == _NUMBER, _NUMBER, np.where((kind == _UNIT) & after_number, _UNIT, np.where((kind == _CAPITAL) & ~starts, _CAPITAL, _WORD)))
    typed = h.copy()
    for k, x in _TYPED.items():
        typed[slot == k] = x
    first = np.searchsorted(owner, owner, "left")
    plain = np.concatenate([[0], np.cumsum(slot == _WORD)])
    for width in widths:
        n = len(h) - width + 1
        if n > 0:
            whole = owner[:n] == owner[width - 1:]
            valid = whole & (plain[width:] - plain[:n] >= LEAST)
            salt = np.uint64(width)
            yield width, owner[:n], np.arange(n) - first[:n], _powered(typed, width) + salt, _powered(h, width) + salt, valid, whole, slot, h


def _slots(at: int, width: int, slot: np.ndarray, h: np.ndarray) -> list[int]:
    """Hashes of the slot values of one window, in order."""
    of = slot[at:at + width]
    return h[at:at + width][of != _WORD].view(np.int64).tolist()


def _listed(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (id_type, pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32())
    names = ("id", "text_hash", "at", "key", "template", "slots", "total", "typed", "width")
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), utf8(F.col(text)).alias("text"))


def _spread(rows: DataFrame, widths: list[int] | None, bits: np.ndarray | None) -> DataFrame:
    """Windows of all rows: every one of the benchmark (bits None), or those of documents that pass the filter."""
    held = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)
    shift = np.uint64(64 - FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for part in chunks(batches, limit=_CHUNK):
            if len(tokens.index) > _REMEMBERED:
                tokens = Tokens()
            ids, hashes, texts = (part.column(c).to_pylist() for c in ("id", "text_hash", "text"))
            out = []
            if held is None:
                for i, h, t in zip(ids, hashes, texts, strict=True):
                    count = max((len(x[1]) for x in windows([t], tokens, [1])), default=0)
                    if not count:
                        continue
                    for width, _, at, th, lh, valid, whole, slot, value in windows([t], tokens, [min(WINDOW, count)]):
                        sums = (int(whole.sum()), int(valid.sum()), width)
                        for j in np.flatnonzero(whole).tolist():
                            if valid[j]:
                                out.append((i, h, int(at[j]), int(th[j].view(np.int64)), True, _slots(j, width, slot, value), *sums))
                            out.append((i, h, int(at[j]), int(lh[j].view(np.int64)), False, [], *sums))
            else:
                for width, owner, at, th, lh, valid, whole, slot, value in windows(texts, tokens, widths):
                    for key, template, ok in ((th, True, valid), (lh, False, whole)):
                        hit = ok & (held.value[key >> (shift + np.uint64(3))] >> ((key >> shift) & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                        found = np.flatnonzero(hit)
                        if not template and width < WINDOW:
                            # A shorter item is one window, so its first place in a document is enough.
                            found = found[np.unique(np.stack([owner[found].astype(np.uint64), key[found]]), axis=1, return_index=True)[1]] if len(found) else found
                        for j in found.tolist():
                            out.append((ids[owner[j]], hashes[owner[j]], int(at[j]), int(key[j].view(np.int64)), template,
                                        _slots(j, width, slot, value) if template else [], 0, 0, width))
            yield _listed(out, part.schema.field("id").type)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_hash bigint, at int, key bigint, template boolean, slots array<bigint>, total int, typed int, width int")


def _filter(keys: DataFrame) -> np.ndarray:
    """Bit field of the windows' hashes, made in Spark; the driver gets ``2 ** FILTER_BITS`` bits at most."""
    byte = F.shiftrightunsigned("key", 64 - FILTER_BITS + 3).alias("byte")
    bit = F.expr(f"shiftleft(1, cast(shiftrightunsigned(key, {64 - FILTER_BITS}) & 7 as int))")
    rows = keys.select(byte, bit.alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    bits[rows["byte"].to_numpy()] = rows["bits"].to_numpy()
    return bits


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text") -> DataFrame:
    """One row per contaminated document and item.

    Returns doc_id, item_id, text_hash, windows (of the item's, found in the document), item_windows,
    slots and slots_changed (different values in the item's slots, and those that are another in the
    document), first_at (token). An item is found if the document has ``MATCHED`` of its windows (all, if there are
    fewer; of those with words enough for a template, or of all) and its slot values map to the document's one to
    one place: a value that occurs twice in the item must be the same value twice in the document. Windows with fewer
    than ``LEAST`` words that are no slot match word for word alone. ``MATCHED`` neighbouring windows word for word (13 tokens
    in a row; all windows, if there are fewer) are enough whatever the slots elsewhere hold.

    Windows are compared by a join of 64-bit hashes of 8 tokens; a bit field of fixed size, made from
    all windows of the benchmark, keeps those of documents that can't match out of the shuffle. Null and
    empty texts match nothing; an item of under ``WINDOW`` tokens is one window, its whole token sequence. Documents that share id and text are
    one; a null id is reported as null. Either table empty gives no rows.
    """
    items = staged(_spread(_keyed(benchmark, item_id, item_text).distinct(), None, None))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    bits = _filter(items)
    found = _spread(_keyed(docs, doc_id, text), widths, bits)
    left = found.select(F.col("id").alias("doc_id"), "text_hash", "key", "template", F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots"))
    right = items.select(F.col("id").alias("item_id"), F.col("text_hash").alias("item_hash"), "key", "template", "at", "slots", "total", "typed",
                         F.max("template").over(Window.partitionBy("id", "text_hash", "at")).alias("rich"))
    both = staged(left.join(right, ["key"]).filter(left["template"] == right["template"]).drop(right["template"]).select(
        "doc_id", "text_hash", "item_id", "item_hash", "template", "at", "doc_at", "total", "typed", "rich", "doc_slots", "slots").filter(F.size("doc_slots") == F.size("slots")).distinct())
    by = ["doc_id", "text_hash", "item_id", "item_hash"]
    shared = both.groupBy(*by).agg(F.count_distinct("at").alias("windows"), F.count_distinct(F.when(F.col("rich"), F.col("at"))).alias("rich"),
                                   F.max("total").alias("item_windows"), F.max("typed").alias("typed"), F.min("doc_at").alias("first_at"))
    enough = (F.col("typed") > 0) & (F.col("rich") >= F.least(F.lit(MATCHED), F.col("typed")))
    shared = shared.filter(enough | (F.col("windows") >= F.least(F.lit(MATCHED), F.col("item_windows"))))
    # Values of one alignment must agree; a document may hold the item twice with other values.
    pair = F.explode(F.arrays_zip("slots", "doc_slots")).alias("v")
    values = both.select(*by, (F.col("doc_at") - F.col("at")).alias("shift"), pair).select(*by, "shift", F.col("v.slots").alias("a"), F.col("v.doc_slots").alias("b"))
    values = values.groupBy(*by, "shift", "a").agg(F.count_distinct("b").alias("n"), F.max(F.col("a") != F.col("b")).alias("changed"))
    values = values.groupBy(*by, "shift").agg(F.count("*").alias("slots"), F.count_if("changed").alias("slots_changed"), F.max("n").alias("n"))
    values = values.groupBy(*by).agg(F.min("n").alias("n"), F.max("slots").alias("slots"), F.max("slots_changed").alias("slots_changed"))
    # Words in a row are proof by themselves, whatever the slots elsewhere hold.
    place = Window.partitionBy(*by, "shift").orderBy("at")
    verbatim = both.filter("not template").select(*by, "at", "total", (F.col("doc_at") - F.col("at")).alias("shift"))
    verbatim = verbatim.withColumn("run", F.col("at") - F.row_number().over(place)).groupBy(*by, "shift", "run").agg(F.count("*").alias("n"), F.max("total").alias("total"))
    verbatim = verbatim.filter(F.col("n") >= F.least(F.lit(MATCHED), F.col("total"))).select(*by).distinct().withColumn("verbatim", F.lit(True))

    out = shared
    for other, mark in ((values, "v_"), (verbatim, "w_")):
        other = other.withColumnsRenamed({c: mark + c for c in by})
        out = out.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(mark + c)) for c in by]), "left")
    out = out.filter((F.coalesce("n", F.lit(1)) == 1) | F.col("verbatim"))
    return out.select(*by[:3], "windows", "item_windows", F.coalesce("slots", F.lit(0)).alias("slots"),
                      F.coalesce("slots_changed", F.lit(0)).alias("slots_changed"), "first_at")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """``docs`` without the contaminated documents; all other rows as they are."""
    bad = settled(lambda: matches(docs, benchmark, doc_id, text, **names).select(F.col("doc_id").alias("_id"), "text_hash").distinct())
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text]) == bad["text_hash"]), "left_anti")
