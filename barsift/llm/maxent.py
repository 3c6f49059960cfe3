"""A hashed maximum-entropy language model with a class-factored softmax.

A word falls in one of ``CLASSES`` classes by its last letters, and in one of ``SLOTS`` slots of its
class by a hash; words that share both are told apart by their frequency there:

    p(word | history) = p(class | history) p(slot | class, history) p(word | class, slot)

The first two are log-linear in hashed features of the history: the last word, the last two words,
and the words two and three back (skips). Weights live in two tables of fixed size, so the model does
not grow with the corpus; the word counts do, and stay in Spark.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import chunks, utf8

CLASSES, SLOTS = 32, 32
CLASS_ROWS, SLOT_ROWS = 1 << 14, 1 << 15
#: Histories of the class table and of the slot table: words back, combined.
CLASS_FEATURES = ((1,), (1, 2), (2,), (3,))
SLOT_FEATURES = ((1,), (2,))
#: Gradient rounds after the first; each takes the documents of one fold, so every one is seen once.
ROUNDS = 2
#: Step of the first estimate, step of a round, and weight of the prior in counts.
FIRST, STEP, PRIOR = 0.4, 0.5, 4.0
#: Taken off every count of a known word and given to words never seen.
DISCOUNT = 0.5
#: The end of a text, counted as a word. No word is empty.
END = b""
#: Text bytes of one block of documents that is scored with its words' counts.
BLOCK_BYTES = 16 << 20
#: Text bytes of one task of a training round.
TASK_BYTES = 256 << 20
_TOKENS = 1 << 12
_REMEMBERED = 300_000
_DISTINCT = 500_000
_ENDINGS = 100_000
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K2
    return x ^ (x >> np.uint64(29))


class _Endings(dict):
    """First slot of the class of a word by its last letters."""

    def __missing__(self, ending: bytes) -> int:
        if len(self) > _ENDINGS:
            self.clear()
        first = self[ending] = xxhash.xxh3_64_intdigest(ending) % CLASSES * SLOTS
        return first


class Words:
    """Numbers of the words of a task, as they come: hash, class and slot."""

    def __init__(self, words: list[bytes] = ()):
        self.index = defaultdict(count(len(words)).__next__, zip(words, range(len(words)), strict=True))
        self.endings = _Endings()
        self.hash = np.zeros(0, np.uint64)
        self.cell = np.zeros(0, np.int32)
        self.settle()

    def numbers(self, text: bytes) -> np.ndarray:
        """The text's words and its end."""
        words = text.lower().split()
        words.append(END)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def settle(self) -> None:
        n = len(self.index) - len(self.hash)
        if n:
            fresh = list(islice(self.index, len(self.hash), None))
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, n)
            first = np.fromiter(map(self.endings.__getitem__, [w[-3:] for w in fresh]), np.int32, n)
            self.hash = np.concatenate([self.hash, h])
            self.cell = np.concatenate([self.cell, first + ((h >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int32)])


def _pieces(texts: list[bytes], words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of ``_TOKENS`` tokens: word numbers, the text of each, and numbers and texts of the three before the run."""
    ids = [words.numbers(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in ids])
    ids = np.concatenate(ids) if texts else np.zeros(0, np.int64)
    words.settle()
    for a in range(0, len(ids), _TOKENS):
        yield ids[a:a + _TOKENS], owner[a:a + _TOKENS], ids[max(0, a - 3):a + _TOKENS], owner[max(0, a - 3):a + _TOKENS]


def _rows(ids: np.ndarray, wide: np.ndarray, owners: np.ndarray, words: Words) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Cell of every token, and the table rows of its history's features. ``wide`` also has the tokens before."""
    cell, h, lead = words.cell[ids], words.hash[wide], len(wide) - len(ids)
    back = []
    for d in (1, 2, 3):
        x = np.full(len(h), np.uint64(d), np.uint64)
        if len(h) > d:
            np.copyto(x[d:], h[:-d], where=owners[d:] == owners[:-d])
        back.append(x[lead:])

    def feature(j, spec):
        x = back[spec[0] - 1] * _K1 + np.uint64(j + 1)
        for d in spec[1:]:
            x = (_mixed(x) + back[d - 1]) * _K1
        return x

    classes = [_mixed(feature(j, s)) >> np.uint64(20) & np.uint64(CLASS_ROWS - 1) for j, s in enumerate(CLASS_FEATURES)]
    of = ((cell // SLOTS).astype(np.uint64) + np.uint64(1)) * _K2
    slots = [_mixed(feature(j + 8, s) + of) >> np.uint64(20) & np.uint64(SLOT_ROWS - 1) for j, s in enumerate(SLOT_FEATURES)]
    return cell, [x.astype(np.int32) for x in classes], [x.astype(np.int32) for x in slots]


class _Room:
    """Arrays of one run of tokens, used again for the next."""

    def __init__(self):
        self.z = {k: np.empty((_TOKENS, k), np.float32) for k in {CLASSES, SLOTS}}
        self.more = {k: np.empty((_TOKENS, k), np.float32) for k in {CLASSES, SLOTS}}


def _sums(base: np.ndarray, at, table: np.ndarray, rows: list[np.ndarray], z: np.ndarray, more: np.ndarray) -> np.ndarray:
    """base + the table's rows."""
    n = len(rows[0])
    z, more = z[:n], more[:n]
    np.take(table, rows[0], axis=0, out=z, mode="clip")
    for r in rows[1:]:
        z += np.take(table, r, axis=0, out=more, mode="clip")
    z += base if at is None else np.take(base, at, axis=0, out=more, mode="clip")
    return z


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the powers of every row, which ``z`` then holds, and the logarithm of what they were divided by."""
    top = np.float32(0)
    if z.max(initial=0) > 60 or z.min(initial=0) < -60:
        # Beyond what floats hold as they are, the greatest of a row is taken off; looking for it in short rows costs more than the powers.
        top = z.max(1)
        z -= top[:, None]
    np.exp(z, out=z)
    return np.einsum("ij->i", z), top


def _chances(cell, classes, slots, weights, room: _Room) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of the token's class and of its slot."""
    bias, class_table, slot_bias, slot_table = weights
    c, s, at = cell // SLOTS, cell % SLOTS, np.arange(len(cell))
    out = []
    for base, of, table, rows, own, k in ((bias, None, class_table, classes, c, CLASSES), (slot_bias, c, slot_table, slots, s, SLOTS)):
        z = _sums(base, of, table, rows, room.z[k], room.more[k])
        mine = z[at, own]
        total, top = _exp(z)
        out.append(mine - top - np.log(total))
    return out[0], out[1]


def _expected(cell, classes, slots, weights, room: _Room) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of all classes, and of all slots of the token's class."""
    bias, class_table, slot_bias, slot_table = weights
    out = []
    for base, of, table, rows, k in ((bias, None, class_table, classes, CLASSES), (slot_bias, cell // SLOTS, slot_table, slots, SLOTS)):
        z = _sums(base, of, table, rows, np.empty((len(cell), k), np.float32), room.more[k])
        total, _ = _exp(z)
        z /= total[:, None]
        out.append(z)
    return out[0], out[1]


class _Adder:
    """Adds rows of values to rows of a table; places are kept and used again, as making them costs more than the sums."""

    def __init__(self):
        # Two neighbours are added as one complex number: half the places, the same sums.
        self.at = {k: np.empty((_TOKENS, k // 2), np.int64) for k in {CLASSES, SLOTS}}

    def add(self, total: np.ndarray, rows: list[np.ndarray], values: np.ndarray) -> None:
        """Add to each row of ``total`` all values that name it, for each list of rows; all are single floats."""
        n, k = values.shape
        at = self.at[k][:n]
        for r in rows:
            np.add((r.astype(np.int64) * (k // 2))[:, None], np.arange(k // 2), out=at)
            np.add.at(total.reshape(-1).view(np.complex64), at.reshape(-1), values.reshape(-1).view(np.complex64))


#: Table sizes in the order in which they travel, flat, and floats of one travelling block.
SHAPES = ((CLASSES,), (CLASS_ROWS, CLASSES), (CLASSES, SLOTS), (SLOT_ROWS, SLOTS))
_BLOCK = 1 << 15


def _shaped(flat: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in SHAPES])
    return [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), SHAPES, strict=True)]


_SIZE = sum(int(np.prod(s)) for s in SHAPES)


def _summed(docs: DataFrame, weights) -> np.ndarray:
    """Counts (``weights`` None) of all features over ``docs``, or counts minus expected counts, the gradient.

    Expected counts are the model's probabilities, summed over all tokens. Each task sums its own; blocks of the vector
    meet by number and are added as they stream in. What travels is whole counts, or multiples of 1/1024, so the
    order doesn't matter there. The driver gets one vector of fixed size.
    """
    held = None if weights is None else docs.sparkSession.sparkContext.broadcast(weights)
    sent, summed = (np.int32, np.int64) if held is None else (np.float32, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(_SIZE, np.int32 if held is None else np.float64)
        shaped = _shaped(flat)
        _, class_table, slot_bias, slot_table = (x.reshape(-1) for x in shaped)
        words, room, adder, any_row = Words(), _Room(), _Adder(), False
        # Sums of one chunk are single floats, so that the tables they are spread over stay in the cache.
        near = np.zeros(0 if held is None else _SIZE, np.float32)
        tables = () if held is None else _shaped(near)[1::2]
        pending: list = []

        def settle():
            # Feature numbers are gathered first: counting them costs a pass over the table.
            for table, k in ((class_table, 0), (slot_table, 1), (slot_bias, 2)):
                at = [x for where, x in pending if where == k]
                if at:
                    np.add(table, np.bincount(np.concatenate(at), minlength=len(table)), out=table, casting="unsafe")
            pending.clear()

        for part in chunks(batches):
            if len(words.index) > _REMEMBERED:
                words = Words()
            for ids, _, wide, owners in _pieces(part.column("text").to_pylist(), words):
                any_row = True
                cell, classes, slots = _rows(ids, wide, owners, words)
                c, s = cell // SLOTS, cell % SLOTS
                if held is None:
                    pending.append((2, cell))
                    pending += [(0, r * np.int32(CLASSES) + c) for r in classes]
                    pending += [(1, r * np.int32(SLOTS) + s) for r in slots]
                    continue
                at = np.arange(len(cell))
                for of, own, table, p in zip((classes, slots), (c, s), tables, _expected(cell, classes, slots, held.value, room), strict=True):
                    np.negative(p, out=p)
                    p[at, own] += 1
                    adder.add(table, of, p)
            settle()
            if held is not None:
                flat += near
                near[:] = 0
        if any_row:
            if held is None:
                flat[:CLASSES] = slot_bias.reshape(CLASSES, SLOTS).sum(1)
            else:
                flat = (np.round(flat * 1024) / 1024).astype(np.float32)
            for i in range(0, _SIZE, _BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([i // _BLOCK], pa.int32()), pa.array([flat[i:i + _BLOCK].tobytes()])], ["block", "held"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("held").to_pylist(), strict=True):
                x = np.frombuffer(x, sent).astype(summed)
                total[b] = total[b] + x if b in total else x
        for b, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.tobytes()])], ["block", "held"])

    blocks = docs.mapInArrow(run, "block int, held binary").repartition("block").mapInArrow(add, "block int, held binary")
    flat = np.zeros(_SIZE)
    for b, x in blocks.toPandas().itertuples(index=False):
        x = np.frombuffer(x, summed)
        flat[b * _BLOCK:b * _BLOCK + len(x)] = x
    return flat


def fit(docs: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights from all rows of ``docs`` (doc_id, text as bytes), and the number of tokens in each cell.

    The first pass counts features, which gives a first estimate in closed form. Then come ``ROUNDS``
    distributed gradient rounds: observed minus expected counts over the documents of a fold, scaled
    by the expected counts, move every weight.
    """
    counts = _shaped(_summed(docs, None))
    n_class, n_slot = counts[0], counts[2]
    p_class = (n_class + 1) / (n_class + 1).sum()
    p_slot = (n_slot + 0.1) / (n_slot + 0.1).sum(1, keepdims=True)
    share_slot = p_slot.mean(0)

    def first(table, p):
        return FIRST * (np.log((table + PRIOR * p) / (table.sum(1, keepdims=True) + PRIOR)) - np.log(p))

    weights = [np.log(p_class), first(counts[1], p_class), np.log(p_slot), first(counts[3], share_slot)]
    weights[1][counts[1].sum(1) == 0] = 0
    weights[3][counts[3].sum(1) == 0] = 0
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        held = [w.astype(np.float32) for w in weights]
        gradient = _shaped(_summed(docs.filter(fold == k), held))
        for i in (1, 3):
            seen = counts[i] / ROUNDS
            expected = np.maximum(seen - gradient[i], 0)
            weights[i] += STEP * np.clip(gradient[i] / (np.maximum(seen, expected) + 8), -1, 1)
    return [w.astype(np.float32) for w in weights], n_slot.reshape(-1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``docs``, ends of texts included."""

    def listed(seen):
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in chunks(batches):
            for t in part.column("text").to_pylist():
                seen.update(t.lower().split())
            seen[END] += part.num_rows
            if len(seen) > _DISTINCT:
                yield listed(seen)
                seen = Counter()
        yield listed(seen)

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _distinct_words(vocabulary: DataFrame) -> np.ndarray:
    """Number of different words in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * SLOTS, np.int64)
        for batch in batches:
            total += np.bincount(Words(batch.column("word").to_pylist()).cell, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "n"])

    rows = vocabulary.select("word").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CLASSES * SLOTS)
    out[rows["cell"]] = rows["n"]
    return out


def score(docs: DataFrame, train: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every row of ``docs`` under a model of the rows of ``train``.

    Returns doc_id, the columns named in ``keep``, n_tokens (words and one end), n_known (those that
    occur in ``train``), train_tokens, base_score (log10 probability of a unigram model with half a
    count added) and score (log10 probability of the maximum-entropy model).

    Documents are dealt in blocks of about ``BLOCK_BYTES``. A block's different words meet the corpus
    counts by a join, one row per block and word however often it is used there, and come back to the
    block. Words never seen in training share, in each cell, the ``DISCOUNT`` taken from its known
    words. A null or empty text is an end alone. Without training rows every base_score is 0. Repeated
    rows are scored each; no rows give none.
    """
    learn = train.select(F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # Each task of a training round hands on a whole vector, so tasks are few and large.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(size // TASK_BYTES))
    weights, in_cell = fit(learn.coalesce(tasks))
    vocabulary = staged(word_counts(learn))
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    held = docs.sparkSession.sparkContext.broadcast((weights, in_cell, _distinct_words(vocabulary)))

    blocks = max(int(size // BLOCK_BYTES) + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The columns to keep travel by number, so none of them meets a name used here.
    names = ["doc_id", *(f"keep{i}" for i in range(len(keep)))]
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)], utf8(F.col(text)).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set] = {}
        for part in chunks(batches):
            for b, t in zip(part.column("block").to_pylist(), part.column("text").to_pylist(), strict=True):
                of = seen.setdefault(b, {END})
                of.update(t.lower().split())
                if len(of) > _DISTINCT:
                    yield listed(b, seen.pop(b))
        for b, of in seen.items():
            yield listed(b, of)

    def listed(b, of):
        return pa.RecordBatch.from_arrays([pa.array([b] * len(of), pa.int32()), pa.array(list(of), pa.binary())], ["block", "word"])

    # Over the same rows as below, so that they are dealt out once.
    known = rows.mapInArrow(used, "block int, word binary").join(vocabulary, "word", "left")
    known = known.select("block", "word", F.coalesce("n", F.lit(0)).alias("n"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (weights, in_cell, types) = held.value
        vocab = dict(zip(right.column("word").to_pylist(), right.column("n").to_pylist(), strict=True))
        words = Words(list(vocab))
        c = np.fromiter(vocab.values(), np.float64, len(vocab))
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        room = in_cell[words.cell] + 1
        own = np.log10(np.where(c > 0, c - DISCOUNT, DISCOUNT * types[words.cell] + 1) / room)
        known_word = (c > 0).astype(np.float64)
        out, start, room = np.zeros((4, left.num_rows)), 0, _Room()
        for part in chunks(iter(left.select(["text"]).to_batches())):
            sums = np.zeros((4, part.num_rows))
            for ids, owner, wide, owners in _pieces(part.column("text").to_pylist(), words):
                cell, classes, slots = _rows(ids, wide, owners, words)
                lc, ls = _chances(cell, classes, slots, weights, room)
                lp = (lc.astype(np.float64) + ls) / np.log(10) + own[ids]
                first, n_owner = owner[0], owner[-1] - owner[0] + 1
                for i, x in enumerate((None, known_word[ids], base[ids], lp)):
                    sums[i, first:first + n_owner] += np.bincount(owner - first, x, n_owner)
            out[:, start:start + part.num_rows] = sums
            start += part.num_rows
        cols = [*(left.column(k) for k in names), pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)),
                pa.array(np.full(left.num_rows, n, np.int64)), pa.array(out[2]), pa.array(out[3])]
        return pa.table(cols, [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    out = rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        run, f"{kinds}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.select("doc_id", *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "n_known", "train_tokens", "base_score", "score")
