"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once inside a task; bounds what numpy holds beside one batch.
CHUNK_BYTES = 4 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def words_in(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null where the key is null."""
    return F.crc32(key.cast("string").cast("binary")) % n


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; null becomes empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about ``limit`` text bytes; a longer text is a run of its own."""
    for batch in batches:
        col, start, held = batch.column(text), 0, 0
        for i, n in enumerate(pa.compute.binary_length(col).to_pylist()):
            if held and held + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


#: Bits of a hash by which rows that can't match stay out of a shuffle.
PREFIX_BITS = 20


def split_by_hash(rows: DataFrame, column: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose hash in ``column`` shares its first bits with one of ``keys``, and the rest.

    At most 2 ** PREFIX_BITS rows are broadcast, at any size; only the first part needs a join by the whole key.
    """
    bits = lambda c: F.shiftrightunsigned(c, 64 - PREFIX_BITS).cast("int")
    p = unused("_p", rows)
    some = F.broadcast(keys.select(bits(F.col(key)).alias(p)).distinct())
    marked = rows.withColumn(p, bits(F.col(column)))
    return marked.join(some, p, "left_semi").drop(p), marked.join(some, p, "left_anti").drop(p)


def unused(name: str, rows: DataFrame) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in (c.lower() for c in rows.columns):
        name += "_"
    return name


def short_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Smaller Arrow batches than Spark's default, for rows of whole texts; another setting of the user's stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Bits of a hash that number a bit of a field of hashes (16 MB).
FIELD_BITS = 27
#: Bits of a hash that number a block of the field, bits by which hashes of a block are told apart, and hashes gathered before they travel.
_BLOCK_BITS, _REST_BITS, _GATHERED = 12, 32, 1 << 20


def hash_field(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]], least: int = 2) -> np.ndarray:
    """Bit field of the unsigned hashes that ``hashes`` lists ``least`` (1 or 2) times or more over all batches of ``rows``.

    Hashes travel by block, four bytes each, and are told apart by their first 44 bits, so a bit may also be set by chance; none is
    missing. The driver gets ``2 ** (FIELD_BITS - 3)`` bytes at most.
    """
    blocks, inner = 1 << _BLOCK_BITS, FIELD_BITS - _BLOCK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def gathered():
            c, n = np.unique(np.concatenate(held) >> np.uint64(64 - _BLOCK_BITS - _REST_BITS), return_counts=True)
            # Twice is enough to be known as repeated.
            c = np.repeat(c, np.minimum(n, least))
            ends = np.searchsorted(c, np.arange(blocks + 1, dtype=np.uint64) << np.uint64(_REST_BITS)).tolist()
            rest = (c & np.uint64((1 << _REST_BITS) - 1)).astype(np.uint32)
            some = [b for b in range(blocks) if ends[b] < ends[b + 1]]
            parts = [rest[ends[b]:ends[b + 1]].tobytes() for b in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(parts, pa.binary())], ["block", "held"])

        for batch in batches:
            for c in hashes(batch):
                held.append(c)
                size += len(c)
                if size >= _GATHERED:
                    yield gathered()
                    held, size = [], 0
        if size:
            yield gathered()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("held").to_pylist(), strict=True):
                found.setdefault(b, []).append(np.frombuffer(x, np.uint32))
        for b, parts in found.items():
            c = np.sort(np.concatenate(parts))
            bits = np.zeros(1 << inner, bool)
            bits[(c[least - 1:][c[least - 1:] == c[:len(c) - least + 1]] >> np.uint32(_REST_BITS - inner)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(bits).tobytes()])], ["block", "held"])

    kind = "block int, held binary"
    out, size = np.zeros(1 << FIELD_BITS - 3, np.uint8), 1 << inner - 3
    for b, x in rows.mapInArrow(run, kind).repartition("block").mapInArrow(mark, kind).toPandas().itertuples(index=False):
        out[b * size:(b + 1) * size] = np.frombuffer(x, np.uint8)
    return out


def in_field(field: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether the bits of these unsigned hashes are set."""
    bit = (c >> np.uint64(64 - FIELD_BITS)).astype(np.int64)
    return (field[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)


def field_of(keys: DataFrame) -> np.ndarray:
    """Bit field of the hashes in the one column of ``keys``."""
    return hash_field(keys, lambda batch: [batch.column(0).to_numpy().view(np.uint64)], 1)


def split_by_field(rows: DataFrame, column: str, field: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Rows whose hash in ``column`` has its bit set, which need a join by the whole hash, and the rest."""
    held = rows.sparkSession.sparkContext.broadcast(field)

    def run(asked: bool):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_field(held.value, batch.column(column).to_numpy().view(np.uint64)) == asked))
        return part

    return rows.mapInArrow(run(True), rows.schema), rows.mapInArrow(run(False), rows.schema)
