"""A deterministic sharded WARC writer and its reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import utf8

#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
#: Every record carries this date, so that equal pages give equal files.
DATE = "2024-01-01T00:00:00Z"
#: Payload bytes of one shard and compressed bytes after which a file is closed.
SHARD_BYTES = 32 << 20
FILE_BYTES = 8 << 20
#: Ids in one cell of the exact size histogram that shards are cut from.
CELL = 256
SALTS = 16
_NAMES = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page/{page_id}')}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One uncompressed record. A revisit holds the HTTP header alone and names the response's record."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    head += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        head.append(("X-Page", str(page_id)))
    head += [("X-Payload-Length", str(len(payload))), ("Content-Type", HTTP_TYPE), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _store(where: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (pafs.LocalFileSystem(), where)


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows (page_id, url, payload, bytes, sha1, refers_to).

    Of equal payloads of at least ``min_bytes`` bytes the row with the largest id is the response and
    the others refer to it. Only digests are grouped. The groups of two or more are joined back with
    their rows copied ``SALTS`` times, so that one hot payload is dealt over as many tasks.
    """
    sha1 = F.sha1("payload")
    sizes = pages.select("page_id", sha1.alias("sha1"), F.length("payload").alias("bytes"))
    groups = sizes.filter(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes").agg(
        F.count("*").alias("n"), F.max("page_id").alias("first")).filter("n > 1 and first is not null")
    groups = groups.select("sha1", "bytes", "first", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    salted = sizes.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return salted.join(groups.hint("merge"), ["sha1", "bytes", "salt"], "left").select("page_id", "sha1", "bytes", other.alias("refers_to"))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row below ``folder`` and return the manifest (shard, part, name, records, size, sha1).

    Records are ordered by id (null first), then digest and URL. Shards are ranges of ids of about
    ``shard_bytes`` payload, cut from an exact histogram, so they depend on the rows alone and not on
    how Spark deals them; a shard's files are closed at ``file_bytes`` compressed bytes. A task writes
    under a name of its own attempt, so a lost or doubled task leaves only files that nothing names.
    The manifest is then written by Spark, and a second job moves the files it names to their final
    names; that move can be repeated. Readers take the files of the manifest and no others.

    A null html is an empty payload; a null URL leaves the header out; a null id is a response without
    page header, or a revisit of the largest id with the same payload. Repeated rows are written as
    often as they occur; those with the largest id of their payload are all responses. No rows give
    an empty manifest.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), utf8(F.col(html)).alias("payload"))
    roles = staged(with_roles(rows, min_bytes))
    cell = F.floor(F.col("page_id") / CELL)
    histogram = roles.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy(F.col("cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    # One row per CELL ids and no payload passes through this window.
    shards = staged(histogram.select("cell", F.floor(F.coalesce(before, F.lit(0)) / shard_bytes).alias("shard")))
    # Roles travel as rows of their own and sort just before the rows they are for, so payloads are
    # shuffled once. A role depends on id and payload alone: repeated rows share one.
    revisits = roles.filter("refers_to is not null").select("page_id", "sha1", "refers_to").distinct()
    revisits = revisits.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "sha1", "refers_to")
    dealt = rows.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), F.lit(None).cast(roles.schema["refers_to"].dataType).alias("refers_to"))
    dealt = dealt.unionByName(revisits).join(shards, cell.eqNullSafe(F.col("cell"))).drop("cell").repartition("shard")
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "sha1", F.col("payload").isNotNull(), "url")
    dealt = dealt.select("shard", "page_id", "url", "payload", "sha1", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        attempt = uuid.uuid4().hex
        store.create_dir(posixpath.join(root, "_temporary"), recursive=True)
        out, shard, part, n, digest, size = None, None, 0, 0, None, 0

        def close():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (
                shard, part, f"{shard:06d}-{part:05d}.warc.gz", f"_temporary/{attempt}-{shard:06d}-{part:05d}", n, size, digest.hexdigest())],
                ["shard", "part", "name", "held", "records", "size", "sha1"])

        role = None
        for batch in batches:
            for s, i, u, p, h, r in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if p is None:
                    role = (s, i, h), r
                    continue
                r = role[1] if role and role[0] == (s, i, h) else None
                if out is not None and (s != shard or size >= file_bytes):
                    yield close()
                    out, part = None, part + 1 if s == shard else 0
                if out is None:
                    shard, part = s, part if s == shard else 0
                    out, n, digest, size = store.open_output_stream(posixpath.join(root, f"_temporary/{attempt}-{s:06d}-{part:05d}"), compression=None), 0, hashlib.sha1(), 0
                member = gzip.compress(record(i, u, p, r), 6, mtime=0)
                out.write(member)
                digest.update(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            yield close()

    kind = "shard bigint, part bigint, name string, held string, records bigint, size bigint, sha1 string"
    dealt.mapInArrow(run, kind).write.parquet(posixpath.join(folder, "_manifest"))
    manifest = pages.sparkSession.read.schema(kind).parquet(posixpath.join(folder, "_manifest"))

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for held, name in zip(batch.column("held").to_pylist(), batch.column("name").to_pylist(), strict=True):
                old, new = posixpath.join(root, held), posixpath.join(root, name)
                if store.get_file_info(old).type != pafs.FileType.NotFound:
                    store.move(old, new)
                elif store.get_file_info(new).type == pafs.FileType.NotFound:
                    raise FileNotFoundError(new)
            yield batch.select(["shard", "part", "name", "records", "size", "sha1"])

    final = "shard bigint, part bigint, name string, records bigint, size bigint, sha1 string"
    manifest.mapInArrow(commit, final).write.parquet(posixpath.join(folder, "_committed"))
    return pages.sparkSession.read.schema(final).parquet(posixpath.join(folder, "_committed"))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of every record of a compressed file, one gzip member each."""
    rest = data
    while rest:
        member = zlib.decompressobj(31)
        raw = member.decompress(rest)
        rest = member.unused_data
        head, _, body = raw.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a record")
        fields = dict(x.decode().split(": ", 1) for x in lines[1:])
        yield fields, body[:int(fields["Content-Length"])]


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record.

    Files are read by Spark, whole; the roll size bounds them. Those that the manifest doesn't name
    are left out; block digests, and payload digests of responses, are verified. The payload of a
    revisit is null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(manifest.select("name"), "name").select("name", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows, held = [], 0
                for head, block in parse(content):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = head["WARC-Type"] == "revisit"
                    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                    if head["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or not revisit and base32_sha1(payload) != digest:
                        raise ValueError(f"digest of {head['WARC-Record-ID']}")
                    page, refers = head.get("X-Page"), head.get("X-Refers-To-Page")
                    rows.append((page and int(page), head.get("WARC-Target-URI"), payload, int(head["X-Payload-Length"]), digest,
                                 head["WARC-Type"], refers and int(refers)))
                    held += len(block)
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
