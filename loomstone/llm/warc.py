"""WARC archives: writing, sequential reading and digest verification.

An archive is a chain of gzip members, one per record. The reader inflates it piece by piece,
finds each record's end by the content length in its header and checks the payload digest; on a cluster
a task holds one archive at a time (``ARCHIVE_BYTES``, or one larger record).

Equal payloads are stored once: of the records that share a payload of at least ``min_revisit``
bytes, the one with the largest id is the response and the others are revisits that refer to it.

Defined results: a null payload is an empty one; a null url is written as an empty target; a null
id is never referred to unless all ids of the group are null; rows that repeat the id of the
response are responses too. An empty table gives no archive and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop, id_type, load, materialize, scratch, small_batches

PIECE = 1 << 16
#: An archive is closed once it holds so many compressed bytes.
ARCHIVE_BYTES = 8 << 20
#: Groups of equal payloads are cut into so many parts before they are shuffled.
SALTS = 32
_EPOCH = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """The archive is damaged: truncated, wrongly framed or of another format."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(head.encode()) + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


class Record:
    """Headers (lower-case names) and block of a record; ``digest_ok`` is None where it states no digest for a stored block."""

    __slots__ = ("block", "digest_ok", "headers", "length")

    def __init__(self, headers: dict[str, str], block: bytes, length: int, digest_ok: bool | None):
        self.headers, self.block, self.length, self.digest_ok = headers, block, length, digest_ok


def _member(stream: BinaryIO, rest: bytes) -> Iterator[bytes]:
    """Inflated pieces of one gzip member; the generator's value is what follows the member."""
    inflate = zlib.decompressobj(31)
    while True:
        piece = rest or stream.read(PIECE)
        if not piece:
            raise WarcError("the archive ends within a record")
        try:
            out = inflate.decompress(piece, PIECE)
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from None
        rest = inflate.unconsumed_tail
        if out:
            yield out
        if inflate.eof:
            return inflate.unused_data


def read_records(stream: BinaryIO, keep_block: bool = True) -> Iterator[Record]:
    """The records of an archive in order. Zero bytes after a member are padding."""
    rest = b""
    while True:
        rest = rest.lstrip(b"\0")
        if not rest:
            rest = stream.read(PIECE).lstrip(b"\0")
            if not rest:
                if not (more := stream.read(1)):
                    return
                rest = more
                continue
        pieces, head, after = _member(stream, rest), bytearray(), b""
        end = -1
        while end < 0:
            try:
                head += next(pieces)
            except StopIteration:
                raise WarcError("a record without a complete header") from None
            end = head.find(b"\r\n\r\n")
        lines = head[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"unknown record version {lines[0]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        sha, kept, got, tail = hashlib.sha1(), [], 0, b""
        first = bytes(head[end + 4 :])
        while True:
            block, first = first[: length - got], first[length - got :]
            got += len(block)
            sha.update(block)
            if keep_block:
                kept.append(block)
            tail += first
            if len(tail) > 4:
                raise WarcError("bytes beyond the record's content length")
            try:
                first = next(pieces)
            except StopIteration as e:
                after = e.value
                break
        if got != length or tail != b"\r\n\r\n":
            raise WarcError("a record shorter than its content length")
        stated = headers.get("warc-payload-digest", "")
        ok = sha1_ok(stated, sha) if stated and headers.get("warc-type") != "revisit" else None
        yield Record(headers, b"".join(kept), length, ok)
        rest = after


def sha1_ok(stated: str, sha) -> bool:
    return stated.lower().startswith("sha1:") and stated[5:].upper() == base64.b32encode(sha.digest()).decode()


def page_record(page_id, url, payload: bytes, digest: str, length: int, refers_to, level: int = 6) -> bytes:
    """A resource record of a page, or a revisit without block where ``refers_to`` is given."""
    revisit = refers_to is not None
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else quote(str(page_id), safe='')}>"),
        ("WARC-Date", _EPOCH),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("Content-Type", "text/html; charset=utf-8"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(length)),
    ]
    if revisit:
        headers += [("WARC-Refers-To", f"<urn:page:{quote(str(refers_to), safe='')}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return encode_record(headers, b"" if revisit else payload, level)


def revisits(pages: DataFrame, id_col: str, payload_col: str, min_revisit: int) -> DataFrame:
    """(id, sha, refers_to) of the rows whose payload a row of larger id holds.

    Only digests are shuffled here, and payloads not at all where the result can be broadcast. A payload's rows are first reduced by salted digest, so that no
    task gets all rows of a frequent payload, and the winners return along the salted key.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    keys = pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("len"))
    keys = keys.filter(F.col("len") >= min_revisit).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = keys.groupBy("sha", "salt").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    whole = part.groupBy("sha").agg(F.max("id").alias("refers_to"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    best = whole.filter("n > 1 and refers_to is not null").select("sha", "refers_to", F.explode("salts").alias("salt"))
    found = keys.join(best, ["sha", "salt"]).filter(~F.col("id").eqNullSafe(F.col("refers_to")))
    return found.select("id", "sha", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> str:
    """Write one record per row below ``path`` and return it.

    Each file is one archive of about ``archive_bytes`` (a larger record has one of its own),
    followed by one zero byte of padding. Files are committed by Spark's own writer, so a lost or
    repeated task leaves no partial archive, and any store that Spark can write will do.
    """
    spark = pages.sparkSession
    small_batches(spark)
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    base = base.withColumn("sha", F.sha1("payload"))
    again = materialize(revisits(pages, id_col, payload_col, min_revisit).withColumnsRenamed({"id": "r_id", "sha": "r_sha"}), "revisits")
    rows = base.join(broadcast_if_small(again), F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left")
    rows = rows.select("id", "url", F.octet_length("payload").alias("len"), "sha", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "refers_to")

    def run(batches):
        members, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                members.append(page_record(r["id"], r["url"], r["payload"] or b"", digest, r["len"], r["refers_to"], level))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["archive"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["archive"])

    archives = rows.mapInArrow(run, "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).mode("errorifexists").text(path)
    drop(again)
    return path


def read_warc(spark: SparkSession, path: str, id_type: str = "long", with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``, in the archives' own order within a file.

    ``digest_ok`` says whether a stored payload matches its stated digest; null for revisits, whose
    ``payload`` is null. Raises WarcError on damaged archives.
    """
    fields = f"record_id {id_type}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}, digest_ok boolean, payload binary"
    arrow_id = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()
    types = [arrow_id, pa.string(), pa.int64(), pa.string(), pa.string(), arrow_id, pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in fields.split(", ")]
    convert = str if id_type == "string" else int

    def named(x: str | None):
        x = unquote((x or "")[len("<urn:page:") : -1])
        return convert(x) if x else None

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in read_records(io.BytesIO(content.as_py()), with_payload):
                    h, revisit = r.headers, r.headers["warc-type"] == "revisit"
                    length = int(h.get("x-payload-length", r.length)) if revisit else r.length
                    rows.append((named(h.get("warc-record-id")), h.get("warc-target-uri"), length, h.get("warc-payload-digest", "")[5:], h["warc-type"], named(h.get("warc-refers-to")), r.digest_ok, r.block if with_payload and not revisit else None))
                    size += len(r.block)
                    if len(rows) >= 1024 or size >= 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    spark.conf.set(key, min(int(spark.conf.get(key)), 64))
    return files.mapInArrow(run, fields)


def op1_warc(spark, sf_dir) -> DataFrame:
    """Write every page to archives in the shared folder and read them back."""
    pages = load(spark, sf_dir, "pages")
    path = write_warc(pages, scratch(spark, "warc"))
    got = read_warc(spark, path, id_type(pages, "page_id").replace("bigint", "long"), with_payload=False)
    return got.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")
