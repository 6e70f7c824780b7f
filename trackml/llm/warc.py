"""WARC archives: a writer with one gzip member per record and a splittable reader.

Writing runs in the tasks that hold the pages: each task streams its records
into files of its own below a shared folder and returns a manifest row per
file, so a retried task leaves at most a file that no manifest names.

Reading cuts every archive into byte ranges.  A task scans its range for the
gzip magic, checks each candidate by decoding a member's head (it must open a
WARC record with an id and a length), and owns the records that *start* inside
its range; the last one may end beyond it.  Ranges need no index, and a range
without a record start yields nothing.

A record of HTTP traffic (``application/http``) holds the message's head and
body; its payload is the body as recorded (content and transfer codings are left
as they are), and that is what ``WARC-Payload-Digest`` covers.  A digest that is
stated by SHA-256, SHA-1 or MD5, in hexadecimal or base 32, is compared; whether
it agrees is a column, and a record whose digest differs is read like any other.

Files are opened through ``pyarrow.fs``, so the folder may be a shared mount,
HDFS or an object store.

Defined cases: a null or empty payload is an empty payload; a null url leaves
``WARC-Target-URI`` out; a null id gives a record id without number and reads
back as null.  Repeated rows are written each.  An archive may be empty.  Bytes
between records that are no record are skipped.  Only the id, url and payload
columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackml.llm import text as T
from trackml.llm.scratch import Scratch

#: least and most bytes of a range; between them about ``RANGES`` cover the archives
LEAST_SPLIT, MOST_SPLIT, RANGES = 4 << 20, 128 << 20, 2000
FILE_BYTES = 256 << 20
MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 16

# fixed values of the WARC 1.1 format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or of an absolute local path."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None) -> bytes:
    """One record as a gzip member.  A revisit carries no payload, only its digest and length."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id)),
            ("WARC-Date", RECORD_DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _one_line(url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    block = payload
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to))]
        block = b""
    else:
        head.append(("Content-Type", "text/html"))
    head.append(("Content-Length", str(len(block))))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    member = zlib.compressobj(wbits=31)
    return member.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") \
        + member.flush()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _one_line(value: str) -> str:
    """Control characters would break the header; they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


_MANIFEST = "path string, length long, records long"


def _write(folder: str):
    def run(batches):
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        out = None
        try:
            for batch in batches:
                # plain lists, one batch at a time
                cols = [T.column(batch, c).to_pylist() for c in (
                    "page_id", "url", "payload", "digest", "refers_to")]
                for page_id, url, payload, digest, refers_to in zip(*cols, strict=True):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        size = count = 0
                    data = record("response" if refers_to is None else "revisit", page_id, url,
                                  payload.encode(), digest, refers_to)
                    out.write(data)
                    size, count = size + len(data), count + 1
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
                        yield _manifest(folder, name, size, count)
            if out is not None:
                out.close()
                out = None
                yield _manifest(folder, name, size, count)
        finally:
            if out is not None:
                out.close()
    return run


def _manifest(folder: str, name: str, size: int, count: int) -> pa.RecordBatch:
    return pa.record_batch([[f"{folder}/{name}"], [size], [count]],
                           names=["path", "length", "records"])


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 100) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``.

    Of the rows with equal payloads of at least ``least_bytes`` the one with the
    smallest page_id is a response and the others revisit it.  Returns the
    manifest ``path, length, records``, a table in the shared folder.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.coalesce("html", F.lit("")).alias("payload")).withColumn(
        "digest", F.sha2("payload", 256))
    # one row per payload that repeats; a table, so that a payload held by a
    # third of all pages can be split in the join
    again = scratch.put("again", rows.where(F.octet_length("payload") >= least_bytes)
                        .groupBy("digest").agg(F.min("page_id").alias("first"),
                                               F.count("*").alias("n"))
                        .where("n > 1 and first is not null").select("digest", "first"))
    marked = rows.join(again, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    manifest = scratch.put("manifest", marked.select(
        "page_id", "url", "payload", "digest", "refers_to").mapInArrow(_write(folder), _MANIFEST))
    scratch.drop("again")
    return manifest


def archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of archives below ``path``, listed by Spark's file source."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


_RECORD = ("record_type string, record_id string, target_uri string, refers_to string, "
           "payload_digest string, payload_length long, payload binary, path string, start long, "
           "http_status int, stated_digest string, digest_ok boolean")


class _Reader:
    """Members of one archive from a position on."""

    def __init__(self, source, at: int):
        self.source, self.at = source, at
        source.seek(at)
        self.buffer = b""

    def fill(self) -> bool:
        more = self.source.read(_CHUNK)
        self.buffer += more
        return bool(more)

    def skip(self, n: int) -> None:
        self.buffer = self.buffer[n:]
        self.at += n

    def find_magic(self, end: int) -> bool:
        """Move to the next magic that starts before ``end``."""
        while self.at < end:
            i = self.buffer.find(MAGIC)
            if i >= 0:
                self.skip(i)
                return self.at < end
            self.skip(max(0, len(self.buffer) - len(MAGIC) + 1))
            if not self.fill():
                return False
        return False

    def head(self) -> bytes | None:
        """The decoded start of the member here, if it opens a WARC record."""
        member, out, used = zlib.decompressobj(wbits=31), b"", 0
        try:
            while not member.eof:
                if used == len(self.buffer) and not self.fill():
                    return None
                out += member.decompress(self.buffer[used:used + 512])
                used = min(len(self.buffer), used + 512)
                if not VERSION[:5].startswith(out[:5]) and not out.startswith(VERSION[:5]):
                    return None
                if b"\r\n\r\n" in out:
                    break
        except zlib.error:
            return None
        end = out.find(b"\r\n\r\n")
        return out[:end] if out.startswith(VERSION[:5]) and end >= 0 else None

    def member(self) -> bytes:
        """Decode the whole member here and move behind it."""
        member, parts = zlib.decompressobj(wbits=31), []
        while True:
            if not self.buffer and not self.fill():
                raise ValueError(f"record at {self.at} is cut off")
            parts.append(member.decompress(self.buffer))
            self.at += len(self.buffer) - len(member.unused_data)
            self.buffer = member.unused_data
            if member.eof:
                return b"".join(parts)


def headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def records(source, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records that start in ``start:end``: position, header fields and block."""
    reader = _Reader(source, start)
    while reader.find_magic(end):
        head = reader.head()
        fields = headers(head) if head is not None else {}
        if "warc-record-id" not in fields or not fields.get("content-length", "").isdigit():
            reader.skip(1)
            continue
        at = reader.at
        data = reader.member()
        begin = len(head) + 4
        yield at, fields, data[begin:begin + int(fields["content-length"])]


def http_parts(block: bytes) -> tuple[int | None, bytes]:
    """Status (None for a request) and body of an HTTP message."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        head, _, body = block.partition(b"\n\n")
    status = re.match(rb"HTTP/[\d.]+ +(\d{3})", head)
    return (int(status[1]) if status else None), body


#: digest names of the format and how many bytes they have
_DIGESTS = {"sha256": 32, "sha-256": 32, "sha1": 20, "sha-1": 20, "md5": 16}


def digest_agrees(stated: str, payload: bytes) -> bool | None:
    """Whether a stated digest is the payload's; None if its form is not known."""
    name, _, value = stated.strip().partition(":")
    size = _DIGESTS.get(name.lower())
    if size is None:
        return None
    try:
        want = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(
            value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None
    found = hashlib.new(name.lower().replace("-", ""), payload, usedforsecurity=False).digest()
    return want == found if len(want) == size else None


def _row(fields: dict[str, str], block: bytes, path: str, at: int) -> tuple:
    stated, length = fields.get("warc-payload-digest"), fields.get("x-payload-length", "")
    kind, status, payload = fields.get("warc-type"), None, block
    if fields.get("content-type", "").lower().startswith("application/http"):
        status, payload = http_parts(block)
    agrees = None
    if kind == "revisit":
        digest = stated
    else:
        digest, length = f"sha256:{hashlib.sha256(payload).hexdigest()}", str(len(payload))
        agrees = digest_agrees(stated, payload) if stated is not None else None
    return (kind, fields["warc-record-id"], fields.get("warc-target-uri"),
            fields.get("warc-refers-to"), digest, int(length) if length.isdigit() else None,
            payload, path, at, status, stated, agrees)


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = open_fs(row["path"])
            with fs.open_input_file(path) as source:
                rows, size = [], 0
                for at, fields, block in records(source, row["start"], row["end"]):
                    rows.append(_row(fields, block, row["path"], at))
                    size += len(block)
                    if size >= 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int32(),
                                 pa.string(), pa.bool_()]
    names = [c.split()[0] for c in _RECORD.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)],
                           names=names)


def split_size(total: int) -> int:
    """Bytes of a range for archives of ``total`` bytes."""
    return min(MOST_SPLIT, max(LEAST_SPLIT, -(-total // RANGES)))


def read_warc(files: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """All records of the archives in ``files`` (path, length), one row each.

    There are as many tasks as ranges, and ranges are dealt to them by hash: a
    task reads a few ranges, one after another, or none.  The size of a range
    follows from the archives' total (:func:`split_size`) unless it is given.
    """
    total = files.agg(F.sum("length")).first()[0] or 0
    split_bytes = split_bytes or split_size(total)
    count = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    pieces = files.where("length > 0").select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
        .alias("start")).select("path", "start", F.least(
            "length", F.col("start") + split_bytes).alias("end"))
    return pieces.repartition(int(count), "path", "start").mapInArrow(_read, _RECORD)


def page_id(column: str) -> Column:
    """The id inside a record id column."""
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1)
