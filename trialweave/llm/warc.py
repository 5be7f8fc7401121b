"""Web archives: one gzip member per record, written by Spark tasks and read back in sequence.

A response record holds an HTTP head and the payload; a record whose payload another record already holds
is a revisit, with the head alone and a reference. The reader takes a file in pieces, inflates member after
member, frames each record by its content length and checks both digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.shared import Steps, new_folder

# Fixed values of the format.
VERSION = b"WARC/1.0"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
URN = "urn:record:"
#: Payloads below this size are never revisits; archives are closed beyond this size.
SMALLEST = 1000
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 1 << 20

RECORD = (
    "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "digest_ok boolean, archive string, at long"
)


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _head(lines: list[tuple[str, str]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not yet compressed."""
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http if refers_to is not None else http + payload
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{URN}{'' if key is None else key}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", _digest(payload)),
        ("WARC-Block-Digest", _digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        lines.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if refers_to is not None:
        lines += [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", REVISIT)]
    return VERSION + b"\r\n" + _head(lines) + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, key: str, payload: str, smallest: int = SMALLEST) -> DataFrame:
    """Add ``refers_to``: the largest key with an equal payload, unless that is the row itself or the payload is small."""
    raw = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.withColumns({"__sha1": F.sha1(raw), "__large": F.length(raw) >= smallest})
    several = rows.filter("__large").groupBy("__sha1").agg(F.max(key).alias("__top"), F.count(F.lit(1)).alias("__n"))
    several = several.filter("__n > 1 and __top is not null").select("__sha1", "__top")
    other = F.col("__large") & ~F.col(key).eqNullSafe(F.col("__top"))
    return rows.join(several, "__sha1", "left").withColumn("refers_to", F.when(other, F.col("__top"))).drop("__sha1", "__large", "__top")


def write_archives(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None,
    smallest: int = SMALLEST, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write one record per row; returns ``path, records, bytes`` of the archives, as a written table.

    A null payload is empty, a null URL is left out, a null key is an empty record id and never referred to.
    Rows with equal key and payload are all responses when theirs is the largest key. Other columns are
    ignored. Each attempt of a task writes files of its own name, and the result names those of the attempts
    that counted, so lost executors leave no half-written archive in it. An empty table has no archives.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "archives")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload"))
    rows = with_revisits(rows, "key", "payload", smallest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, out = TaskContext.get(), [], None
        for batch in batches:
            for k, u, p, r in zip(*[batch.column(c) for c in ("key", "url", "payload", "refers_to")], strict=True):
                if out is None:
                    path = f"{folder}/{task.partitionId():05d}-{task.taskAttemptId()}-{len(done)}.warc.gz"
                    fs, local = FileSystem.from_uri(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out, size, n = fs.open_output_stream(local, compression=None), 0, 0
                size += out.write(gzip.compress(record(k.as_py(), u.as_py(), (p.as_py() or "").encode(), r.as_py()), 6, mtime=0))
                n += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return Steps(spark, "manifest").write(rows.mapInArrow(run, "path string, records long, bytes long"))


def members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member, read in pieces."""
    at, data, more = 0, b"", True
    while True:
        if not data:
            data = stream.read(READ_BYTES)
            if not data:
                return
        inflate, parts, start = zlib.decompressobj(wbits=31), [], at
        while not inflate.eof:
            if not data:
                data = stream.read(READ_BYTES)
                if not data:
                    raise ValueError(f"the member at {start} is cut short")
            parts.append(inflate.decompress(data))
            at += len(data) - len(inflate.unused_data)
            data = inflate.unused_data
        yield start, b"".join(parts)


def _lines(head: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest if x)}


def _key(text: str | None) -> int | None:
    number = (text or "").strip("<>").removeprefix(URN)
    return int(number) if number else None


def parse(raw: bytes) -> dict:
    """Fields, payload and checks of one record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, fields = _lines(head)
    if not gap or not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    size = int(fields["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError(f"the record {fields.get('warc-record-id')} is not as long as it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["warc-payload-digest"]
    ok = fields["warc-block-digest"] == _digest(block)
    revisit = fields["warc-type"] == "revisit"
    length = int(_lines(http)[1]["content-length"])
    if not revisit:
        ok = ok and stated == _digest(payload) and length == len(payload)
    return {
        "key": _key(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "refers_to": _key(fields.get("warc-refers-to")), "payload_bytes": length,
        "payload_digest": base64.b32decode(stated.removeprefix("sha1:")).hex(), "digest_ok": ok, "payload": payload,
    }


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives in ``path``, one task's files after another.

    Columns of ``RECORD`` and, if wanted, ``payload`` (bytes; empty for revisits, whose size and digest are the
    stated ones of the payload they refer to). ``digest_ok`` is false for a record whose block or payload does not
    have its stated digest; broken framing is an error. Memory holds one record and one batch of about 8 MB.
    """
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = pa.schema([pa.field(n, types[t]) for n, t in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, local = FileSystem.from_uri(path)
                rows, size = [], 0
                with fs.open_input_stream(local, compression=None) as stream:
                    for at, raw in members(stream):
                        rows.append(parse(raw) | {"archive": path, "at": at})
                        size += 200 + len(rows[-1]["payload"]) * with_payload
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], fields)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], fields)

    paths = archives.select("path")
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(run, schema)
