"""WARC archives: a writer of gzip members and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_path, table

#: Smallest payload that may be stored as a revisit.
REVISIT_BYTES = 1000
#: Bytes after which a task starts another archive, and bytes of a reading task's range.
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
_URN = "urn:cairnflow:page:"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _line(text: str | None) -> str:
    return " ".join((text or "").split())


def record(page: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: the response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_URN}{'' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, *, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write (page_id, url, html) as archives under ``folder``; (path, bytes, records) of each, already written.

    Of equal payloads of ``revisit_bytes`` or more, the one with the largest page_id is the
    response, others revisit it. Rows that repeat this id are responses all; so are payloads
    whose ids are all null. Files have names of their own in each attempt of a task, and only
    those that the returned table lists count, so a lost executor leaves nothing half-read.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    last = own.filter(F.octet_length("payload") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("digest", "last")
    rows = own.join(last, "digest", "left").select("page_id", "url", "payload", "digest", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        done: list[tuple[str, int, int]] = []
        out, path, size, n = None, "", 0, 0
        for batch in batches:
            for page, url, data, digest, last in zip(*(c for c in batch.columns), strict=True):
                page, last = page.as_py(), last.as_py()
                if out is None:
                    path = f"{stem}-{len(done):04d}.warc.gz"
                    system, place = _opened(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out, size, n = system.open_output_stream(place, compression=None), 0, 0
                made = _member(record(page, url.as_py(), data.as_py(), bytes.fromhex(digest.as_py()), last, last is not None and page != last))
                out.write(made)
                size, n = size + len(made), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        columns = zip(*done, strict=True) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "bytes", "records"])

    return cut(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


class _Window:
    """Bytes of a file from some place on, read as they are asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""
        file.seek(at)

    def upto(self, end: int) -> bool:
        """Whether the file reaches ``end``; bytes before it are then held."""
        while self.at + len(self.data) < end:
            more = self.file.read(max(_READ, end - self.at - len(self.data)))
            if not more:
                return False
            self.data += more
        return True

    def drop(self, at: int) -> None:
        self.data = self.data[at - self.at :]
        self.at = at


def _decode(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The content and end of the gzip member at ``at`` if it is one whole WARC record, else None."""
    unzip, parts, checked = zlib.decompressobj(31), [], False
    place = at
    while not unzip.eof:
        if not window.upto(place + 1):
            return None
        chunk = window.data[place - window.at : place - window.at + (4096 if not checked else _READ)]
        try:
            parts.append(unzip.decompress(chunk))
        except zlib.error:
            return None
        place += len(chunk)
        if not checked and sum(map(len, parts)) >= 5:
            if not b"".join(parts).startswith(b"WARC/"):
                return None
            checked = True
    content = b"".join(parts)
    return (content, place - len(unzip.unused_data)) if content.startswith(b"WARC/") and _split(content) else None


def _split(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers by lower-case name and the block of a record; None if its length is wrong."""
    head, mark, rest = content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    try:
        size = int(fields.get("content-length", ""))
    except ValueError:
        return None
    return (fields, rest[:size]) if mark and rest[size:] == b"\r\n\r\n" else None


def records_of_range(file, size: int, low: int, high: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers, block) of the records that start in ``low`` to ``high`` of an open file.

    The range is scanned for the gzip magic; a candidate counts if it decodes, checksum
    included, to a whole record. From there each record starts where the one before ends.
    """
    window, at = _Window(file, low), low
    while at < high:
        window.drop(at)
        if not window.upto(min(size, at + len(MAGIC))):
            return
        if window.data.startswith(MAGIC):
            found = _decode(window, at)
            if found:
                fields, block = _split(found[0])
                yield at, fields, block
                at = found[1]
                continue
        window.upto(min(size, high + len(MAGIC)))
        step = window.data.find(MAGIC, 1, high - at + len(MAGIC) - 1)
        if step < 0:
            return
        at += step


def read_archives(manifest: DataFrame, *, range_bytes: int = RANGE_BYTES, payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, and payload) of all records.

    ``manifest`` has path and bytes of each archive. Every byte range is a task's; a record
    belongs to the range that it starts in. The size and digest of a response are those of
    the bytes that were read; a revisit has them in its headers, and no payload.
    """
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("low"))
    tasks = max(1, min(100_000, int(manifest.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / range_bytes)), F.lit(0))).first()[0])))
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"][: 7 if payload else 6]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def page(field: str) -> int | None:
        return int(field[len(_URN) + 1 : -1]) if field[len(_URN) + 1 : -1] else None

    def row(fields: dict[str, str], block: bytes) -> tuple:
        head, _, body = block.partition(b"\r\n\r\n")
        kind = fields["warc-type"]
        if kind == "revisit":
            size = next(int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.lower() == b"content-length")
            digest, body = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex(), None
        else:
            size, digest = len(body), hashlib.sha1(body).hexdigest()
            if fields["warc-payload-digest"] != f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}":
                raise ValueError(f"the payload of {fields['warc-record-id']} differs from its digest")
        return page(fields["warc-record-id"]), fields["warc-target-uri"], kind, page(fields["warc-refers-to"]) if kind == "revisit" else None, size, digest, body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: len(names)], names=names)

        for batch in batches:
            for path, size, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = _opened(path)
                rows, held = [], 0
                with system.open_input_file(place) as file:
                    for _, fields, block in records_of_range(file, size, low, min(size, low + range_bytes)):
                        rows.append(row(fields, block))
                        held += len(block)
                        if held > 16 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                yield pack(rows)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if payload else "")
    return ranges.repartition(tasks, "path", "low").mapInArrow(run, schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
