"""WARC archives: a writer of gzip members and a reader that splits files at any byte.

The reader's tasks get byte ranges. A task looks for the gzip magic from its first byte on and takes a place for a
member once its first bytes decode to a WARC header; from there it goes from member to member. It owns the records
that start inside its range and reads past its end to finish the last.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import filesystem, rows_of, shared_dir, staged

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
MIN_REVISIT = 100
FILE_BYTES = 256 << 20
SPLIT_BYTES = 8 << 20
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A record, not yet compressed. A revisit (refers_to is set) leaves the payload out."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>"]
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's header fields, by lower-case name, its HTTP header and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": http.decode(), "payload": payload}


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str, level: int, file_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
    fs, top = filesystem(folder)
    fs.create_dir(top, recursive=True)
    made, out, size, n = [], None, 0, 0

    def name() -> str:
        return f"{part:06d}-{len(made):04d}-{attempt}.warc.gz"

    for cols in rows_of(batches, "page_id", "url", "payload", "digest", "refers_to"):
        for page_id, url, payload, digest, refers_to in zip(*cols, strict=True):
            out = out or fs.open_output_stream(f"{top}/{name()}", compression=None)
            member = _gzip(record(page_id, url, payload, digest, refers_to, date), level)
            out.write(member)
            size, n = size + len(member), n + 1
            if size >= file_bytes:
                out.close()
                made.append((f"{folder}/{name()}", size, n))
                out, size, n = None, 0, 0
    if out:
        out.close()
        made.append((f"{folder}/{name()}", size, n))
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["path", "bytes", "records"])


def write_warc(pages: DataFrame, min_revisit: int = MIN_REVISIT, level: int = 6, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of pages (page_id, url, html) and return the files: path, bytes, records.

    Of rows with equal payloads of min_revisit bytes or more, those with the smallest page_id are responses and the
    others revisits of it. Null html is an empty payload, a null url is left out; rows with a null page_id are
    responses. Other columns are ignored; an empty table gives no files.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("first")
    folder = shared_dir(pages.sparkSession, "warc")
    return staged(rows.mapInArrow(lambda it: _write(it, folder, level, file_bytes, date), "path string, bytes long, records long"), "archives")


class _Buffer:
    """A window of a file that grows to the right."""

    def __init__(self, f: pa.NativeFile, start: int):
        self.f, self.base, self.data, self.over = f, start, bytearray(), False
        f.seek(start)

    def more(self) -> bool:
        got = b"" if self.over else self.f.read(CHUNK)
        self.over = not got
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        del self.data[: to - self.base]
        self.base = to


def _is_member(buf: _Buffer, at: int) -> bool:
    """Whether a gzip member that decodes to a WARC header starts at a byte."""
    while len(buf.data) - (at - buf.base) < 512 and buf.more():
        pass
    try:
        return zlib.decompressobj(31).decompress(bytes(buf.data[at - buf.base : at - buf.base + 512]), len(VERSION)) == VERSION
    except zlib.error:
        return False


def _find(buf: _Buffer, at: int, end: int) -> int | None:
    """The first member at or after a byte and before end."""
    while at < end:
        place = buf.data.find(MAGIC, at - buf.base)
        if place < 0:
            at = max(at, buf.base + len(buf.data) - len(MAGIC) + 1)
            buf.drop(min(at, buf.base + len(buf.data)))
            if not buf.more():
                return None
        elif buf.base + place >= end:
            return None
        elif _is_member(buf, buf.base + place):
            return buf.base + place
        else:
            at = buf.base + place + 1
    return None


def members(fs: pafs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the members that start in [start, end)."""
    with fs.open_input_file(path) as f:
        buf = _Buffer(f, start)
        at = _find(buf, start, end)
        while at is not None and at < end:
            z, out, used = zlib.decompressobj(31), [], at - buf.base
            while not z.eof:
                if used >= len(buf.data) and not buf.more():
                    raise EOFError(f"{path}: the member at {at} is cut off")
                chunk = bytes(buf.data[used : used + (1 << 14)])
                out.append(z.decompress(chunk))
                used += len(chunk) - len(z.unused_data)
            yield at, b"".join(out)
            at = buf.base + used
            buf.drop(at)
            if not buf.data and not buf.more():
                return
            if not _is_member(buf, at):
                at = _find(buf, at, end)


def _page_of(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(URN)
    return int(number) if number else None


def _read(batches: Iterator[pa.RecordBatch], keep_payload: bool) -> Iterator[pa.RecordBatch]:
    for cols in rows_of(batches, "path", "start", "end"):
        for path, start, end in zip(*cols, strict=True):
            out: list[tuple] = []
            fs, at = filesystem(path)
            for _, data in members(fs, at, start, end):
                r = parse(data)
                f, payload, revisit = r["fields"], r["payload"], r["fields"]["warc-type"] == "revisit"
                stated = f["warc-payload-digest"].removeprefix("sha256:")
                size = int(re.search(r"content-length: *(\d+)", r["http"], re.I)[1])
                if not revisit and (size != len(payload) or hashlib.sha256(payload).hexdigest() != stated):
                    raise ValueError(f"{path}: the payload of {f['warc-record-id']} is damaged")
                url = f.get("warc-target-uri")
                url = None if url is None else re.sub(r"%(0[0-9A-F]|1[0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), url)
                out.append((_page_of(f["warc-record-id"]), url, size, stated, f["warc-type"], _page_of(f.get("warc-refers-to")), None if revisit or not keep_payload else payload))
                if len(out) >= 500:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, keep_payload: bool = True) -> DataFrame:
    """The records of files (path, bytes): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Every response's payload is checked against its digest; a revisit's payload is null, its size and digest are those
    stated for the full payload. Bytes between members that are no WARC record are passed over.
    """
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes)))
    splits = files.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return splits.repartition(tasks, "path", "start").mapInArrow(lambda it: _read(it, keep_payload), RECORD)
