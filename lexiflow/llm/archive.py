"""WARC archives: write records, read them back, salvage what lies behind damage.

Writing: every task writes archives of gzip members, one record each, to a shared folder,
and returns a manifest row per archive. Only archives in the manifest of a successful task
are read, so lost or repeated tasks leave no trace in the result.

Reading: archives are split by byte range; a record belongs to the split it begins in. A
record is checked: gzip member, version line, length, end mark, and block and payload
digests where it has any (SHA-1, SHA-256 or MD5, hexadecimal or base 32; the payload digest
not under a transfer encoding, where tools differ). Records of all types are read, from
any writer: what follows the HTTP headers is the payload, without any the whole block; ids
and dates come back as written, page numbers only from this module's own headers; a missing
payload digest is computed, unless it is a revisit's, which is null then. After a
failed check the reader searches for the next member (or, in plain archives, version line)
that passes, goes on from there, and logs the bytes between as a gap with the reason.

Of records with equal payloads of at least MIN_SHARED bytes, those of the largest page_id
are responses; others are revisits, which refer to it and hold no payload. Null html is an
empty payload. Null ids and urls are left out of the headers and read back as null. Repeated
rows are records of their own; no pages give no archives and no records. A record is in
memory as a whole, so the longest text bounds a task's need.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.session import fresh_path, stage

MIN_SHARED = 1000
ARCHIVE_BYTES = 1 << 30
SPLIT_BYTES = 64 << 20
READ_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
HEAD_BYTES = 1 << 20  # longer headers are damage
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
MANIFEST = "path string, bytes long, records long"


# Records.


def _page_urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def encode_record(page_id, url, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    headers = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{url}/{digest}')}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        headers.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if page_id is not None:
        headers.append("WARC-Page-ID: " + _page_urn(page_id))
    if refers_to is not None:
        headers += [f"WARC-Profile: {REVISIT}", "WARC-Refers-To: " + _page_urn(refers_to)]
    headers += [
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(headers).encode() + END + block + END


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _page_number(value: str | None) -> int | None:
    """The page of one of this module's names; names of other writers are no pages."""
    found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", value or "")
    return int(found[1]) if found else None


def _digest(value: str | None) -> tuple[str, str] | None:
    """Algorithm and hexadecimal form of a digest header; None without a digest that can be read."""
    name, _, text = (value or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "md5"):
        return None
    text, size = text.strip(), hashlib.new(name).digest_size
    if len(text) == 2 * size and re.fullmatch(r"[0-9A-Fa-f]+", text):
        return name, text.lower()
    try:
        raw = base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except binascii.Error:
        return None
    return (name, raw.hex()) if len(raw) == size else None


def _differs(digest: tuple[str, str] | None, data: bytes) -> bool:
    return digest is not None and hashlib.new(digest[0], data).hexdigest() != digest[1]


def decode_record(data: bytes) -> tuple[dict, int]:
    """The record at the start of data and its length; ValueError names the failed check."""
    if not data.startswith(VERSION):
        raise ValueError("no version line")
    head_end = data.find(END)
    if head_end < 0:
        raise ValueError("headers do not end")
    fields = _fields(data[:head_end])
    size = _length(fields)
    start = head_end + len(END)
    block, after = data[start : start + size], start + size
    if len(block) < size or data[after : after + 4] != END:
        raise ValueError("record does not end where its length says")
    if _differs(_digest(fields.get("warc-block-digest")), block):
        raise ValueError("block digest differs")
    kind, digest = fields.get("warc-type"), _digest(fields.get("warc-payload-digest"))
    http, payload = {}, block
    if fields.get("content-type", "").lower().startswith("application/http") or block.startswith(b"HTTP/"):
        http_end = block.find(END)
        if http_end >= 0:
            http, payload = _fields(block[:http_end]), block[http_end + len(END) :]
    if kind == "revisit":
        length, payload = http.get("content-length", ""), None
        n_bytes = int(length) if re.fullmatch(r"\d{1,18}", length) else None
    else:
        n_bytes = len(payload)
        if "transfer-encoding" not in http and _differs(digest, payload):
            raise ValueError("payload digest differs")
    if digest is None or digest[0] != "sha1":
        digest = None if payload is None else ("sha1", hashlib.sha1(payload).hexdigest())
    record = {
        "page_id": _page_number(fields.get("warc-page-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": n_bytes,
        "payload_digest": digest[1] if digest else None,
        "refers_to": _page_number(fields.get("warc-refers-to")),
        "record_id": fields.get("warc-record-id"),
        "date": fields.get("warc-date"),
        "payload": payload,
    }
    return record, after + 4


def _length(fields: dict[str, str]) -> int:
    size = fields.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", size):
        raise ValueError("no content length")
    return int(size)


# Salvage.


class Source:
    """Bytes of an archive, read in large pieces."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def read(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if not self.at <= start or start + n > self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(n, READ_BYTES))
        return self.held[start - self.at : start - self.at + n]

    def find(self, mark: bytes, start: int) -> int:
        """Place of the next mark at or after start; the size if there is none."""
        while start < self.size:
            piece = self.read(start, READ_BYTES)
            at = piece.find(mark)
            if at >= 0:
                return start + at
            if start + len(piece) >= self.size:
                break
            start += max(1, len(piece) - len(mark) + 1)
        return self.size


def _member(source: Source, start: int) -> tuple[dict, int]:
    """The record of the gzip member at start, and where the member ends."""
    if source.read(start, len(GZIP)) != GZIP:
        raise ValueError("no gzip member")
    inflate, out, at = zlib.decompressobj(31), [], start
    while not inflate.eof:
        piece = source.read(at, 1 << 14)
        if not piece:
            raise ValueError("gzip member does not end")
        try:
            out.append(inflate.decompress(piece))
        except zlib.error:
            raise ValueError("gzip member is damaged") from None
        at += len(piece)
        if at - start <= 1 << 14 and not out[0].startswith(VERSION[: len(out[0])]):
            raise ValueError("no version line")
    data = b"".join(out)
    record, used = decode_record(data)
    if used != len(data):
        raise ValueError("member holds more than its record")
    return record, at - len(inflate.unused_data)


def _plain(source: Source, start: int) -> tuple[dict, int]:
    """The record of a plain archive at start, and where it ends."""
    if source.read(start, len(VERSION)) != VERSION:
        raise ValueError("no version line")
    head_end = source.read(start, HEAD_BYTES).find(END)
    if head_end < 0:
        raise ValueError("headers do not end")
    size = head_end + len(END) + _length(_fields(source.read(start, head_end)))
    if source.read(start + size, len(END)) != END:  # before a damaged length is read in one piece
        raise ValueError("record does not end where its length says")
    record, used = decode_record(source.read(start, size + len(END)))
    return record, start + used


def salvage(source: Source, plain: bool, start: int = 0, end: int | None = None) -> Iterator[tuple]:
    """(offset, end, record, None) of records that begin in [start, end), and
    (offset, end, None, reason) of the gaps that follow a record or the start of the archive."""
    read, mark = (_plain, VERSION) if plain else (_member, GZIP)
    end = source.size if end is None else min(end, source.size)

    def attempt(at: int):
        try:
            return *read(source, at), None
        except ValueError as error:
            return None, at, str(error)

    def next_valid(at: int) -> int:
        while (at := source.find(mark, at)) < source.size:
            if attempt(at)[0] is not None:
                return at
            at += 1
        return at

    at = start if start == 0 else next_valid(start)
    if start and at >= end:
        return
    while at < source.size:
        record, after, reason = attempt(at)
        if record is None:
            after = next_valid(at + 1)
            yield at, after, None, reason
        elif at >= end:
            return
        else:
            yield at, after, record, None
        at = after


# Spark.


def plan_records(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses) of each page."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared = stage(rows.filter(F.length("payload") >= min_shared).select("page_id", "digest"), "shared")
    largest = shared.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    largest = stage(largest.select("digest", "refers_to"), "largest")
    revisits = shared.join(largest, "digest").filter(F.coalesce(F.col("page_id") != F.col("refers_to"), F.col("refers_to").isNotNull()))
    revisits = stage(revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct(), "revisits")
    met = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))
    return rows.join(revisits, met, "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of plan_records; the manifest of the archives, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, number, out, made = TaskContext.get(), 0, None, []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    path = f"{base}/{task.partitionId():05d}-{task.taskAttemptId()}-{number}.warc.gz"
                    out, written, count = store.open_output_stream(path, compression=None), 0, 0
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = encode_record(*(x.as_py() for x in row))
                data = squeeze.compress(data) + squeeze.flush()
                out.write(data)
                written, count = written + len(data), count + 1
                if written >= archive_bytes:
                    out.close()
                    made.append((path, written, count))
                    out, number = None, number + 1
        if out is not None:
            out.close()
            made.append((path, written, count))
        for row in made:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["path", "bytes", "records"])

    return stage(records.mapInArrow(run, MANIFEST), "manifest")


FOUND = (
    "path string, start long, end long, gap string, page_id long, url string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, record_id string, date string, payload binary"
)


def read_archives(
    manifest: DataFrame, folder: str, payloads: bool = True, split_bytes: int = SPLIT_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Records, and gaps (path, start, end, reason), of the archives in the manifest."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = manifest.select("path", F.explode(starts).alias("start"))
    splits = splits.repartition(max(1, min(splits.count(), 100_000)), "path", "start")
    schema = pa.schema(
        [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("page_id", pa.int64()),
         ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("refers_to", pa.int64()), ("record_id", pa.string()), ("date", pa.string()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    found = salvage(Source(file, file.size()), path.endswith(".warc"), start, start + split_bytes)
                    for begin, end, record, reason in found:
                        row = {"path": path, "start": begin, "end": end, "gap": reason} | (record or {})
                        if not payloads:
                            row.pop("payload", None)
                        rows.append(row)
                        held += len(row.get("payload") or b"") + 500
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    read = stage(splits.mapInArrow(run, FOUND), "archive_rows")
    records = read.filter("gap is null").select(
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "payload",
        "path", "start", "end",
    )
    return records, read.filter("gap is not null").select("path", "start", "end", F.col("gap").alias("reason"))


def archive_round_trip(pages: DataFrame, payloads: bool = True) -> tuple[DataFrame, DataFrame]:
    """Write the pages to fresh archives in the shared folder and read them back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages), folder), folder, payloads)
