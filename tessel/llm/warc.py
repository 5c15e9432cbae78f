"""WARC archives: a writer with revisit records and a salvaging reader.

Each task writes gzip members, one per record, to files of a bounded size and returns their names; only the files of
tasks that succeeded are in the manifest, so retries leave no doubles. The reader checks each member, version line,
length and digest; where a check fails it searches for the next member or version line that passes, goes on there and logs
the bytes between as a quarantined gap. Of a damaged member the records that pass are kept, before and after
the damage.

Defined cases: a null payload is empty; equal payloads of the same page_id (repeated rows) are all responses; a null
page_id cannot be referred to unless it is the only one; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Rows, new_path, stage

MANIFEST = "path string, bytes long, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, gap_from long, gap_to long"
VERSION = b"WARC/1.1"
#: Fixed values of the format: what starts a gzip member, a version line.
MEMBER, LINE = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")


def open_store(path: str):  # noqa: ANN201
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, digest: str) -> bytes:
    """A plain WARC record. A revisit keeps the HTTP head, and so the payload's length, without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {re.sub(r'[\r\n]+', '%0A', url or '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(plain: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(plain) + z.flush()


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(headers, payload, end) of the record at `at`; ValueError where a check fails."""
    m = LINE.match(data, at)
    # a header has any length, but no further version line
    if not m or (end := data.find(b"\r\n\r\n", at)) < 0 or LINE.search(data, m.end(), end):
        raise ValueError("version line or header")
    head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in data[m.end() : end].decode("utf-8").split("\r\n") if ":" in x)}
    n = int(head["content-length"]) if head.get("content-length", "").isdigit() else -1
    begin = end + 4
    if n < 0 or data[begin + n : begin + n + 4] != b"\r\n\r\n":
        raise ValueError("length")
    block = data[begin : begin + n]
    if head.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("block digest")
    body = block.find(b"\r\n\r\n")
    payload = block[body + 4 :] if body >= 0 else b""
    if head.get("warc-type") == "response" and head.get("warc-payload-digest") != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise ValueError("payload digest")
    length = re.search(rb"(?i)content-length: (\d+)", block[:body] if body >= 0 else b"")
    head["payload-length"] = int(length[1]) if length else len(payload)
    return head, payload, begin + n + 4


def inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, bool]:
    """What can be inflated of the gzip member at `at`, where its reading ended, and whether it is undamaged."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof and pos < len(data):
            out.append(z.decompress(data[pos : pos + step]))
            pos += step
        return b"".join(out), min(pos, len(data)) - len(z.unused_data), z.eof
    except zlib.error:  # the failing step again, byte by byte, for what it holds before the damage
        z, out, bad = zlib.decompressobj(31), [], pos
        for pos in range(at, bad, step):
            out.append(z.decompress(data[pos : pos + step]))
        for pos in range(bad, min(bad + step, len(data))):
            try:
                out.append(z.decompress(data[pos : pos + 1]))
            except zlib.error:
                break
        return b"".join(out), pos + 1, False


def records(plain: bytes) -> tuple[list[tuple[dict, bytes]], bool]:
    """The records of a member's bytes that pass, and whether nothing else is there."""
    found, pos, whole = [], 0, True
    while pos < len(plain):
        try:
            head, payload, pos = parse(plain, pos)
            found.append((head, payload))
        except (ValueError, KeyError):
            following, whole = LINE.search(plain, pos + 1), False
            pos = following.start() if following else len(plain)
    return found, whole


def salvage(data: bytes) -> Iterator[tuple[dict, bytes] | tuple[int, int]]:
    """Records as (headers, payload), and gaps as (from, to) byte offsets in the file.

    A damaged member gives the records in it that pass, and is a gap as a whole.
    """
    at, bad = 0, None
    known, until = set(), 0  # records of a damaged member, and where its reading ended: stored blocks show them again
    name = lambda head: (head.get("warc-record-id"), head["warc-block-digest"])
    starts = re.compile(re.escape(MEMBER) + rb"|WARC/1\.[01]\r\n")
    while at < len(data):
        if data.startswith(MEMBER, at):
            plain, end, sound = inflate(data, at)
            found, whole = records(plain)
            whole = whole and sound
        else:
            sound = whole = True
            try:
                head, payload, end = parse(data, at)
                found = [(head, payload)]
            except (ValueError, KeyError):
                found, sound, whole = [], False, False
        if at < until and found:
            found = [x for x in found if name(x[0]) not in known]
            if whole and not found:
                at = end
                continue
        if whole:
            if bad is not None:
                yield bad, at
                bad = None
            yield from found
            at = end
            continue
        yield from found
        bad = at if bad is None else bad
        if sound:
            at = end
            continue
        if found:
            known, until = (known if at < until else set()) | {name(x[0]) for x in found}, max(until, end)
        following = starts.search(data, at + 1)
        at = following.start() if following else len(data)
    if bad is not None:
        yield bad, len(data)


def marked(pages: DataFrame, least: int = 100) -> DataFrame:
    """pages with payload digest, record type and refers_to; groups are pre-aggregated by digest and joined back."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    first = p.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select("digest", "first_id")
    first = stage(first, "first")  # so that the join has a shuffle on either side and skewed digests can be split
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return p.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first_id")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, file_bytes: int = 32_000_000) -> DataFrame:
    """Writes records(page_id, url, html, digest, kind, refers_to) below folder; the manifest (path, bytes, records), staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        rows, sink, path, size, n = Rows(MANIFEST), None, "", 0, 0
        for b in batches:
            for page, url, html, digest, kind, refers in zip(*(c.to_pylist() for c in b.columns)):
                if sink is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    path, size, n = f"{folder}/{name}", 0, 0
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(f"{base}/{name}", compression=None)
                data = member(record(page, url, (html or "").encode(), kind, refers, digest))
                sink.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    sink.close()
                    sink = None
                    rows.add(path, size, n)
        if sink is not None:
            sink.close()
            rows.add(path, size, n)
        yield from rows.take()

    return stage(records.select("page_id", "url", "html", "digest", "kind", "refers_to").mapInArrow(run, MANIFEST), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Rows of all records and gaps of the manifest's archives; a gap has archive, gap_from and gap_to only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(RECORDS)
        number = lambda x: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", x or "")) else None
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = open_store(path)
                with store.open_input_stream(at, compression=None) as f:
                    data = f.read()
                for a, e in salvage(data):
                    if isinstance(a, int):
                        full = rows.add(None, None, None, None, None, path, a, e)
                    else:
                        full = rows.add(number(a["warc-record-id"]), a["payload-length"], a["warc-payload-digest"].removeprefix("sha256:"), a["warc-type"], number(a.get("warc-refers-to")), path, None, None)
                    if full:
                        yield from rows.take()
        yield from rows.take()

    files = manifest.select("path")
    return files.repartition(max(1, min(10_000, manifest.count())), F.xxhash64("path")).mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(marked(pages), folder)).where("gap_from is null")
