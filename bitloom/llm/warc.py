"""WARC archives of pages, and a reader that salvages what is left of damaged ones.

Writing: one gzip member per record (WARC/1.1). Of pages with equal payloads of at least
``min_revisit`` bytes the one with the least page_id is a ``response``, the others are ``revisit``
records without a payload that refer to it. Tasks write files of about ``max_bytes``; names hold the
task attempt and only files in the manifest, written by the same tasks, are read.

Salvage: every member must inflate with its CRC, start with a version line, have the stated
length, end in an empty line and match its block digest. After a failed check the reader looks for
the next gzip magic whose member starts with a version line, or, in plain files, the next version
line with a header after it, goes on from there, and logs the byte gap with its reason. Memory is
one record of at most ``max_record`` bytes, however much a damaged header or member claims, and a
window; larger records are gaps.

Scale: pages are not shuffled. Digests (32 bytes and an id) are pre-aggregated per task; the table
of payloads that occur more than once is written, and Spark broadcasts it only if its files are
below the broadcast threshold, else it joins by digest, where AQE can split a hot digest. Pages
without a digest (small or null payloads) are dealt by row there, not by one null key.

Rows: null html is an empty payload; very long html is one record, written and read whole; pages
with equal ids and payloads (ties) are all responses; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh_path, materialize, tidy

MANIFEST = "path string, records long, bytes long"
RECORD = "path string, at long, size long, kind string, reason string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = b"WARC/1."
_LINE = re.compile(rb"WARC/1\.[0-9]\r\n")
_GZIP = b"\x1f\x8b\x08"
#: Where a member or a record may start after damage, whatever comes before it; a match is shorter than _REACH bytes.
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[0-9]\r\n(?=[A-Za-z])")
_REACH = 12
WINDOW = 1 << 20


def _uri(uri: str) -> str:
    if "://" in uri:
        return uri
    return f"file://{uri.removeprefix('file:')}"


def _name(page_id: int | None, seed: str) -> str:
    return f"<urn:bloom:{seed}:{page_id}>" if page_id is not None else f"<urn:bloom:{seed}:none>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """The bytes of one record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_name(page_id, 'page')}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}")
    head.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to, 'page')}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(uri: str, date: str, level: int, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = pafs.FileSystem.from_uri(uri)
        task, rows, out = TaskContext.get(), [], None
        path, records, size = "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                rows.append((path, records, size))
                out = None

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers_to, revisit = (batch.column(k)[i].as_py() for k in range(5))
                if out is None:
                    filesystem.create_dir(folder, recursive=True)
                    path, records, size = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(rows):04d}.warc.gz", 0, 0
                    out = filesystem.open_output_stream(path, compression=None)
                member = gzip_member(build_record(page_id, url, (html or "").encode("utf-8"), refers_to, revisit, date), level)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= max_bytes:
                    close()
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "records", "bytes"])

    return tidy(run)


def write_archives(pages: DataFrame, uri: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 100, date: str = "1970-01-01T00:00:00Z", level: int = 6, max_bytes: int = 1 << 28) -> DataFrame:
    """Write ``pages`` below ``uri`` (a folder of the shared store) and return the manifest.

    Null html is an empty payload and small payloads are always responses. Repeated rows with the
    least id of their payload are all responses; a row with a null id refers to the least id there
    is, or is a response. An empty table gives no file.
    """
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    d = d.withColumn("digest", F.when(F.octet_length(F.coalesce("html", F.lit(""))) >= min_revisit, F.unhex(F.sha2(F.encode(F.coalesce("html", F.lit("")), "utf-8"), 256))))
    shared = d.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    shared = materialize(shared, "shared-payloads")
    # a key that no digest equals, so that pages without one don't meet in one task
    joined = d.withColumn("key", F.coalesce("digest", F.monotonically_increasing_id().cast("string").cast("binary"))).join(shared.withColumnRenamed("digest", "key"), "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = joined.select("page_id", "url", "html", "first", revisit.alias("revisit"))
    return materialize(rows.mapInArrow(_write(_uri(uri), date, level, max_bytes), MANIFEST), "manifest")


# --- reading -------------------------------------------------------------------------------


class Damaged(ValueError):
    """A member or record failed a check."""


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers in lower case, block, bytes used) of the record at the start of ``data``; checks length, end and digest."""
    cut = data.find(b"\r\n\r\n")
    if not _LINE.match(data):
        raise Damaged("no version line")
    if cut < 0:
        raise Damaged("header does not end")
    headers: dict[str, str] = {}
    for line in data[:cut].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("malformed header")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Damaged("no content length")
    start, end = cut + 4, cut + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length does not match")
    block = data[start:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise Damaged("block digest does not match")
    return headers, block, end + 4


class Salvage:
    """Iterate over the sound records of an archive; gaps are collected in ``gaps`` as (start, end, reason)."""

    def __init__(self, file, max_record: int = 1 << 31):
        self.file, self.size, self.max_record = file, file.size(), max_record
        self.gaps: list[tuple[int, int, str]] = []

    def _inflate(self, at: int, enough: int | None = None) -> tuple[bytes, int]:
        """The member at ``at`` (or its first ``enough`` bytes) and where it ends; no step inflates to more than a window."""
        z, out, pos, got, step = zlib.decompressobj(31), [], at, 0, WINDOW if enough is None else 4096
        data = b""
        while True:
            if not data:
                data = self.file.read_at(min(step, self.size - pos), pos)
                pos += len(data)
            ended = not data
            try:
                out.append(z.decompress(data, enough or step))
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from None
            data = z.unconsumed_tail
            got += len(out[-1])
            if z.eof:
                return b"".join(out), pos - len(z.unused_data)
            if enough and got >= enough:
                return b"".join(out), pos
            if got > self.max_record:
                raise Damaged("member is too large")
            if ended and not out[-1]:
                raise Damaged("member is cut off")

    def _plain(self, at: int) -> tuple[bytes, int]:
        """The bytes of the plain record at ``at``, as its header states them."""
        head = self.file.read_at(min(WINDOW, self.size - at), at)
        m = re.search(rb"\r\n(?i:content-length):[ \t]*([0-9]{1,18})[ \t]*\r\n", head)
        cut = head.find(b"\r\n\r\n")
        if not m or cut < 0 or m.start() > cut:
            raise Damaged("no content length")
        end = at + cut + 4 + int(m[1]) + 4
        if end > self.size:
            raise Damaged("record is cut off")
        if end - at > self.max_record:
            raise Damaged("record is too large")
        return self.file.read_at(end - at, at), end

    def _next(self, at: int) -> int:
        """The next place from ``at`` on where a member or record seems to start, or the end."""
        while at < self.size:
            window = self.file.read_at(min(WINDOW, self.size - at), at)
            for m in _START.finditer(window):
                if m[0] != _GZIP:
                    return at + m.start()
                try:
                    if self._inflate(at + m.start(), 7)[0].startswith(_VERSION):
                        return at + m.start()
                except Damaged:
                    continue
            if at + len(window) >= self.size:
                break
            at += len(window) - _REACH
        return self.size

    def records(self) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
        at = 0
        while at < self.size:
            try:
                start = self.file.read_at(min(7, self.size - at), at)
                if start.startswith(_GZIP):
                    data, end = self._inflate(at)
                elif start == _VERSION:
                    data, end = self._plain(at)
                else:
                    raise Damaged("neither a member nor a version line")
                headers, block, used = parse_record(data)
                if used != len(data):
                    raise Damaged("bytes after the record")
            except Damaged as e:
                to = self._next(at + 1)
                self.gaps.append((at, to, str(e)))
                at = to
                continue
            yield at, end - at, headers, block
            at = end


def describe(headers: dict[str, str], block: bytes) -> tuple:
    """(record type, page id, url, payload bytes, payload digest, refers to) of a record."""
    cut = block.find(b"\r\n\r\n")
    payload = block[cut + 4 :] if cut >= 0 else block
    n, digest = len(payload), hashlib.sha256(payload).hexdigest()
    kind = headers.get("warc-type", "")
    if kind == "revisit":
        m = re.search(rb"(?i)content-length:[ \t]*([0-9]{1,18})(?![0-9])", block[: max(cut, 0)])
        n = int(m[1]) if m else None
        digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
    number = lambda name: int(v) if re.fullmatch(r"-?[0-9]{1,18}", v := headers.get(name, "")) else None
    return kind, number("x-page-id"), headers.get("warc-target-uri"), n, digest, number("x-refers-to-page-id")


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORD.split(", ")])


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = pafs.FileSystem.from_uri(uri)
        schema, rows = _schema(), []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            for path in batch.column(0).to_pylist():
                salvage = Salvage(filesystem.open_input_file(path))
                for at, size, headers, block in salvage.records():
                    rows.append((path, at, size, "record", None, *describe(headers, block)))
                    if len(rows) >= 4096:
                        yield flush()
                rows += [(path, a, b - a, "gap", why, *[None] * 6) for a, b, why in salvage.gaps]
                if rows:
                    yield flush()

    return tidy(run)


def read_archives(spark: SparkSession, uri: str, paths: DataFrame) -> DataFrame:
    """Sound records (kind ``record``) and quarantined byte gaps (kind ``gap``) of the archives in column ``path``."""
    files = paths.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(_read(_uri(uri)), RECORD)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    uri = fresh_path(spark, "archives")
    found = read_archives(spark, uri, write_archives(pages, uri))
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
