"""Token-id files: ids of whole documents in ascending document order, coded with Simple-8b.

A file is: magic; 64-bit little-endian words of all blocks; footer arrays (document ids, null flags,
token counts, word offset of each block); a tail with the counts, the CRC-32 of the footer and the
magic again. Ids run on from document to document, and any block can be read by its offset.

Writing: documents are range-partitioned and sorted by id, and each task streams its texts through
the tokenizer into files of at most about ``max_ids`` ids. A file's name holds the task attempt, and
only files named in the manifest, which is written by the same tasks, are read; so a repeated or
lost attempt leaves no trace in the result. Reading streams a million ids at a time.

Scale: one shuffle of the texts by range (ordered output needs it), then narrow. Ranges go by id,
text hash and row number, so rows with one id or none, even equal ones, are split like others; there are as many as keep
each at about ``range_bytes`` of text. The driver sees one manifest row per file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import simple8b, tokens
from .common import fresh_path, materialize, pieces, tidy

MAGIC = b"BLS8IDS\x01"
TAIL = struct.Struct("<QQQI8s")
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"
STEP = 1024  # blocks decoded at a time


class Writer:
    """Streams documents into one file."""

    def __init__(self, filesystem: pafs.FileSystem, path: str):
        self.path, self.out = path, filesystem.open_output_stream(path)
        self.out.write(MAGIC)
        self.rest = np.zeros(0, np.uint32)
        self.words = self.n_ids = 0
        self.ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        null = np.asarray(doc_ids.is_null().to_numpy(zero_copy_only=False))
        self.ids.append(np.asarray(doc_ids.fill_null(0).to_numpy(), "<i8"))
        self.nulls.append(null.astype(np.uint8))
        self.counts.append(np.asarray(counts, "<i8"))
        self.n_ids += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        self._flush(len(self.rest) // simple8b.BLOCK * simple8b.BLOCK)

    def _flush(self, n: int) -> None:
        if n:
            words, at = simple8b.encode(self.rest[:n])
            self.out.write(np.asarray(words, "<u8").tobytes())
            self.blocks.append(at + self.words)
            self.words += len(words)
            self.rest = self.rest[n:]

    def close(self) -> tuple[str, int, int]:
        self._flush(len(self.rest))
        blocks = np.concatenate(self.blocks) if self.blocks else np.zeros(0, np.int64)
        docs = np.concatenate(self.ids) if self.ids else np.zeros(0, "<i8")
        footer = b"".join([docs.tobytes(), *(x.tobytes() for x in self.nulls), *(x.tobytes() for x in self.counts), np.asarray(blocks, "<i8").tobytes()])
        self.out.write(footer)
        self.out.write(TAIL.pack(len(docs), len(blocks), self.n_ids, zlib.crc32(footer), MAGIC))
        self.out.close()
        return self.path, len(docs), self.n_ids


class Reader:
    """Random and streaming access to one file."""

    def __init__(self, filesystem: pafs.FileSystem, path: str):
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        n_docs, n_blocks, self.n_ids, crc, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path}: not a token file")
        length = n_docs * 17 + n_blocks * 8
        self.footer_at = size - TAIL.size - length
        footer = self.file.read_at(length, self.footer_at)
        if zlib.crc32(footer) != crc:
            raise ValueError(f"{path}: the footer is damaged")
        self.doc_ids = np.frombuffer(footer, "<i8", n_docs)
        self.nulls = np.frombuffer(footer, np.uint8, n_docs, 8 * n_docs).astype(bool)
        self.counts = np.frombuffer(footer, "<i8", n_docs, 9 * n_docs)
        words = (self.footer_at - 8) // 8
        self.block_at = np.append(np.frombuffer(footer, "<i8", n_blocks, 17 * n_docs), words)

    def blocks(self, first: int, stop: int) -> np.ndarray:
        """The ids of blocks first..stop-1."""
        a, b = int(self.block_at[first]), int(self.block_at[stop])
        words = np.frombuffer(self.file.read_at(8 * (b - a), 8 + 8 * a), "<u8")
        n = min(stop * simple8b.BLOCK, self.n_ids) - first * simple8b.BLOCK
        return simple8b.decode(words, n).astype(np.uint32)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file."""
        a = int(self.counts[:k].sum())
        b = a + int(self.counts[k])
        first = a // simple8b.BLOCK
        got = self.blocks(first, -(-b // simple8b.BLOCK)) if b > a else np.zeros(0, np.uint32)
        return got[a - first * simple8b.BLOCK : b - first * simple8b.BLOCK]

    def checksums(self) -> np.ndarray:
        """CRC-32 of each document's ids as little-endian unsigned 32-bit integers."""
        ends = np.cumsum(self.counts)
        out = np.zeros(len(ends), np.int64)
        doc = 0
        for first in range(0, len(self.block_at) - 1, STEP):
            ids = self.blocks(first, min(first + STEP, len(self.block_at) - 1))
            view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            lo = first * simple8b.BLOCK
            hi, at = lo + len(ids), lo
            while doc < len(ends):
                b = min(int(ends[doc]), hi)
                out[doc] = zlib.crc32(view[4 * (at - lo) : 4 * (b - lo)], int(out[doc]))
                at = b
                if ends[doc] > hi:
                    break
                doc += 1
            # empty documents at a border belong to what follows and have checksum 0 either way
        return out


def _write(path: str, uri: str, end_id: int, max_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.for_chunks(path)
        filesystem, folder = pafs.FileSystem.from_uri(uri)
        task = TaskContext.get()
        writer, rows = None, []

        def close() -> None:
            nonlocal writer
            if writer is not None:
                rows.append((task.partitionId(), len(rows), *writer.close()))
                writer = None

        for whole in batches:
            for batch in pieces(whole, "text", min(4 << 20, 4 * max_ids)):
                if writer is None:
                    filesystem.create_dir(folder, recursive=True)
                    writer = Writer(filesystem, f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(rows):04d}.bls8")
                ids, off = tokens.with_end(*tokenizer.encode(batch.column(1)), end_id)
                writer.add(batch.column(0), ids, np.diff(off))
                if writer.n_ids >= max_ids:
                    close()
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "seq", "path", "n_docs", "n_ids"]).cast(pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return tidy(run)


def write_token_files(docs: DataFrame, uri: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, max_ids: int = 1 << 25, range_bytes: int = 256 << 20, tokenizer_path: str | None = None) -> DataFrame:
    """Write ``docs`` below ``uri`` (a folder of the shared store) and return the manifest.

    Null ids come first; null and empty texts are one end id; very long texts are written whole; rows with one
    id (ties) are separate documents in the order of their texts' hashes; an empty table gives no
    file. Columns besides the id and the text are ignored, whatever their names.
    """
    if "://" not in uri:
        uri = uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the row number only splits equal rows, so it needn't be the same in another run
    keyed = slim.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    # as many ranges as the texts need, since ranges are never split later
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // range_bytes))
    ordered = keyed.repartitionByRange(ranges, "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "text")
    return materialize(ordered.select("doc_id", "text").mapInArrow(_write(tokenizer_path or tokens.default_path(), uri, end_id, max_ids), MANIFEST), "manifest")


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(filesystem, path)
                crc = reader.checksums()
                n = reader.counts
                start = base + np.cumsum(n) - n
                ids = pa.array(reader.doc_ids, mask=reader.nulls)
                for a in range(0, len(n), 8192):
                    s = slice(a, a + 8192)
                    yield pa.RecordBatch.from_arrays([ids.slice(a, 8192), pa.array(start[s]), pa.array(n[s]), pa.array(crc[s])], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tidy(run)


def read_token_files(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files in ``manifest``."""
    if "://" not in uri:
        uri = uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}"
    base, rows = 0, []
    for f in manifest.orderBy("part", "seq").collect():  # one row per file
        rows.append((f.path, base))
        base += f.n_ids
    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(_read(uri), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    uri = fresh_path(spark, "token-files")
    return read_token_files(spark, uri, write_token_files(docs, uri))
