"""Byte-level BPE of whole texts: overlapping chunks are pre-tokenised in parallel and stitched, pieces encoded, ids decoded.

A text of more than ``chunk`` bytes is cut into chunks that overlap by ``overlap`` bytes, and each chunk is split into
pre-tokens on its own, by whichever task holds it. Two neighbouring scans agree from the first pre-token boundary that
both have, since what follows a boundary doesn't depend on what precedes it; there, at the first one that no white space
precedes, the text is cut, and the parts are encoded in parallel. Where a single run of letters, say, outlasts the overlap, no boundary is shared and the two chunks
become one part. Shorter texts are one part and stay where they are.

Why a shared boundary is one of the whole text: a scan that starts within a run of one class (letters, numbers, white
space, others) has a boundary where that run ends, or, if it took the end of the run for the start of a contraction, at
the end of the letters after it, as the scan of the whole text has. So a scan is right from a few characters after the
first such end; up to there it has no boundaries but its start and one within three characters of it, and a chunk is
longer than that.

Pre-tokens are found with numpy over the bytes of a batch (:func:`boundaries`); character classes are asked of the
library, once for each character seen. Distinct pre-tokens are encoded once per batch and process.

Scale: short texts are narrow passes; only texts of more than a chunk are shuffled, by chunk, then by part. A digest
reads a text's ids in order, streaming. Only single pre-tokens of more than a chunk are held whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import AT_STAGE_START, flat_text, materialize, pieces, tidy

#: Fixed value: the pattern that :func:`boundaries` implements.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes before the end of an unfinished chunk in which a boundary could still go: three characters.
MARGIN = 12
CHUNK, OVERLAP = 1 << 16, 1 << 10
SLICE = 2 << 20
#: Distinct pre-tokens, and bytes of them, remembered per process (a cache, not a cap).
KNOWN_LIMIT, KNOWN_BYTES = 300_000, 16 << 20

SPACE, LETTER, NUMBER, OTHER, UNSEEN = 0, 1, 2, 3, 255


def default_path() -> str:
    import public_tokenizers

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the pattern of the tokenizer files is not the one implemented here")
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Characters:
    """The class of each code point, as the library's own expressions see it."""

    def __init__(self):
        import tiktoken

        single = {bytes([i]): i for i in range(256)}
        self.find = {c: tiktoken.Encoding(f"class{c}", pat_str=p, mergeable_ranks=single, special_tokens={}) for c, p in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}"))}
        self.of = np.full(0x110000, UNSEEN, np.uint8)
        self.learn(np.arange(128))

    def learn(self, points: np.ndarray) -> None:
        text = "".join(map(chr, points.tolist()))
        self.of[points] = OTHER
        for c, e in self.find.items():
            found = bytes(e.encode_ordinary(text)).decode()
            self.of[np.array([ord(x) for x in found], np.int64)] = c

    def classes(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte: that of its character."""
        out = self.of[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        for size, low, high, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0x100, 0x07)):
            at = lead[(data[lead] >= low) & (data[lead] < high)]
            if not len(at):
                continue
            point = (data[at] & bits).astype(np.int32)
            for k in range(1, size):
                point = point << 6 | (data[at + k] & 0x3F)
            new = point[self.of[point] == UNSEEN]
            if len(new):
                self.learn(np.unique(new))
            for k in range(size):
                out[at + k] = self.of[point]
        return out


_CONTRACTED = np.zeros(256, bool)
_CONTRACTED[list(b"stmd")] = True


def boundaries(data: np.ndarray, off: np.ndarray, characters: Characters) -> np.ndarray:
    """Where each pre-token of the texts starts, in order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = characters.classes(data)
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    edge = off[(off > 0) & (off < n)]
    whole = cut.copy()  # runs by class alone; what follows white space within one text is looked at next
    whole[edge] = False
    cut[edge] = True
    after = np.flatnonzero(whole[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    last = after - 1
    for _ in range(3):
        last -= (data[last] & 0xC0) == 0x80
    cut[last] = True  # the last white space of a run goes on its own
    cut[after[data[last] == 0x20]] = False  # or, if it is a space, with what follows
    quote = np.flatnonzero(cut & (data == 0x27))
    if len(quote):
        end = off[np.searchsorted(off, quote, side="right")]
        a, b = data[np.minimum(quote + 1, n - 1)], data[np.minimum(quote + 2, n - 1)]
        short = (quote + 1 < end) & _CONTRACTED[a]
        pair = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        long = (quote + 2 < end) & pair
        for hit, size in ((quote[short], 2), (quote[long], 3)):
            cut[hit + 1] = False
            stop = hit + size
            cut[stop[stop < n]] = True
    return np.flatnonzero(cut)


class Vocabulary:
    """The merge ranks of one file, and the ids of pre-tokens seen so far."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.characters = Characters()
        size = max(ranks.values()) + 1
        listed: list[bytes | None] = [None] * size
        for token, i in ranks.items():
            listed[i] = token
        self.tokens = pa.array(listed, pa.binary())
        self.decimals = pa.array([str(i) for i in range(size)], pa.string())
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.at = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: pa.Array) -> None:
        # a pre-token taken alone is matched whole, so encoding it as a text gives its merges
        found = [np.array(self.library.encode_ordinary(w.decode()), np.int32) for w in words.to_pylist()]
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, *found])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in found])])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the n + 1 offsets of each text's."""
        start = boundaries(data, off, self.characters)
        edges = np.append(start, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        where = pc.index_in(coded.dictionary, value_set=self.words)
        if where.null_count:
            if len(self.words) + where.null_count > KNOWN_LIMIT or self.words.nbytes > KNOWN_BYTES:
                self._forget()
            self._learn(coded.dictionary.filter(pc.invert(pc.is_in(coded.dictionary, value_set=self.words))))
            where = pc.index_in(coded.dictionary, value_set=self.words)
        entry = where.to_numpy().astype(np.int64)[coded.indices.to_numpy()]
        size = self.at[entry + 1] - self.at[entry]
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[entry] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        return ids, np.concatenate(([0], stop))[np.searchsorted(start, off)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The raw bytes of all ids, one after another, and the n + 1 offsets of each id's."""
        got = self.tokens.take(pa.array(ids))
        if got.null_count:
            raise ValueError("an id that the vocabulary lacks")
        return flat_text(got)


_OPEN: dict[str, Vocabulary] = {}
AT_STAGE_START.append(_OPEN.clear)


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per process, stage and file."""
    if path not in _OPEN:
        _OPEN[path] = Vocabulary(path)
    return _OPEN[path]


def _valid(column: pa.Array) -> pa.Array:
    """Bytes that are no UTF-8 become U+FFFD, since the library takes text only."""
    try:
        column.cast(pa.string())
        return column
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace").encode() for x in column.to_pylist()], pa.binary())


def _lists(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))


def _encode(path: str):
    """Replaces the last column, ``body``, by its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = vocabulary(path)
        for whole in batches:
            for batch in pieces(whole, "body", SLICE):
                ids, off = book.encode(*flat_text(_valid(batch.column(batch.num_columns - 1))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(ids, off)], names=[*batch.schema.names[:-1], "ids"])

    return tidy(run)


def _border(raw: memoryview, at: int) -> int:
    """``at``, or the start of the character that it is within."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _chunks(chunk: int, overlap: int):
    """Rows (row, id, k, own, last, body): chunk k of a text, which owns its first ``own`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 33
        for batch in batches:
            ids = batch.column(0)
            for i, body in enumerate(_valid(batch.column(1))):
                raw = memoryview(body.as_buffer())
                starts, rows, held = list(range(0, len(raw), chunk)), [], 0
                for k, at in enumerate(starts):
                    a, last = _border(raw, at), k + 1 == len(starts)
                    b = len(raw) if last else _border(raw, starts[k + 1])
                    rows.append((k, b - a, last, raw[a : _border(raw, min(b + overlap, len(raw)))]))
                    held += len(rows[-1][3])
                    if last or held > SLICE:
                        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)]
                        same = pa.array(np.full(len(rows), i, np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), row)), ids.take(same), *columns], names=["row", "id", "k", "own", "last", "body"])
                        rows, held = [], 0
                row += 1

    return tidy(run)


def _scan(path: str, overlap: int):
    """Rows (row, k, own, last, head, tail): the boundaries of a chunk near its start, and near the next chunk's, from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters = vocabulary(path).characters
        for whole in batches:
            for batch in pieces(whole, "body", SLICE):
                data, off = flat_text(batch.column(4))
                cuts = boundaries(data, off, characters)
                text = np.searchsorted(off, cuts, side="right") - 1
                # a part that ends in white space would not show what follows that, which decides how it is split
                settled = (cuts == off[text]) | (characters.classes(data)[cuts - 1] != SPACE)
                cuts, text = cuts[settled], text[settled]
                own = batch.column(2).to_numpy()
                last = batch.column(3).to_numpy(zero_copy_only=False)
                at = cuts - off[text]
                head = at <= overlap
                tail = (at >= own[text]) & ~last[text] & (at <= np.diff(off)[text] - MARGIN)
                lists = [_lists((at - base)[hit], np.searchsorted(text[hit], np.arange(batch.num_rows + 1))) for hit, base in ((head, 0), (tail, own[text]))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *lists], names=["row", "k", "own", "last", "head", "tail"])

    return tidy(run)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows with one (row, part): their bodies in a row."""
    key, own, held = None, None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array([b"".join(held)], pa.binary())], names=["row", "id", "part", "body"])

    for batch in batches:
        for i in range(batch.num_rows):
            now = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
            if now != key:
                if held:
                    yield out()
                key, own, held = now, batch.slice(i, 1), []
            held.append(batch.column(4)[i].as_py())
    if held:
        yield out()


def _long_parts(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """row, id, part, body: texts cut where the scans of neighbouring chunks meet."""
    kind = docs.schema["id"].dataType.simpleString()
    cut = docs.mapInArrow(_chunks(chunk, overlap), f"row long, id {kind}, k int, own int, last boolean, body binary")
    chunks = materialize(cut.repartition("row", "k"), "bpe-chunks")
    marks = materialize(chunks.select("row", "k", "own", "last", "body").mapInArrow(_scan(path, overlap), "row long, k int, own int, last boolean, head array<int>, tail array<int>"), "bpe-marks")
    before = marks.where("not last").select("row", (F.col("k") + 1).alias("k"), "tail")
    met = marks.select("row", "k", "own", "last", "head").join(before, ["row", "k"], "left")
    met = met.withColumn("cut", F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect("head", "tail"))))
    order = Window.partitionBy("row").orderBy("k")  # the chunks of one text, without their bytes
    part = F.last(F.when(F.col("cut").isNotNull(), F.col("k")), ignorenulls=True).over(order)
    stop = F.when(~F.col("last"), F.col("own") + F.coalesce(F.lead("cut").over(order), F.lit(0)))
    ranges = met.select("row", "k", part.alias("part"), F.coalesce("cut", F.lit(0)).alias("from"), stop.alias("to"))
    ranges = materialize(ranges.withColumn("alone", F.count("*").over(Window.partitionBy("row", "part")) == 1), "bpe-ranges")
    body = F.expr("substring(body, from + 1, coalesce(to, length(body)) - from)")

    def bodies(which: str) -> DataFrame:
        return chunks.select("row", "id", "k", "body").join(ranges.where(which), ["row", "k"]).select("row", "id", "part", "k", body.alias("body"))

    runs = bodies("not alone").repartition("row", "part").sortWithinPartitions("row", "part", "k")
    return bodies("alone").drop("k").unionByName(runs.mapInArrow(tidy(_joined), f"row long, id {kind}, part int, body binary"))


def _encoded(docs: DataFrame, id_col: str, text_col: str, path: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(row, id, part, ids) of texts of one part, which have no row number, and of those of several."""
    if overlap <= MARGIN or chunk < overlap + 4:
        raise ValueError("the overlap must be over 12 bytes, and a chunk longer than it by 4")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("id"), body.alias("body"))
    fields = f"row long, id {slim.schema['id'].dataType.simpleString()}, part int, ids array<int>"
    short = slim.where(F.length("body") <= chunk).select(F.lit(None).cast("long").alias("row"), "id", F.lit(0).alias("part"), "body")
    long = _long_parts(slim.where(F.length("body") > chunk), path, chunk, overlap)
    return short.mapInArrow(_encode(path), fields), long.mapInArrow(_encode(path), fields)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """row, ``id_col``, part, ids: the ids of each text, in parts ordered by ``part`` that don't share tokens.

    Null and empty texts have one part without ids. Rows of a text of several parts share a ``row`` number, which is null
    for all others, so repeated and null ids keep apart. Very long texts are encoded whole; bytes that are no UTF-8 are
    read as U+FFFD; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    short, long = _encoded(docs, id_col, text_col, path or default_path(), chunk, overlap)
    return short.unionByName(long).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """``encoded`` with the raw bytes of each row's ids in place of the ids (null ids: empty)."""
    file = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = vocabulary(file)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                ids = lists[i].values
                data, _ = book.decode(np.zeros(0, np.int32) if ids is None else ids.to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:-1], pa.array([data.tobytes()], pa.binary())], names=[*batch.schema.names[:-1], "bytes"])

    slim = encoded.select(*(c for c in encoded.columns if c not in ("ids", "bytes")), "ids")
    return slim.mapInArrow(tidy(run), slim.drop("ids").schema.add("bytes", "binary"))


STEP = 1 << 19  # ids decoded at a time


def _digests(path: str):
    """Rows (id, n_tokens, ids_sha256, decoded_sha256) of texts whose parts come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = vocabulary(path)
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        row, own, count, spelt, raw = None, None, 0, hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            lists = batch.column(3)
            off = np.asarray(lists.offsets)
            flat = lists.values.to_numpy()
            rows, out = batch.column(0).to_pylist(), []
            texts, decoded, at = [], None, None
            lo = hi = int(off[0])
            for i in range(batch.num_rows):
                if own is not None and (rows[i] is None or rows[i] != row):
                    out.append((own, count, spelt.hexdigest(), raw.hexdigest()))
                    count, spelt, raw = 0, hashlib.sha256(), hashlib.sha256()
                row, own = rows[i], batch.column(1).slice(i, 1)
                a, end = int(off[i]), int(off[i + 1])
                while a < end:
                    if a >= hi:  # as many whole rows as fit, or a part of this one
                        lo, hi = a, int(off[np.searchsorted(off, a + STEP, side="right") - 1])
                        hi = hi if hi > a else min(a + STEP, end)
                        ids = flat[lo:hi]
                        decoded, at = book.decode(ids)
                        edges = np.unique(np.clip(off, lo, hi)) - lo
                        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), book.decimals.take(pa.array(ids))), " ")
                        texts = dict(zip(edges[:-1].tolist(), joined.to_pylist(), strict=True))
                    b = min(end, hi)
                    spelt.update(((" " if count else "") + texts[a - lo]).encode())
                    raw.update(memoryview(decoded)[at[a - lo] : at[b - lo]])
                    count, a = count + b - a, b
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([x[0] for x in out]), *(pa.array(c) for c in zip(*(x[1:] for x in out), strict=True))], names=names)
        if own is not None:
            yield pa.RecordBatch.from_arrays([own, pa.array([count]), pa.array([spelt.hexdigest()]), pa.array([raw.hexdigest()])], names=names)

    return tidy(run)


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id_col``, n_tokens, ids_sha256 (of decimal ids, joined by spaces), decoded_sha256: one row for each row of ``docs``; odd rows as in :func:`encode`."""
    file = path or default_path()
    short, long = _encoded(docs, id_col, text_col, file, chunk, overlap)
    ordered = long.repartition("row").sortWithinPartitions("row", "part")
    fields = f"id {short.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return short.mapInArrow(_digests(file), fields).unionByName(ordered.mapInArrow(_digests(file), fields)).withColumnRenamed("id", id_col)


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
