"""Benchmark decontamination by Wu-Manber multi-pattern search over word symbols.

Texts are lower-cased (A-Z), cut into words, and each word becomes a symbol (its
number in the benchmark's vocabulary, 0 when it is not in it). Patterns are the
windows of ``window`` consecutive item words; an item with fewer words is one
pattern. For each pattern length m a Wu-Manber table is built:

* blocks are B = min(2, m) consecutive symbols; the shift table has, for the hash
  of a block, the least distance from an occurrence in a pattern to its end, and
  m - B + 1 for blocks in no pattern, so impossible end positions are skipped;
* where the shift is 0, the bucket of that suffix hash lists the patterns to test,
  and a pattern's first symbol must agree (the prefix test of the algorithm);
* the remaining patterns are compared symbol by symbol and then byte by byte.

Patterns are places in the benchmark's row of symbols, not copies of words, so the index takes some
ten times the bytes of the benchmark's text, on the driver and in each Python worker.

The text is cut into lanes that are scanned in lockstep with numpy, each lane
owning a range of window end positions, so nothing is lost at lane borders.

Scale: documents stream through one narrow ``mapInArrow`` (no shuffle). Items are cut in Spark into parts
of at most ``part_bytes`` (whole words, overlapping by a window less one word), equal parts are taken once, and
parts are dealt into blocks of about ``block_bytes`` of text, so neither a long nor a repeated item makes a large
block. With several blocks a worker loads one index after the other and passes ``_CHUNK`` bytes of documents by each.
Beyond ``blocks_at_once`` blocks the documents are written once and read in a pass for each few blocks, whose broadcasts go
before the next pass, so what is broadcast doesn't grow with the benchmark; occurrences of all passes are joined by row.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import LOWER, find_words, flat_text, materialize, pieces, tidy, word_hashes

#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
LANE = 512
_CHUNK = 64 << 20


def _mix(a: np.ndarray, b: np.ndarray, mask: int) -> np.ndarray:
    x = a.astype(np.uint32) * np.uint32(0x9E3779B1) + b.astype(np.uint32) * np.uint32(0x85EBCA77)
    return (x >> np.uint32(11)) & np.uint32(mask)


class _Table:
    """Shift table and suffix-hash buckets for the patterns of one length, given by where they start in ``symbols``."""

    def __init__(self, symbols: np.ndarray, places: np.ndarray, m: int):
        self.symbols, self.places, self.m = symbols, places, m
        n = len(places)
        self.block = min(2, m)
        bits = max(12, int(np.ceil(np.log2(8 * n * m + 1))))
        self.mask = (1 << min(bits, 22)) - 1
        self.shift = np.full(self.mask + 1, min(m - self.block + 1, 255), np.uint8)
        for end in range(self.block - 1, m):
            h = self._hash(self.column(end - 1 if self.block == 2 else end), self.column(end))
            np.minimum.at(self.shift, h, np.uint8(min(m - 1 - end, 255)))
        suffix = self._hash(self.column(m - 2 if self.block == 2 else m - 1), self.column(m - 1))
        self.bucket = np.argsort(suffix, kind="stable").astype(np.int32)
        self.bucket_at = np.searchsorted(suffix[self.bucket], np.arange(self.mask + 2)).astype(np.int32)

    def column(self, j: int) -> np.ndarray:
        return self.symbols[self.places + j]

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix(a if self.block == 2 else np.zeros_like(a), b, self.mask)

    def search(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First positions of occurrences (by symbols) and their pattern rows."""
        n, m = len(symbols), self.m
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        pos = np.arange(0, n, LANE, dtype=np.int64)
        end = np.minimum(pos + LANE, n)
        pos = np.maximum(pos, m - 1)
        keep = pos < end
        pos, end = pos[keep], end[keep]
        hits: list[np.ndarray] = []
        while len(pos):
            s = self.shift[self._hash(symbols[pos - 1] if self.block == 2 else symbols[pos], symbols[pos])]
            zero = s == 0
            if zero.any():
                hits.append(pos[zero])
            pos = pos + np.maximum(s, 1)
            keep = pos < end
            pos, end = pos[keep], end[keep]
        if not hits:
            return none, none
        at = np.concatenate(hits)
        h = self._hash(symbols[at - 1] if self.block == 2 else symbols[at], symbols[at])
        out_at, out_row = [], []
        size = self.bucket_at[h + 1] - self.bucket_at[h]
        # buckets are tested in steps so that no expansion is larger than about a million pairs
        cut = np.searchsorted(np.cumsum(size) // (1 << 20), np.arange(int(size.sum() >> 20) + 2))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if lo == hi:
                continue
            k = size[lo:hi]
            p = np.repeat(at[lo:hi], k)
            row = self.bucket[np.repeat(self.bucket_at[h[lo:hi]], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)]
            ok = symbols[p - m + 1] == self.symbols[self.places[row]]
            p, row = p[ok], row[ok]
            for j in range(1, m):
                ok = symbols[p - m + 1 + j] == self.symbols[self.places[row] + j]
                p, row = p[ok], row[ok]
            out_at.append(p - m + 1)
            out_row.append(row)
        return np.concatenate(out_at) if out_at else none, np.concatenate(out_row) if out_row else none


class Matcher:
    """Patterns of some benchmark items, ready to be sent to executors."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = 10):
        items = sorted({(str(i), t) for i, t in items if i is not None and t is not None})
        raw = [t.encode("utf-8", "surrogatepass") for _, t in items]
        off = np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64)))
        self.data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        self.starts, self.ends, at = find_words(self.data, off, IS_WORD)
        hashes = word_hashes(self.data, self.starts, self.ends)
        self.hashes, inverse = np.unique(hashes, return_inverse=True)
        self.symbols = (inverse + 1).astype(np.int32)
        self.names = [i for i, _ in items]
        n = np.diff(at)
        owner = np.repeat(np.arange(len(items)), n)
        place = np.arange(len(self.symbols))
        by_length: dict[int, np.ndarray] = {}
        whole = place[place + window <= at[owner + 1]] if len(owner) else place
        if len(whole):
            by_length[window] = whole
        for m in np.unique(n[(n > 0) & (n < window)]).tolist():
            by_length[m] = at[:-1][n == m]
        self.tables: list[_Table] = []
        self.owners: list[tuple[np.ndarray, np.ndarray]] = []  # for each table: items of all places, and where each pattern's begin
        for m, places in sorted(by_length.items()):
            # equal patterns are one, with the items of all of them; places in order of their words' bytes are equal side by side
            order, first = self._grouped(places, m)
            self.tables.append(_Table(self.symbols, order[first], m))
            self.owners.append((owner[order].astype(np.int32), np.append(first, len(order))))

    def words(self, place: int, m: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[place : place + m].tolist(), self.ends[place : place + m].tolist(), strict=True)]

    def _grouped(self, places: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Places with equal symbols side by side, and where each group starts; words with one hash and other bytes part a group."""
        h = np.zeros(len(places), np.uint64)
        for j in range(m):
            h = (h ^ self.symbols[places + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        order = places[np.lexsort((places, h))]
        new = np.ones(len(order), bool)
        if len(order) > 1:
            same = np.ones(len(order) - 1, bool)
            for j in range(m):
                same &= self.symbols[order[1:] + j] == self.symbols[order[:-1] + j]
            new[1:] = ~same
            for k in np.flatnonzero(same).tolist() if not self._sound else ():
                new[k + 1] = self.words(order[k], m) != self.words(order[k + 1], m)
        return order, np.flatnonzero(new)

    @functools.cached_property
    def _sound(self) -> bool:
        """Whether words with one hash are equal, by bytes: each is held against the first with its symbol."""
        first = np.full(len(self.hashes) + 1, -1, np.int64)
        first[self.symbols[::-1]] = np.arange(len(self.symbols))[::-1]
        size, other = self.ends - self.starts, first[self.symbols]
        if (size != size[other]).any():
            return False
        on, k = np.flatnonzero(size > 0), 0
        while len(on):
            if (self.data[self.starts[on] + k] != self.data[self.starts[other[on]] + k]).any():
                return False
            k += 1
            on = on[size[on] > k]
        return True

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, tuple[int, int]]]:
        """(text, first word in it, words, pattern) of all occurrences; ``at``: word offsets of the texts."""
        if not len(self.hashes) or not len(starts):
            return []
        h = word_hashes(data, starts, ends)
        i = np.searchsorted(self.hashes, h)
        i[i == len(self.hashes)] = 0
        symbols = np.where(self.hashes[i] == h, i + 1, 0).astype(np.int32)
        found = []
        for which, table in enumerate(self.tables):
            first, row = table.search(symbols)
            if not len(first):
                continue
            text = np.searchsorted(at, first, side="right") - 1
            inside = first + table.m <= at[text + 1]
            for f, r, t in zip(first[inside].tolist(), row[inside].tolist(), text[inside].tolist(), strict=True):
                words = [data[a:b].tobytes() for a, b in zip(starts[f : f + table.m].tolist(), ends[f : f + table.m].tolist(), strict=True)]
                if words == self.words(int(table.places[r]), table.m):
                    found.append((t, f - int(at[t]), table.m, (which, r)))
        return found

    def items(self, pattern: tuple[int, int]) -> set[str]:
        """The ids of the items that a pattern is in."""
        who, first = self.owners[pattern[0]]
        return {self.names[i] for i in np.unique(who[first[pattern[1]] : first[pattern[1] + 1]]).tolist()}


def _parts(window: int, part_bytes: int):
    """Cut item texts into parts of at most ``part_bytes`` (one word and the overlap at least); all windows are in some part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) <= part_bytes:
                    parts = [text]
                else:
                    s, e, _ = find_words(LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)], np.int64), IS_WORD)
                    parts, at = [], 0
                    while True:
                        to = max(at + window, int(np.searchsorted(e, s[at] + part_bytes, side="right"))) if len(s) else 0
                        parts.append(raw[s[at] : e[min(to, len(s)) - 1]].decode("utf-8", "surrogatepass") if len(s) else "")
                        if to >= len(s):
                            break
                        at = to - window + 1
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.string())], names=["i", "t"])

    return run


class _Found:
    """Occurrences in each row of one batch: word spans (first, number of words) and items."""

    def __init__(self, rows: int):
        self.spans: list[list[int]] = [[] for _ in range(rows)]
        self.items: list[set[str]] = [set() for _ in range(rows)]


def _hit_words(spans: list[int], words: int) -> int:
    """Words within any of the spans."""
    if not spans:
        return 0
    pairs = np.array(spans, np.int64).reshape(-1, 2)
    step = np.zeros(words + 1, np.int64)
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, pairs[:, 0] + pairs[:, 1], -1)
    return int(np.count_nonzero(np.cumsum(step) > 0))


def _columns(words: np.ndarray, spans: list[list[int]], items: list) -> list[pa.Array]:
    hit = np.array([_hit_words(s, int(n)) for s, n in zip(spans, words, strict=True)], np.int64)
    ids = [",".join(sorted(i)) for i in items]
    return [
        pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(ids, pa.string()),
        pa.array([hashlib.sha256(i.encode()).hexdigest() for i in ids], pa.string()), pa.array(hit > 0, pa.bool_()),
    ]


def _search(text_col: str, boxes: list, result):
    """mapInArrow function that yields ``result(batch, offsets of its words, found)``; with several blocks each index is loaded once for each _CHUNK bytes of documents."""

    def scan(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_Found(b.num_rows) for b in waiting]
        counts: list[np.ndarray] = []
        for k, box in enumerate(boxes):
            matcher: Matcher = box.value
            for j, batch in enumerate(waiting):
                data, off = flat_text(batch.column(batch.schema.get_field_index(text_col)))
                data = LOWER[data]
                starts, ends, at = find_words(data, off, IS_WORD)
                if not k:
                    counts.append(at)
                for t, f, m, pattern in matcher.find(data, starts, ends, at):
                    found[j].spans[t] += (f, m)
                    found[j].items[t] |= matcher.items(pattern)
            if len(boxes) > 1:
                del matcher
                box.__dict__.pop("_value", None)  # the next index takes its place in memory
        for batch, at, f in zip(waiting, counts, found, strict=True):
            yield result(batch, at, f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for batch in pieces(whole, text_col):
                waiting.append(batch)
                size += batch.nbytes
                if len(boxes) == 1 or size >= _CHUNK:
                    yield from scan(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from scan(waiting)

    return tidy(run)


def _whole(batch: pa.RecordBatch, at: np.ndarray, found: _Found) -> pa.RecordBatch:
    columns = _columns(np.diff(at), found.spans, found.items)
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(x for x, _ in RESULT)])


HITS = "__row long, __spans array<int>, __items array<string>"


def _hits(batch: pa.RecordBatch, at: np.ndarray, found: _Found) -> pa.RecordBatch:
    """Only rows with occurrences, by their number."""
    some = [i for i, s in enumerate(found.spans) if s]
    rows = batch.column(batch.schema.get_field_index("__row")).take(pa.array(some, pa.int64()))
    lists = pa.array([found.spans[i] for i in some], pa.list_(pa.int32())), pa.array([sorted(found.items[i]) for i in some], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([rows, *lists], names=["__row", "__spans", "__items"])


def _joined(text_col: str):
    """The result of rows that carry what all passes found in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text_col):
                data, off = flat_text(batch.column(batch.schema.get_field_index(text_col)))
                _, _, at = find_words(data, off, IS_WORD)
                spans, items = ([x or [] for x in batch.column(batch.schema.get_field_index(n)).to_pylist()] for n in ("__spans", "__items"))
                kept = [n for n in batch.schema.names if n not in ("__spans", "__items")]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), *_columns(np.diff(at), spans, items)], names=[*kept, *(x for x, _ in RESULT)])

    return tidy(run)


RESULT = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items", T.StringType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 16 << 20, part_bytes: int = 1 << 20, blocks_at_once: int = 4) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items, items_sha256 and contaminated added.

    Existing columns with these names are replaced. Null and empty texts have no words and no
    hits; very long texts are searched whole; null items or ids are ignored; items with one id count once;
    equal items (ties) are all named; repeated rows each get their own result; an empty benchmark leaves every document
    clean and an empty table gives no rows. Columns besides these pass through.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(n for n, _ in RESULT))
    bench = benchmark.select(F.col(item_id_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("i is not null and t is not null")
    parts = materialize(bench.mapInArrow(tidy(_parts(window, part_bytes)), "i string, t string").distinct(), "benchmark-parts")
    total = parts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in RESULT)])

    def box(b: int):
        rows = parts.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()  # about block_bytes of text
        return spark.sparkContext.broadcast(Matcher([(r.i, r.t) for r in rows], window))

    if blocks <= blocks_at_once:
        return docs.mapInArrow(_search(text_col, [box(b) for b in range(blocks)], _whole), schema)
    # a pass for each few blocks: no more of the benchmark is broadcast at a time, and only what is found is kept
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = []
    for first in range(0, blocks, blocks_at_once):
        boxes = [box(b) for b in range(first, min(first + blocks_at_once, blocks))]
        found.append(materialize(numbered.select("__row", text_col).mapInArrow(_search(text_col, boxes, _hits), HITS), "hits"))
        for b in boxes:
            b.destroy()
    per_row = functools.reduce(DataFrame.unionByName, found).groupBy("__row").agg(F.flatten(F.collect_list("__spans")).alias("__spans"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items"))
    return numbered.join(per_row, "__row", "left").drop("__row").mapInArrow(_joined(text_col), schema)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
