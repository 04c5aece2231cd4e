"""Phrase collocation mining: counts of all phrases of up to ``depth`` words, kept exact, scored by their worst cut.

Per shard (what a task has read) phrases are counted in a trie of limited depth, whose levels are arrays of (parent,
word, count). A full trie is serialised: its paths in depth-first order, cut by prefix range. The ranges are those of
the hashed first three words (two for phrases of two), so that no frequent first word makes a range large. A task
merges the sorted blocks of one range from all shards: the words of the blocks get common numbers in byte order, which
keeps each block sorted, and a stable merge sort of the k sorted runs adds up equal paths.

In the merged order a path's parent is the last path before it that is one word shorter, which gives the left parts from
three words on; shorter ones are joined. Right parts are the nodes that suffix links (the path without its first
word) lead to.

Two passes before it thin out what the tries hold and lose nothing: a phrase seen ``least`` times has only words, and
pairs of words, seen that often. Words are counted as text, pairs by a 64-bit hash (pairs that collide only make a pair
stay), and what is frequent becomes a bit map of at most ``filter_bits`` bits, which is the one thing broadcast. When it
fills up, more is counted and the result stays the same.

Scale: three scans; shuffled are distinct words, distinct pairs of frequent words and the tries' nodes, all added up in
the shard first. A task holds one trie or what one range holds; the number of ranges grows with the words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from .common import LOWER, discard, find_words, flat_text, materialize, pieces, tidy, word_hashes

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\v\f\r")] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False

#: Words or keys that a task gathers before it adds them up.
HELD = 1 << 21
#: Words that a trie is grown from: its paths of all depths are in memory at once.
GROWN = 1 << 20
#: Paths gathered for a range before they are merged.
MERGED = 1 << 21
WORDS_PER_RANGE, LEAST_RANGES = 1 << 20, 128
LEAST_BITS = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _strings(a: pa.Array) -> pa.Array:
    """Bytes as text, unchecked, since words are cut at ASCII characters."""
    return a.view(pa.string())


class Slice:
    """The words of some texts: number and key (a hash of language and word) of each, and whether it follows on the one before."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        data, off = flat_text(texts)
        data = LOWER[data]
        start, end, first = find_words(data, off, _WORD)
        size = end - start
        stop = np.cumsum(size)
        text = data[np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        edges = np.concatenate(([0], stop)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(text)]).dictionary_encode()
        self.words = coded.dictionary
        self.word = coded.indices.to_numpy().astype(np.int64)
        named = langs.cast(pa.string()).dictionary_encode()
        self.langs = named.dictionary
        self.lang = np.repeat(named.indices.to_numpy().astype(np.int64), np.diff(first))
        of = lambda a: word_hashes(*(lambda d, o: (d, o[:-1], o[1:]))(*flat_text(a))) if len(a) else np.zeros(0, np.uint64)
        self.key = _mix(_whole(of, self.words)[self.word] + _M1 * _whole(of, self.langs)[self.lang])
        breaks = np.cumsum(_BREAK[data], dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
        self.follows = np.zeros(len(start), bool)
        self.follows[1:] = breaks[1:] == breaks[:-1]
        self.follows[first[:-1][first[:-1] < len(start)]] = False

    def pairs(self, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that, with the next, are a pair of words marked in ``ok``, and the pairs' keys."""
        at = np.flatnonzero(ok[:-1] & ok[1:] & self.follows[1:])
        return at, pair_keys(self.key[at], self.key[at + 1])


def _whole(of: Callable[[pa.Array], np.ndarray], words: pa.Array) -> np.ndarray:
    """Hashes of words that may be empty (only a language can)."""
    out = np.zeros(len(words), np.uint64)
    full = np.flatnonzero(np.asarray(pc.binary_length(words)) > 0)
    out[full] = of(words.take(pa.array(full)))
    return out


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _M1 + (b ^ (b >> np.uint64(29))) * _M2)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            yield Slice(batch.column(0), batch.column(1))


# --- words ---


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "word", "key", "n"]
    held, rows = [], 0

    def added() -> pa.Table:
        t = pa.concat_tables(held).group_by(names[:3]).aggregate([("n", "sum")])
        return t.rename_columns(names)

    for s in _slices(batches):
        both = s.lang * len(s.words) + s.word
        seen, at, n = np.unique(both, return_index=True, return_counts=True)
        lang, word = (seen // max(len(s.words), 1)), seen % max(len(s.words), 1)
        held.append(pa.table([s.langs.take(pa.array(lang)), _strings(s.words.take(pa.array(word))), pa.array(s.key[at].view(np.int64)), pa.array(n.astype(np.int64))], names=names))
        rows += len(seen)
        if rows > HELD // 4:
            held = [added()]
            rows = held[0].num_rows
            if rows > HELD // 8:
                yield from held[0].combine_chunks().to_batches(65536)
                held, rows = [], 0
    if held:
        yield from added().combine_chunks().to_batches(65536)


# --- frequent keys as bits ---


def bit_map(keys: DataFrame, filter_bits: int) -> tuple[np.ndarray, int]:
    """A bit for each of the long ``key`` values, at the key's last bits: at least 16 bits a key, at most ``filter_bits`` in all."""
    bits = LEAST_BITS
    wanted = 16 * keys.count()
    while bits < min(wanted, filter_bits):
        bits *= 2
    place = F.pmod(F.col("key"), F.lit(bits)) + 1
    parts = keys.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():  # at most bits / 32768 rows of 4 kB
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.map, np.uint8)[: len(out)]
    return out, bits


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


# --- pairs ---


def _add_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


def _count_pairs(words: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, fresh, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 17)].view(np.int64)), pa.array(n[a : a + (1 << 17)])], names=["key", "n"])

        for s in _slices(batches):
            fresh.append(s.pairs(has(words.value, s.key))[1])
            size += len(fresh[-1])
            if size > HELD:
                keys, n = _add_up(np.concatenate([keys, *fresh]), np.concatenate([n, np.ones(size, np.int64)]))
                fresh, size = [], 0
                if len(keys) > HELD:
                    yield from out()
                    keys, n = keys[:0], n[:0]
        keys, n = _add_up(np.concatenate([keys, *fresh]), np.concatenate([n, np.ones(size, np.int64)]))
        yield from out()

    return tidy(run)


# --- tries ---


def sorted_numbers(words: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of all lists in byte order, and the number of each word of each list."""
    coded = pa.concat_arrays(words).dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    cuts = np.cumsum([len(w) for w in words])[:-1]
    return coded.dictionary.take(pa.array(order)), np.split(number[coded.indices.to_numpy()], cuts)


class Trie:
    """Level d is (parent, word, count) of all paths of d + 1 words, sorted; a path of one word has its language for a parent."""

    def __init__(self, lang: np.ndarray, word: np.ndarray, left: np.ndarray, depth: int):
        """``left``: how many words there are from each to the end of its run."""
        base = int(word.max()) + 1 if len(word) else 1
        self.levels = []
        node, at = lang.astype(np.int64), np.arange(len(word))
        for d in range(depth):
            at = at[left[at] > d]
            seen, back, n = np.unique(node[at] * base + word[at + d], return_inverse=True, return_counts=True)
            self.levels.append((seen // base, seen % base, n))
            node[at] = back

    def paths(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (language, words, -1 where a path is shorter) of all paths of two words or more, and their counts."""
        above = np.zeros((0, 0), np.int32)
        out, counts = [], []
        for d, (parent, word, n) in enumerate(self.levels):
            rows = np.full((len(word), depth + 1), -1, np.int32)
            rows[:, : d + 1] = above[parent, : d + 1] if d else parent[:, None]
            rows[:, d + 1] = word
            above = rows
            if d:
                out.append(rows)
                counts.append(n)
        return np.concatenate(out), np.concatenate(counts).astype(np.int64)


def merge(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order (a path before those that go on from it) with their counts added up.

    The rows are some sorted runs, which the stable sorts merge; each column refines the order of those before it.
    """
    rank = np.zeros(len(rows), np.int64)
    for column in rows.T:
        key = rank * (int(column.max()) + 2) + column + 1 if len(column) else rank
        order = np.argsort(key, kind="stable")
        new = np.append(False, np.diff(key[order]) != 0)[: len(order)]
        rank[order] = np.cumsum(new)
    order = np.argsort(rank, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(rank[order]) != 0)) if len(order) else order
    return rows[order[first]], np.add.reduceat(counts[order], first) if len(first) else counts


BLOCK = "range long, langs array<string>, words array<string>, nodes binary"


def _blocks(rows: np.ndarray, counts: np.ndarray, ranges: np.ndarray, langs: pa.Array, words: pa.Array) -> Iterator[pa.RecordBatch]:
    """A row for each range: the words of its paths, and the paths as sorted columns of numbers."""
    order = np.lexsort([*rows.T[::-1], ranges])
    rows, counts, ranges = rows[order], counts[order], ranges[order]
    cuts = np.flatnonzero(np.append(True, np.diff(ranges) != 0)) if len(ranges) else []
    for a, b in zip(cuts, [*cuts[1:], len(ranges)], strict=True):
        used, back = np.unique(rows[a:b, 1:], return_inverse=True)
        back = back.reshape(b - a, -1)
        if used[0] < 0:
            used, back = used[1:], back - 1
        nodes = np.concatenate([rows[a:b, :1], back], axis=1).T.astype("<i4").tobytes() + counts[a:b].astype("<i8").tobytes()
        lists = [pa.array([x.to_pylist()], pa.list_(pa.string())) for x in (langs, _strings(words.take(pa.array(used))))]
        yield pa.RecordBatch.from_arrays([pa.array([int(ranges[a])]), *lists, pa.array([nodes], pa.binary())], names=["range", "langs", "words", "nodes"])


def _grow(words: Broadcast, pairs: Broadcast, ranges: int, depth: int):
    """Blocks of the tries of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            langs, lang = sorted_numbers([h[0] for h in held])
            texts, word = sorted_numbers([h[1] for h in held])
            lang = np.concatenate([m[h[2]] for m, h in zip(lang, held, strict=True)])
            word = np.concatenate([m[h[3]] for m, h in zip(word, held, strict=True)])
            key = np.concatenate([h[4] for h in held])
            runs = np.concatenate([h[5] for h in held])  # True where a run starts
            begin = np.flatnonzero(runs)
            left = np.repeat(np.append(begin[1:], len(runs)), np.diff(np.append(begin, len(runs)))) - np.arange(len(runs))
            rows, counts = Trie(lang, word, left, depth).paths(depth)
            # the key of each word in each language, which the ranges go by
            hashed = np.zeros((len(langs), len(texts)), np.uint64) if len(langs) * len(texts) <= HELD else None
            if hashed is not None:
                hashed[lang, word] = key
                of = lambda k: hashed[rows[:, 0], rows[:, k]]
            else:
                both, at = np.unique(lang * len(texts) + word, return_index=True)
                of = lambda k: key[at[np.searchsorted(both, rows[:, 0].astype(np.int64) * len(texts) + np.maximum(rows[:, k], 0)) % len(at)]]
            prefix = pair_keys(of(1), of(2))
            prefix = np.where(rows[:, 3] >= 0, pair_keys(prefix, of(3)), prefix) if depth > 2 else prefix
            yield from _blocks(rows, counts, (prefix % np.uint64(ranges)).astype(np.int64), langs, texts)

        for s in _slices(batches):
            at, keys = s.pairs(has(words.value, s.key))
            at = at[has(pairs.value, keys)]
            if not len(at):
                continue
            linked = np.zeros(len(s.word) + 1, bool)  # a word and the one before it are a frequent pair
            linked[at + 1] = True
            kept = np.flatnonzero(linked[:-1] | linked[1:])
            used, word = np.unique(s.word[kept], return_inverse=True)
            held.append((s.langs.cast(pa.binary()), s.words.take(pa.array(used)), s.lang[kept], word, s.key[kept], ~linked[kept]))
            size += len(kept)
            if size > GROWN:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return tidy(run)


PHRASES = "lang string, words array<string>, a long, walked array<long>"


def _merge_ranges(depth: int, least: int):
    """Frequent paths of each range, with the counts of their beginnings of three words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, size = None, [], 0

        def together() -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
            langs, lang = sorted_numbers([b[0] for b in blocks])
            words, word = sorted_numbers([b[1] for b in blocks])
            rows = []
            for l, w, b in zip(lang, word, blocks, strict=True):
                number = np.append(w, -1)  # -1 stays
                rows.append(np.concatenate([l[b[2][:, :1]], number[b[2][:, 1:]]], axis=1))
            return langs, words, *merge(np.concatenate(rows), np.concatenate([b[3] for b in blocks]))

        def out() -> pa.RecordBatch:
            langs, words, rows, counts = together()
            length = (rows[:, 1:] >= 0).sum(axis=1)
            parents = []  # of each path, the last one before it of each length
            for d in range(3, depth):
                parents.append(np.maximum.accumulate(np.where(length == d, np.arange(len(rows)), 0)))
            keep = np.flatnonzero(counts >= least)
            texts, walked = words.to_pylist(), []
            spelt = [[texts[i] for i in r if i >= 0] for r in rows[keep, 1:].tolist()]
            for i in keep.tolist():
                walked.append([int(counts[p[i]]) for p in parents[: max(0, length[i] - 3)]])
            lang = langs.take(pa.array(rows[keep, 0])).cast(pa.string())
            return pa.RecordBatch.from_arrays([lang, pa.array(spelt, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(counts[keep]), pa.array(walked, pa.list_(pa.int64()))], names=["lang", "words", "a", "walked"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.column(0)[i].as_py()
                if r != now and blocks:
                    yield out()
                    blocks, size = [], 0
                now = r
                langs, words = (batch.column(k)[i].values.cast(pa.binary()) for k in (1, 2))
                raw = batch.column(3)[i].as_py()
                n = len(raw) // (4 * (depth + 1) + 8)
                nodes = np.frombuffer(raw, "<i4", n * (depth + 1)).reshape(depth + 1, n).T.astype(np.int64)
                blocks.append((langs, words, nodes, np.frombuffer(raw, "<i8", n, 4 * (depth + 1) * n).astype(np.int64)))
                size += n
                if size > MERGED and len(blocks) > 1:
                    blocks = [together()]
                    size = len(blocks[0][3]) // 2  # so what doesn't shrink is not merged at each step
        if blocks:
            yield out()

    return tidy(run)


def mine_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str | None = "lang", depth: int = 5, least: int = 100, absorb: int = 100, top: int | None = 2000, filter_bits: int = 1 << 30) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``depth`` words seen ``least`` times.

    A phrase's score is that of its worst cut, floor(1000 a n / (l r)), ties to the shortest left part. A phrase within a
    longer one that is seen at least ``absorb`` of 100 times as often is left out. ``top`` None keeps all.

    Null languages are ``und`` (as is a language of that name); null and empty texts have no words, and a language whose
    texts have none has no rows. Repeated rows count each time; ties in score and count go by the phrase's bytes. Very
    long texts are counted whole; an empty table gives no rows; other columns are ignored, whatever their names. Products
    are exact up to 38 digits (corpora of some 10^17 words), and beyond that an error.
    """
    if depth < 2:
        raise ValueError("a phrase has two words at least")
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")) if lang_col else F.lit("und")
    slim = docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    sc = docs.sparkSession.sparkContext
    counted = slim.mapInArrow(tidy(_count_words), "lang string, word string, key long, n long")
    words = materialize(counted.groupBy("lang", "word").agg(F.max("key").alias("key"), F.sum("n").alias("n")), "words")
    sizes = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    frequent = words.where(F.col("n") >= least)
    word_bits = sc.broadcast(bit_map(frequent.select("key"), filter_bits)[0])
    pairs = slim.mapInArrow(_count_pairs(word_bits), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs.where(F.col("n") >= least).select("key"), "pairs")
    pair_bits = sc.broadcast(bit_map(pairs, filter_bits)[0])
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(LEAST_RANGES, -(-total // WORDS_PER_RANGE))
    blocks = slim.mapInArrow(_grow(word_bits, pair_bits, ranges, depth), BLOCK)
    merged = blocks.repartition("range").sortWithinPartitions("range").mapInArrow(_merge_ranges(depth, least), PHRASES)
    joined = lambda a: F.array_join(a, " ")
    named = merged.select("lang", joined("words").alias("phrase"), "words", F.size("words").alias("d"), "a", "walked")
    found = materialize(named, "phrases")
    discard(pairs)
    return _scored(found, frequent.select("lang", "word", "n"), sizes, absorb, top)


def _scored(found: DataFrame, words: DataFrame, sizes: DataFrame, absorb: int, top: int | None) -> DataFrame:
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    one = words.select("lang", F.col("word").alias("first"), F.col("n").alias("l1"))
    two = found.where("d = 2").select("lang", F.col("phrase").alias("two"), F.col("a").alias("l2"))
    pairs = found.where("d = 2").withColumn("lefts", F.array().cast("array<long>"))
    longer = found.where("d > 2").withColumn("two", part(1, 2)).join(two, ["lang", "two"])
    longer = longer.withColumn("lefts", F.concat(F.array("l2"), "walked")).select(pairs.columns)
    lefts = pairs.unionByName(longer).withColumn("first", F.col("words")[0]).join(one, ["lang", "first"])
    lefts = lefts.select("lang", "phrase", "words", "d", "a", F.concat(F.array("l1"), "lefts").alias("lefts"))
    # the right part of a cut after k words is where k suffix links lead
    cut = F.explode(F.sequence(F.lit(1), F.col("d") - 1)).alias("k")
    cuts = lefts.select("lang", "phrase", "words", "d", "a", "lefts", cut)
    cuts = cuts.select("lang", "phrase", "a", "k", F.col("lefts")[F.col("k") - 1].alias("l"), part(F.col("k") + 1, F.col("d") - F.col("k")).alias("right"))
    rights = found.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")).unionByName(words.select("lang", F.col("word").alias("right"), F.col("n").alias("r")))
    cuts = cuts.join(rights, ["lang", "right"]).join(sizes, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    product = (F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).alias("over")
    cuts = cuts.withColumn("over", product).withColumn("under", exact("l") * exact("r")).withColumn("score", F.expr("over div under"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("w")).select("lang", "phrase", "w.a", "w.l", "w.r", "w.n", "w.score")
    longer = found.where("d > 2")
    inside = longer.select("lang", part(1, F.col("d") - 1).alias("phrase"), "a").unionByName(longer.select("lang", part(2, F.col("d") - 1).alias("phrase"), "a"))
    # phrases of more than one word more are no more frequent than those of one, which are phrases, too
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = worst.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < absorb * F.col("a"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    ranked = left.withColumn("rank", rank)
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text <> ''
), cut AS (
  SELECT row, lang, unnest(regexp_split_to_array(text, '[.,;:!?\n-\r]')) AS piece FROM docs
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM cut
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, w[i:i + d - 1] AS words, d::BIGINT AS d FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS d) WHERE i + d - 1 <= len(w)
), counts AS (
  SELECT lang, words, array_to_string(words, ' ') AS phrase, d, count(*) AS f FROM grams GROUP BY lang, words, d
), sizes AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE d = 1 GROUP BY lang
), found AS (
  SELECT * FROM counts WHERE d > 1 AND f >= 100
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, d)) AS k FROM found) c
  JOIN counts l ON l.lang = c.lang AND l.words = c.words[1:k] JOIN counts r ON r.lang = c.lang AND r.words = c.words[k + 1:]
  JOIN sizes s ON s.lang = c.lang
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT q.lang, array_to_string(q.words[i:i + p - 1], ' ') AS phrase, q.f FROM found q, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3, 4]) AS p) WHERE p < q.d AND i + p - 1 <= q.d
), kept AS (
  SELECT * FROM worst w WHERE NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = w.lang AND x.phrase = w.phrase AND 100 * x.f >= 100 * w.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase::BLOB) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept
QUALIFY rank <= 2000
"""
