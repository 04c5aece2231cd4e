"""SimHash near-duplicates linked through vantage-point trees.

Fingerprints: XXH64 (seed 42) of every 4-word shingle of the whole text; a bit is 1 if it is
set in over half of the hashes. Two texts are linked when their fingerprints differ in at most
``radius`` = 4 bits; components of links are found exactly.

Search. The 64 bits are cut into three segments; two fingerprints within 4 bits agree up to 1 bit in
one of them at least, and the Hamming distance over a segment is itself a metric. So for each segment

* a top vantage-point tree, fitted on a sample of some 16 fingerprints per leaf, cuts the space into
  shards by distance to vantage points (inside: d <= mu, outside: d > mu). Where a segment can't cut
  further, as in a large group of near copies, the distance over all 64 bits does;
* each distinct fingerprint lives in one home shard, and by the triangle bound it also queries every
  shard that its ball (radius 1, or 4 over all bits) may overlap (d <= mu + r and d + r > mu), in
  one of the two directions of a pair;
* within a shard another vantage-point tree is built and searched with the same pruning; leaves
  compare all 64 bits.

Every pair within 4 bits therefore meets in at least one shard; nothing is capped. A shard emits
only a spanning forest of its links (at most one edge per fingerprint), never all pairs of a
group. Exact copies share one fingerprint and are one node.

Scale: the tree depth follows the number of distinct fingerprints, and the sample the depth (up to
``SAMPLE`` fingerprints, 32 MB, so up to some 262,144 shards a segment), so that shards keep their size;
sample medians adapt the cuts to dense regions. A level of the tree multiplies the visits of a fingerprint by about 1.3:
10 at depth 6, 48 at depth 12 (measured). Components use alternating large-star and small-star rounds on
DataFrames, with minima pre-aggregated and written before they are joined back, so that AQE can split the rows
of a hub or of a very large component. The driver sees the sample, counts and checksums only.

Rows: a null or empty text has fingerprint 0; very long texts are read whole; equal rows are one node and each
give a row; of a component the least id names it (ties can't be); an empty table gives no rows; columns besides
the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import discard, flat_text, materialize, pieces, tidy

SEED, WORDS, RADIUS = 42, 4, 4
#: Bits where segments end.
EDGES = (0, 21, 42, 64)
SEGMENTS = len(EDGES) - 1
SAMPLE = 1 << 22
#: Bit b of a byte value, spread to byte lane b of a 64-bit word.
_LANES = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], np.uint64)


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """uint64 fingerprints of texts given as flat UTF-8 bytes and offsets."""
    raw = data.tobytes()
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    count = np.zeros(len(off) - 1, np.int64)
    for i in range(len(off) - 1):
        words = raw[off[i] : off[i + 1]].lower().split()  # ASCII letters and ASCII white space only, as these are bytes
        if not words:
            continue
        if len(words) <= WORDS:
            hashes.append(digest(b" ".join(words), SEED))
            count[i] = 1
            continue
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[: -WORDS])).tolist()
        text = b" ".join(words)
        hashes += [digest(text[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist(), strict=True)]
        count[i] = len(words) - WORDS + 1
    out = np.zeros(len(count), np.uint64)
    if not hashes:
        return out
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    full = np.flatnonzero(count)
    begin = np.cumsum(count) - count
    # runs of at most 255 hashes of one text, whose bit counts fit byte lanes
    runs = -(-count[full] // 255)
    first = np.cumsum(runs) - runs
    at = np.repeat(begin[full], runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
    sums = np.empty((len(at), 8), np.uint64)
    for k in range(8):
        sums[:, k] = np.add.reduceat(_LANES[octets[:, k]], at)
    bits = np.add.reduceat(sums.view(np.uint8).reshape(len(at), 64).astype(np.int64), first, axis=0)
    on = 2 * bits > count[full][:, None]
    out[full] = np.packbits(on, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            fp = fingerprints(*flat_text(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"])


def add_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and text_hash (XXH64 of the whole text) of every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.withColumn("text_hash", F.xxhash64("text")).mapInArrow(tidy(_fingerprint), "doc_id long, fp long, text_hash long")


# --- vantage-point trees -------------------------------------------------------------------


def _segment(fp: np.ndarray, k: int) -> np.ndarray:
    return (fp >> np.uint64(EDGES[k]) & np.uint64((1 << EDGES[k + 1] - EDGES[k]) - 1)).astype(np.uint32)


def _values(fp: np.ndarray, k: int, whole: bool) -> np.ndarray:
    return fp if whole else _segment(fp, k)


def _choose(points: np.ndarray, reach: int, rng: np.random.Generator, tries: int = 12) -> tuple[np.unsignedinteger, int] | None:
    """A vantage point and cut that leave the fewest points near the cut; None if all distances agree."""
    best = None
    for v in points[rng.integers(0, len(points), tries)]:
        d = np.bitwise_count(points ^ v)
        mu = int(np.median(d))
        for cut in (mu - 1, mu):
            inside = int(np.count_nonzero(d <= cut))
            if not inside or inside == len(points):
                continue
            near = np.count_nonzero((d > cut - reach) & (d <= cut + reach))
            cost = near + abs(2 * inside - len(points))
            if best is None or cost < best[0]:
                best = (cost, v, cut)
    return best and (best[1], best[2])


def _cut(fp: np.ndarray, k: int, radius: int, rng: np.random.Generator, tries: int = 12) -> tuple[np.unsignedinteger, int, bool] | None:
    """A vantage point, a cut and whether they are over all bits, which is so where segment ``k`` can't cut; None if nothing can."""
    for whole in (False, True):
        pick = _choose(_values(fp, k, whole), radius if whole else radius // SEGMENTS, rng, tries)
        if pick is not None:
            return *pick, whole
    return None


def fit_tree(fp: np.ndarray, k: int, depth: int, radius: int = RADIUS, seed: int = 1) -> list:
    """Nested (vantage, cut, inside, outside, over all bits) for segment ``k``; a leaf is its shard number."""
    rng = np.random.default_rng(seed)
    shards = [0]

    def grow(p: np.ndarray, depth: int):
        pick = _cut(p, k, radius, rng) if depth and len(p) >= 8 else None
        if pick is None:
            shards[0] += 1
            return shards[0] - 1
        v, cut, whole = pick
        d = np.bitwise_count(_values(p, k, whole) ^ v)
        return [int(v), cut, grow(p[d <= cut], depth - 1), grow(p[d > cut], depth - 1), whole]

    return grow(fp, depth)


def route(tree, fp: np.ndarray, k: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, is home) of all visits."""
    rows, shards, homes = [], [], []
    segment = _segment(fp, k)
    todo = [(tree, np.arange(len(fp)), np.ones(len(fp), bool))]
    while todo:
        node, i, home = todo.pop()
        if not len(i):
            continue
        if not isinstance(node, list):
            rows.append(i)
            shards.append(np.full(len(i), node, np.int32))
            homes.append(home)
            continue
        values = fp if node[4] else segment
        reach = radius if node[4] else radius // SEGMENTS
        d = np.bitwise_count(values[i] ^ values.dtype.type(node[0])).astype(np.int64)
        inside = d <= node[1]
        near, far = d <= node[1] + reach, d + reach > node[1]
        todo.append((node[2], i[near], (home & inside)[near]))
        todo.append((node[3], i[far], (home & ~inside)[far]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


def _router(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                fp = whole.column(0).slice(at, 8192).to_numpy().view(np.uint64)
                for k, tree in enumerate(box.value):
                    row, shard, home = route(tree, fp, k)
                    own = np.empty(len(fp), np.int32)
                    own[row[home]] = shard[home]
                    # of two homes that a pair lies in, only the later one is queried
                    keep = home | (shard > own[row])
                    row, shard, home = row[keep], shard[keep], home[keep]
                    names = ["shard", "fp", "home"]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32) * SEGMENTS + k), pa.array(fp[row].view(np.int64)), pa.array(home)], names=names)

    return tidy(run)


class _Forest:
    """Union-find over local numbers with whole-array steps."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while True:
            q = self.up[r]
            if (q == r).all():
                break
            r = q
        self.up[i] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            open_ = a != b
            a, b = a[open_], b[open_]
            if not len(a):
                return
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def shard_links(fp: np.ndarray, home: np.ndarray, k: int, radius: int = RADIUS, leaf: int = 48) -> np.ndarray:
    """Spanning edges (two columns of uint64) of all pairs within ``radius`` of which one at least is at home here."""
    fp, inverse = np.unique(fp, return_inverse=True)
    at_home = np.zeros(len(fp), bool)
    at_home[inverse[home]] = True
    segment = _segment(fp, k)
    forest, rng = _Forest(len(fp)), np.random.default_rng(7)
    pairs: list[np.ndarray] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if pairs:
            both = np.concatenate(pairs, axis=1)
            forest.join(both[0], both[1])
            pairs.clear()
            waiting = 0

    todo = [(np.flatnonzero(at_home), np.arange(len(fp)))]
    while todo:
        points, queries = todo.pop()
        if not len(points) or not len(queries):
            continue
        pick = _cut(fp[points], k, radius, rng, 4) if len(points) > leaf else None
        if pick is None:
            step = max(1, (1 << 20) // len(points))
            for at in range(0, len(queries), step):
                q = queries[at : at + step]
                hit = np.bitwise_count(fp[q][:, None] ^ fp[points][None, :]) <= radius
                i, j = np.nonzero(hit)
                a, b = q[i], points[j]
                new = a != b
                if new.any():
                    pairs.append(np.stack([a[new], b[new]]))
                    waiting += int(np.count_nonzero(new))
                    if waiting > 1 << 20:
                        flush()
            continue
        v, cut, whole = pick
        values, reach = (fp, radius) if whole else (segment, radius // SEGMENTS)
        dp = np.bitwise_count(values[points] ^ v)
        dq = np.bitwise_count(values[queries] ^ v).astype(np.int64)
        todo.append((points[dp <= cut], queries[dq <= cut + reach]))
        todo.append((points[dp > cut], queries[dq + reach > cut]))
    flush()
    every = np.arange(len(fp))
    root = forest.root(every)
    linked = root != every
    return np.stack([fp[linked], fp[root[linked]]], axis=1)


def _group(key, table):
    fp = table.column("fp").to_numpy().view(np.uint64)
    edges = shard_links(fp, table.column("home").to_numpy(zero_copy_only=False).astype(bool), int(key[0].as_py()) % SEGMENTS)
    return pa.table({"a": edges[:, 0].copy().view(np.int64), "b": edges[:, 1].copy().view(np.int64)})


def fit_trees(nodes: DataFrame, n: int, depth: int) -> list:
    """A tree for each segment from a sample of the ``n`` distinct fingerprints, chosen by their hash."""
    if not depth:
        return [0] * SEGMENTS
    share = min(1.0, min(SAMPLE, max(4096, 16 << depth)) / n)
    some = nodes.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(share * (1 << 40))).toArrow().column("fp").to_numpy()
    some = np.sort(some.view(np.uint64))
    return [fit_tree(some, k, depth) for k in range(SEGMENTS)]


def fingerprint_links(nodes: DataFrame, *, shard_size: int | None = None) -> DataFrame:
    """Edges (a, b) spanning all links between the distinct values of column ``fp``.

    Unless given, shards are home to a 256th of the fingerprints, between 4,096 and 131,072.
    """
    n = nodes.count()
    shard_size = shard_size or max(4096, min(131072, n // 256))
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard_size))))
    box = nodes.sparkSession.sparkContext.broadcast(fit_trees(nodes, n, depth))
    routed = nodes.select("fp").mapInArrow(_router(box), "shard int, fp long, home boolean")
    return routed.groupBy("shard").applyInArrow(_group, "a long, b long")


# --- components ----------------------------------------------------------------------------


def components(edges: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); root is the least node of its component.

    Alternating large-star and small-star rounds; each is written to the shared folder, and tables
    of rounds that are done are deleted. Minima are pre-aggregated and written, so a join that brings a hub's
    minimum back to its rows is one of plain scans, which AQE can split.
    """
    state = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    check = None
    for _ in range(max_rounds):
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == check or not now[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select("v", "v").distinct())
        check = now
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        discard(least, state)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        state = materialize(small.where("u <> v").distinct(), "edges")
        discard(least, large)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _labelled(docs: DataFrame, id_col: str, text_col: str, shard_size: int | None) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, root, component_id) of each distinct one."""
    prints = materialize(add_fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = materialize(components(fingerprint_links(nodes, shard_size=shard_size)), "components")
    named = materialize(nodes.join(found, nodes.fp == found.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "named")
    # only components of several fingerprints have a name to find; their rows are joined to a written table, so AQE can split them
    first = materialize(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    label = named.join(first, "root", "left").select("fp", "root", F.coalesce("component_id", "rep").alias("component_id"))
    label = materialize(label, "labels")
    discard(nodes, found, named, first)
    return prints, label


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_size: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach).

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with a null id are
    kept, but never name a component: one of them alone has a null component_id. Repeated rows each
    give a row. An empty table gives no rows.
    """
    prints, label = _labelled(docs, id_col, text_col, shard_size)
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(label, "fp").select("doc_id", hex_.alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_size: int | None = None) -> DataFrame:
    """(doc_id, text_hash) of one document of each component: the least id (nulls last), of rows with that id the least hash.

    Components are told apart by their root, not by a name, so rows with one id and unlike texts each stand for theirs.
    """
    prints, label = _labelled(docs, id_col, text_col, shard_size)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = prints.join(label, "fp").groupBy("root").agg(F.min(order).alias("first"))
    return first.select("first.doc_id", "first.text_hash")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
