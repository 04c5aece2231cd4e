import re

import numpy as np
import pytest
import xxhash

from bitloom.llm import simhash as S
from bitloom.llm.common import flat_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    w = WORD.findall((text or "").translate(LOW))
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    prints = np.array([brute_print(t) for _, t in rows], np.uint64)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 4):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[root(i)] = min(groups.get(root(i), d), d)
    return sorted(((d, f"{int(prints[i]):016x}", groups.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("shard_size", [64, None])
def test_whole_table(spark, shard_size):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, S.near_duplicates(d, shard_size=shard_size).collect()), key=repr)
    assert got == brute_components([(r.doc_id, r.text) for r in d.collect()])


def test_chains_of_close_fingerprints():
    """All pairs within 4 bits are found by the trees, however the space is cut."""
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 40).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    fps = [s for s in seeds for _ in range(1)]
    for s in seeds:
        for _ in range(30):
            s = s ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 6)).astype(np.uint64))
            fps.append(s)
    fps = np.unique(np.array(fps, np.uint64))
    want = {(min(a, b), max(a, b)) for i, a in enumerate(fps.tolist()) for b in fps[:i][np.bitwise_count(fps[:i] ^ fps[i]) <= 4].tolist()}
    up = {x: x for x in fps.tolist()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for half in range(S.SEGMENTS):
        tree = S.fit_tree(fps, half, 5)
        row, shard, home = S.route(tree, fps, half)
        assert np.bincount(row[home], minlength=len(fps)).tolist() == [1] * len(fps)
        for k in np.unique(shard):
            for a, b in S.shard_links(fps[row[shard == k]], home[shard == k], half, leaf=8).tolist():
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert all(root(a) == root(b) for a, b in want)
    found = {x: root(x) for x in up}
    up = {x: x for x in up}
    for a, b in want:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert found == {x: root(x) for x in up}


def test_components(spark):
    path = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (7, 7)] + [(500, i) for i in range(501, 600)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[102] == 100 and got[599] == 500 and len(got) == 60 + 3 + 100
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_runs_of_shingles():
    import pyarrow as pa

    texts = [" ".join(f"w{i * k % 977}" for i in range(n)) for k, n in ((3, 2000), (5, 259), (7, 258), (1, 3))]
    assert S.fingerprints(*flat_text(pa.array(texts))).tolist() == [brute_print(t) for t in texts]


def test_odd_rows(odd_docs, no_docs):
    got = sorted(map(tuple, S.near_duplicates(odd_docs).collect()), key=repr)
    assert got == brute_components([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert S.near_duplicates(no_docs).count() == 0


def leaves(tree):
    return leaves(tree[2]) + leaves(tree[3]) if isinstance(tree, list) else 1


def test_leaves_double_with_depth():
    """With a sample in proportion, the tree keeps cutting, also within one dense group of near copies."""
    rng = np.random.default_rng(3)
    far = rng.integers(0, 2**63, 16 << 12).astype(np.uint64)
    sparse = [leaves(S.fit_tree(far, 0, d)) for d in (6, 8, 10, 12)]
    assert all(n >= 0.9 * 2**d for n, d in zip(sparse, (6, 8, 10, 12), strict=True)), sparse
    flips = np.uint64(1) << rng.integers(21, 64, (16 << 8, 12)).astype(np.uint64)
    near = np.unique(np.bitwise_xor.reduce(flips, axis=1))  # all alike in the first segment
    assert leaves(S.fit_tree(near, 0, 6)) >= 32


def test_groups_of_near_copies_are_searched_by_all_bits():
    rng = np.random.default_rng(3)
    fps = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(21, 64, (3000, 9)).astype(np.uint64), axis=1))
    edges = S.shard_links(fps, np.ones(len(fps), bool), 0)
    up = {x: x for x in fps.tolist()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges.tolist():
        up[root(a)] = root(b)
    for i in range(len(fps)):
        assert all(root(int(x)) == root(int(fps[i])) for x in fps[np.bitwise_count(fps ^ fps[i]) <= 4])


def test_representatives_tell_components_apart(spark):
    """One row per component; rows with one id, or none, and unlike texts each stand for theirs."""
    text = lambda k: " ".join(f"word{k * 31 + i * i % 97}" for i in range(60))
    rows = [(5, text(1)), (5, text(2)), (5, text(1)), (7, text(2)), (None, text(1)), (None, text(3)), (None, text(3)), (9, text(4))]
    got = S.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == ["5", "5", "9", "None"] and len({r.text_hash for r in got}) == 4
