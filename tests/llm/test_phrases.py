import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitloom.llm import phrases as P

from .. import oracle

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, depth=5, least=100, absorb=100, top=2000):
    """The contract, phrase by phrase."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(w)
            for i in range(len(w)):
                for d in range(1, depth + 1):
                    if i + d <= len(w):
                        f[lang][w[i : i + d]] += 1
    out = []
    for lang, count in f.items():
        found = {w: a for w, a in count.items() if len(w) > 1 and a >= least}
        within = defaultdict(int)
        for w, a in found.items():
            for i in range(len(w)):
                for j in range(i + 2, len(w) + 1):
                    if j - i < len(w):
                        within[w[i:j]] = max(within[w[i:j]], a)
        rows_ = []
        for w, a in found.items():
            if within[w] and 100 * within[w] >= absorb * a:
                continue
            score, k = min((1000 * a * n[lang] // (count[w[:k]] * count[w[k:]]), k) for k in range(1, len(w)))
            rows_.append((-score, -a, " ".join(w).encode(), count[w[:k]], count[w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.lang, r.text) for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()]


def test_sql(spark):
    found = P.op12_phrases(spark, oracle.SF)
    assert oracle.rows(found) == oracle.expected(P.OP12_SQL) and found.count() > 0


@pytest.mark.parametrize(("depth", "least", "absorb", "top"), [(5, 4, 100, 2000), (3, 6, 50, 20), (2, 3, 100, None), (5, 10, 80, 5)])
def test_whole_table(spark, rows, depth, least, absorb, top):
    d = spark.createDataFrame(rows, "lang string, text string")
    want = brute(rows, depth, least, absorb, top)
    assert got(P.mine_phrases(d, depth=depth, least=least, absorb=absorb, top=top)) == want and len(want) > 10


def test_small_tries(spark, rows, monkeypatch):
    """Many tries in a task, many merges in a range and full bit maps give the same counts."""
    d = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = brute(rows, least=5)
    for name, value in (("HELD", 200), ("MERGED", 50), ("LEAST_RANGES", 2), ("WORDS_PER_RANGE", 1 << 40), ("LEAST_BITS", 1 << 15)):
        monkeypatch.setattr(P, name, value)
    assert got(P.mine_phrases(d, least=5, filter_bits=1 << 15)) == want


def test_merge():
    rng = np.random.default_rng(5)
    for _ in range(30):
        runs, want = [], Counter()
        for _ in range(int(rng.integers(1, 6))):
            r = np.unique(rng.integers(-1, 3, (int(rng.integers(1, 20)), 4)), axis=0)
            runs.append((r, rng.integers(1, 9, len(r))))
            for path, n in zip(map(tuple, r.tolist()), runs[-1][1].tolist(), strict=True):
                want[path] += n
        rows, counts = P.merge(np.concatenate([r for r, _ in runs]), np.concatenate([n for _, n in runs]))
        assert list(zip(map(tuple, rows.tolist()), counts.tolist(), strict=True)) == sorted(want.items())


def test_bits(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789, 1 << 20, (1 << 20) - 1, 32767, 32768]
    bits, size = P.bit_map(spark.createDataFrame([(k,) for k in keys], "key long"), 1 << 22)
    assert size == 1 << 20 and P.has(bits, np.array(keys, np.int64).view(np.uint64)).all()
    assert int(np.unpackbits(bits).sum()) == len({k % size for k in keys})


def test_odd_rows(spark, odd_docs, no_docs):
    d = odd_docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit("und")).when(F.col("doc_id") == 5, F.lit("")).when(F.col("doc_id") == 7, F.lit("xx")))
    rows = [(r.lang, r.text) for r in d.collect()]
    assert got(P.mine_phrases(d, least=1, absorb=200)) == brute(rows, least=1, absorb=200)
    assert got(P.mine_phrases(d, least=2)) == brute(rows, least=2)
    assert got(P.mine_phrases(no_docs.withColumn("lang", F.lit("en")))) == []
    assert got(P.mine_phrases(odd_docs, lang_col=None, least=2)) == brute([(None, t) for _, t in rows], least=2)


def test_words_that_sort_before_a_space(spark):
    """Bytes below a space, and one language beside another with the same words."""
    rows = [("a", "x\x01 y x \x02 y x\x00 x y. x y\x1c x\ty  X Y")] * 3 + [("b", "x y x y")] * 4 + [("é", "x y")]
    d = spark.createDataFrame(rows, "lang string, text string")
    assert got(P.mine_phrases(d, least=2)) == brute(rows, least=2)


def test_exact_products(spark):
    """Counts whose products pass 64 bits."""
    big = 3 * 10**15 + 7
    found = spark.createDataFrame([("en", "x y", ["x", "y"], 2, big, [])], P.PHRASES.replace("words", "phrase string, words").replace("a long", "d int, a long"))
    words = spark.createDataFrame([("en", "x", big + 5), ("en", "y", big * 2)], "lang string, word string, n long")
    sizes = spark.createDataFrame([("en", big * 30)], "lang string, n long")
    row = P._scored(found, words, sizes, 100, 10).first()
    assert row.score == 1000 * big * (big * 30) // ((big + 5) * (big * 2)) and (row.l, row.r) == (big + 5, 2 * big)


def test_slice():
    s = P.Slice(pa.array(["en", "en"]), pa.array(["A b. c  d", "e"]))
    assert [s.words[i].as_py() for i in s.word] == [b"a", b"b", b"c", b"d", b"e"] and s.follows.tolist() == [False, True, False, True, False]


def test_paths_take_four_bytes_a_word():
    """All paths of a trie are in memory at once, so their numbers are 32-bit ones, and few words are grown into one trie."""
    zero = np.zeros(4, np.int64)
    rows, counts = P.Trie(zero, np.array([0, 1, 0, 1]), np.array([4, 3, 2, 1]), 3).paths(3)
    assert rows.dtype == np.int32 and P.GROWN < P.HELD
    assert sorted(map(tuple, np.column_stack([rows, counts]).tolist())) == [(0, 0, 1, -1, 2), (0, 0, 1, 0, 1), (0, 1, 0, -1, 1), (0, 1, 0, 1, 1)]
