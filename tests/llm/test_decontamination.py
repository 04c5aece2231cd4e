import hashlib
import re
import tracemalloc

import numpy as np
import pytest

from bitloom.llm.decontamination import Matcher, decontaminate, op2_decontamination

from .. import oracle

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, window=10):
    patterns = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for s in [w] if 0 < len(w) < window else [w[k : k + window] for k in range(len(w) - window + 1)]:
            patterns.setdefault(tuple(s), set()).add(str(i))
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(p) for p in patterns}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in patterns:
                    hit.update(range(k, k + n))
                    found |= patterns[tuple(w[k : k + n])]
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_whole_tables(spark):
    got = sorted(map(tuple, op2_decontamination(spark, oracle.SF).collect()), key=repr)
    c = oracle.connect()
    want = brute(c.execute("SELECT doc_id, text FROM documents").fetchall(), c.execute("SELECT item_id, text FROM benchmark").fetchall())
    assert got == want and sum(r[5] for r in want) > 0


@pytest.mark.parametrize(("block_bytes", "part_bytes", "at_once"), [(1 << 20, 1 << 20, 4), (60, 1 << 20, 1000), (60, 15, 1000), (200, 15, 2), (60, 1 << 20, 3)])
def test_random_small_vocabulary(spark, block_bytes, part_bytes, at_once):
    """Many overlapping windows and short items; also with the benchmark cut into several passes."""
    rng = np.random.default_rng(5)
    words = ["aa", "B", "c1", "ü", "dd", "aa-b"]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 900, 25))]
    items = [(i, text(int(n))) for i, n in enumerate([0, 1, 2, 3, 4, 5, 12, 14, 10])] + [(3, text(11)), (99, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(df, b, window=4, block_bytes=block_bytes, part_bytes=part_bytes, blocks_at_once=at_once).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items, 4)


def test_odd_rows(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, None), (None, "one"), (3, "one")], "item_id long, text string")
    got = decontaminate(odd_docs, b).collect()
    assert len(got) == odd_docs.count() and set(odd_docs.columns) <= set(got[0].asDict())
    assert [(r.n_hit, r.items) for r in got if r.text and r.text.startswith("a b")] == [(10, "1")] * 4
    assert [r.contaminated for r in got if r.text in ("one", "One")] == [True, True]
    assert decontaminate(no_docs, b).count() == 0
    passes = decontaminate(odd_docs, b, block_bytes=5, blocks_at_once=1)
    assert sorted(map(repr, passes.collect())) == sorted(map(repr, got)) and decontaminate(no_docs, b, block_bytes=5, blocks_at_once=1).count() == 0
    assert {r.n_hit for r in decontaminate(odd_docs, b.where("false")).collect()} == {0}


def test_skips_positions():
    m = Matcher([(1, " ".join(f"w{i}" for i in range(30)))])
    assert float(np.mean(m.tables[0].shift)) > 8.5


def test_memory_of_the_index_is_in_proportion():
    """Some ten times the text, whatever it holds, and repeated items take no more."""
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 200_000, 2000))) for i in range(150)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    m = Matcher(items + items)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(m.names) == 150 and held < 16 * size + (64 << 20) and peak < 40 * size + (96 << 20), (size, held, peak)


def test_one_long_item_is_many_blocks(spark):
    words = [f"w{i * i % 7919}" for i in range(9000)]
    b = spark.createDataFrame([(1, " ".join(words))] * 3, "item_id long, text string")
    docs = [(i, " ".join(words[k : k + 14])) for i, k in enumerate(range(0, 8980, 97))] + [(999, " ".join(words[5:14])), (1000, " ".join(words))]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), b, block_bytes=9000, part_bytes=2000).collect()
    assert [r.n_hit for r in sorted(got, key=lambda r: r.doc_id)] == [14] * (len(docs) - 2) + [0, 9000] and {r.items for r in got} == {"1", ""}
