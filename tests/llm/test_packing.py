import functools
import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from bitloom.llm import packing as P
from bitloom.llm import tokens

from .. import oracle

ODD = ["", "  a  b ", None, "It's <|endoftext|> a<|startoftext|>b x", "é x\x85y\x1cz  　q", "́ lead ́", "Café CAFÉ don't 123abc!!! \n\t\x0b\x0c\r end", "ΣΑΣ Σ", "�\U0001F389\U0001F389 émoji", "<|x|> <| <|ENDOFTEXT|>", "a" * 5000, "rock'n'roll we're 'S 'S a.b,c..d ., e", "יִ ﬀ Å ｆｕｌｌ 한글"]


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


@pytest.mark.parametrize("batch", [ODD, [t for t in ODD if not t or "<|" not in t]])
def test_ids_are_the_librarys(batch):
    t = tokens.ChunkTokenizer(tokens.default_path())
    for _ in range(2):  # new chunks, then known ones
        ids, off = t.encode(pa.array(batch, pa.string()))
        for i, text in enumerate(batch):
            assert ids[off[i] : off[i + 1]].tolist() == library().encode(text or "", add_special_tokens=False).ids, text


def test_forgetting_chunks(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_LIMIT", 50)
    t = tokens.ChunkTokenizer(tokens.default_path())
    for k in range(6):
        texts = [f"word{i} number{i * k} Mixed{i}." for i in range(30)]
        ids, off = t.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(off)] == [library().encode(x, add_special_tokens=False).ids for x in texts]


def least_bins(lengths, size):
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= size:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_packing(lengths):
    n = np.array(lengths)
    bins, offsets, fill = P.best_fit_decreasing(n, 20)
    bound, least = P.lower_bound(np.bincount(n, minlength=21), 20), least_bins(sorted(lengths, reverse=True), 20)
    assert bound <= least <= len(fill) and (fill <= 20).all()
    for b in range(len(fill)):
        spans = sorted((o, o + x) for o, x, k in zip(offsets.tolist(), lengths, bins.tolist(), strict=True) if k == b)
        assert [s[0] for s in spans] == [0, *(s[1] for s in spans[:-1])] and spans[-1][1] == fill[b]


def check(rows, docs, size=2048):
    """Every id of every document is in one place; sequences have no gap."""
    encode = library()
    want = {}
    for d, t in docs:
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            key = (d, k // size, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            want[key] = want.get(key, 0) + 1
    got, sequences = {}, {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for spans in sequences.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= size
    return len(sequences)


@pytest.mark.parametrize("group_size", [50_000, 60])
def test_whole_table(spark, group_size):
    d = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    packed = P.pack_documents(d, group_size=group_size)
    used = check(packed.collect(), [(r.doc_id, r.text) for r in d.collect()])
    n, bound = P.certificate(packed)
    assert n == used and bound <= used <= bound + (1 if group_size > 1000 else 4)


def test_exchange_between_groups(spark):
    """Groups whose last sequences are part-filled give these up, and the total comes to the bound."""
    rng = np.random.default_rng(2)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 900, 3000))]
    found = spark.createDataFrame(rows, P.PIECE)
    alone = P.pack(found, group_size=100, max_rounds=1)
    together = P.pack(found, group_size=100)
    assert P.certificate(together)[0] < P.certificate(alone)[0] and P.certificate(together)[0] <= P.certificate(together)[1] + 4
    assert together.count() == 3000


def test_odd_rows(odd_docs, no_docs):
    check(P.pack_documents(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert P.pack_documents(no_docs).count() == 0


def test_one_id_for_all_rows_spreads_over_the_groups(spark):
    """Equal and null ids with one piece number are dealt like any others."""
    found = spark.range(3000).selectExpr("if(id % 2 = 0, 7L, cast(null as long)) doc_id", "0 piece", "0L start", "1 + id % 900 length", "0L ids_crc32")
    packed = P.pack(found, group_size=300)
    assert packed.count() == 3000
    used, bound = P.certificate(packed)
    assert bound <= used <= bound + 2
    sequences = packed.groupBy(P.F.floor(P.F.col("sequence_id") / 2**24).alias("group")).count().collect()
    assert max(r["count"] for r in sequences) < 450  # no group took more than its share
