import base64
import hashlib
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from bitloom.llm import byte_bpe as B

from .. import oracle


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def book():
    return B.Vocabulary(B.default_path())


def brute(library, rows):
    out = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        out.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


piece = st.one_of(
    st.sampled_from(["'s", "'t", "'re", "'", "'r", "'l", "'ll", "ve", "s", "re", "l", " ", "  ", "\n", "\t ", " ", "　", "\x85", "é", "ß", "你", "٣", "12", "½", "!", "#'", "\U0001f600", "́", "\x1c", "\x00", "A", "<|endoftext|>"]),
    st.text(max_size=3),
)
texts = st.lists(piece, max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, max_size=6))
def test_pre_tokens_and_ids(book, library, rows):
    raw = [t.encode() for t in rows]
    off = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    cuts = [*B.boundaries(data, off, book.characters).tolist(), len(data)]
    if not any(unicodedata.category(c) == "Cn" for t in rows for c in t):  # the two libraries' Unicode tables may class newer characters unlike
        want = [p.encode() for t in rows for p in regex.findall(public_tokenizers.PATTERN, t)]
        assert [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] == want
    ids, at = book.encode(data, off)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode_ordinary(t) for t in rows]
    decoded, _ = book.decode(ids)
    assert decoded.tobytes() == data.tobytes()


def test_every_character_class(book):
    """All code points, between letters, digits, spaces and others, are split as by the library's pattern."""
    points = [c for c in map(chr, range(1, 0x110000)) if not "\ud800" <= c <= "\udfff"]
    text = "".join(points)
    B_ = book.characters
    B_.learn(np.array([ord(c) for c in points]))
    e = {c: {x for x in bytes(f.encode_ordinary(text)).decode()} for c, f in B_.find.items()}
    assert len(e[B.LETTER]) > 130_000 and not e[B.LETTER] & e[B.NUMBER] and {c for c in points if B_.of[ord(c)] == B.LETTER} == e[B.LETTER]
    assert {c for c in points if B_.of[ord(c)] == B.SPACE} == e[B.SPACE] and {c for c in points if B_.of[ord(c)] == B.NUMBER} == e[B.NUMBER]


def test_whole_table(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()]
    assert got(B.op11_byte_bpe(spark, oracle.SF)) == brute(library, docs)


HARD = [
    "don't we'll they've I'm it's " * 9, "'" * 300 + "s" * 300 + "'re" * 50, " " * 500 + "x" + "\n" * 400, "a" * 700 + " " + "b" * 90, "##" * 200 + "'start",
    "é你 " * 120 + "　" * 70 + "z", "123 456" * 60, "   'll  '  s " * 40, "ok", "", None, "\U0001f600" * 100 + " '" * 100,
]


@pytest.mark.parametrize(("chunk", "overlap"), [(18, 13), (40, 20), (100, 64), (64, 60)])
def test_stitching(spark, library, chunk, overlap):
    """Small chunks give the same ids as whole texts, with runs that outlast the overlap and borders within characters and contractions."""
    rng = np.random.default_rng(chunk)
    mix = ["'s", "'re", "'", "s", " ", "\n", "é", "7", "!", "word", "   ", "你"]
    rows = list(enumerate(HARD + ["".join(rng.choice(mix, 150)) for _ in range(40)]))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(B.digests(d, chunk=chunk, overlap=overlap)) == brute(library, rows)
    parts = B.encode(d, chunk=chunk, overlap=overlap).where("row is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    assert {r.doc_id: r.n for r in parts.collect()}[0] >= 3


def test_parts_and_decoding(spark, library):
    rows = [(i, t) for i, t in enumerate(HARD)]
    e = B.encode(spark.createDataFrame(rows, "doc_id long, text string"), chunk=100, overlap=50)
    ids, raw = {}, {}
    for r in sorted(e.collect(), key=lambda r: (r.doc_id, r.part)):
        ids.setdefault(r.doc_id, []).extend(r.ids)
    for r in sorted(B.decode(e).collect(), key=lambda r: (r.doc_id, r.part)):
        raw[r.doc_id] = raw.get(r.doc_id, b"") + bytes(r.bytes)
    assert ids == {i: library.encode_ordinary(t or "") for i, t in rows} and raw == {i: (t or "").encode() for i, t in rows}


def test_odd_rows(spark, library, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for chunk, overlap in ((B.CHUNK, B.OVERLAP), (50, 30)):
        assert got(B.digests(odd_docs, chunk=chunk, overlap=overlap)) == brute(library, rows)
    assert got(B.digests(no_docs)) == [] == got(B.encode(no_docs))


def test_long_texts(spark, library, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(1, "".join(rng.choice(["word ", "it's ", "12", "\n\n", "é"], 400_000))), (2, "x" * 300_000), (2, "x" * 300_000), (None, "y z " * 50_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(B.digests(d)) == brute(library, rows)


def test_no_utf8(spark, library):
    d = spark.range(2).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('61FFC3') as string)").alias("text"))
    assert got(B.digests(d)) == brute(library, [(0, "a��"), (1, "a��")])


def test_digest_steps(spark, library, monkeypatch):
    """Rows of more ids than are decoded at a time."""
    import pyarrow as pa

    monkeypatch.setattr(B, "STEP", 5)
    lists = [library.encode_ordinary(t) for t in ("a b c", "", "one two three four five six seven eight nine ten eleven", "x", "it's 12 o'clock now")]
    batch = pa.RecordBatch.from_arrays([pa.array([None, None, 7, 7, 8], pa.int64()), pa.array([1, 2, 3, 3, 4]), pa.array([0, 0, 0, 1, 0]), pa.array(lists, pa.list_(pa.int32()))], names=["row", "id", "part", "ids"])
    rows = [r for b in B._digests(B.default_path())(iter([batch.slice(0, 3), batch.slice(3)])) for r in b.to_pylist()]
    want = [(1, lists[0]), (2, []), (3, lists[2] + lists[3]), (4, lists[4])]
    assert [(r["id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows] == [(d, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(x)).hexdigest()) for d, x in want]
