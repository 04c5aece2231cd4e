import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from bitloom.llm import fill_middle as FM

from .. import oracle

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text, rate=50, spm=80):
    """n, form, prefix_chars, middle_chars, output by the contract's words."""
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def seeds_of(ids):
    import numpy as np

    d = [hashlib.sha256(f"42:{i}".encode()).hexdigest() for i in ids]
    return np.array([[int(x[8 * k : 8 * k + 8], 16) for x in d] for k in range(4)], np.int64)


piece = st.sampled_from(["a", "bc ", " ", "\n\t", "é", "你好", "<", "P", ">", "<S", "<M>", "\x85", "\x1c", "\U0001f600", "\x00"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(piece, max_size=12).map("".join), min_size=1, max_size=8), st.integers(0, 50))
def test_kernel(texts, base):
    ids = list(range(base, base + len(texts)))
    for rate, spm in ((50, 80), (100, 50)):
        got = FM._batch(pa.array(texts), seeds_of(ids), rate, spm)
        assert list(zip(*(c.to_pylist() for c in got), strict=True)) == [brute(i, t, rate, spm) for i, t in zip(ids, texts, strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(piece, min_size=1, max_size=40).map("".join), st.integers(0, 50), st.integers(1, 9))
def test_windows(text, doc, window):
    """A long text gives the same in windows of any size, also cut within characters."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(FM, "WINDOW", window)
        got = FM._long(pa.array([text]), seeds_of([doc]), 100, 50)
    assert tuple(c.to_pylist()[0] for c in got) == brute(doc, text, 100, 50)


def test_sql(spark):
    got = FM.op13_fill_middle(spark, oracle.SF)
    assert oracle.rows(got) == oracle.expected(FM.OP13_SQL)
    forms = {r.form: r["count"] for r in got.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm", "psm"}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    want = {r.doc_id: (brute(r.doc_id, r.text), r.text) for r in docs.collect()}
    rows = FM.op13_fill_middle(spark, oracle.SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        (n, form, p, m, out), text = want[r.doc_id]
        assert tuple(r)[1:] == (n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_odd_rows(spark, odd_docs, no_docs):
    for rate, spm in ((50, 80), (100, 0), (100, 100)):
        out = FM.fill_in_middle(odd_docs, rate=rate, spm=spm).withColumn("back", FM.restored(F.col("output"), F.col("form")))
        got = sorted((tuple(r) for r in out.collect()), key=repr)
        assert got == sorted(((r.doc_id, *brute(r.doc_id, r.text, rate, spm), r.text or "") for r in odd_docs.collect()), key=repr)
    assert FM.fill_in_middle(no_docs).collect() == []


def test_long_text(spark):
    text = "word é\n" * 500_000 + "<P" + " end  "
    d = spark.createDataFrame([(i, text) for i in (1, 2)], "doc_id long, text string")
    out = FM.fill_in_middle(d, rate=100, spm=50).withColumn("back", FM.restored(F.col("output"), F.col("form"))).collect()
    for r in out:
        assert tuple(r)[1:-1] == brute(r.doc_id, text, 100, 50) and r.back == text


def test_marks_beside_cuts(spark):
    """Parts that end or begin with pieces of marks are still told apart."""
    rows = [(i, "<P <S <M > S> a <" * (i % 3 + 1) + " M> <") for i in range(60)]
    out = FM.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=100, spm=50).withColumn("back", FM.restored(F.col("output"), F.col("form")))
    assert sorted((r.doc_id, r.back) for r in out.collect()) == rows
