import struct
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from pyarrow import fs as pafs

from bitloom.llm import simple8b, token_files as TF
from bitloom.llm.common import fresh_path

from .. import oracle
from .test_packing import library


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 1), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 20))
def test_coding_round_trip(values, times):
    v = np.array(values * times, np.uint64)
    words, at = simple8b.encode(v)
    assert (simple8b.decode(words, len(v)) == v).all()
    for b in range(len(at)):
        stop = int(at[b + 1]) if b + 1 < len(at) else len(words)
        part = v[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]
        assert (simple8b.decode(words[at[b] : stop], len(part)) == part).all()


def test_packed_small():
    assert len(simple8b.encode(np.ones(600, np.uint64))[0]) == 10
    assert len(simple8b.encode(np.zeros(1024, np.uint64))[0]) <= 9
    assert len(simple8b.encode(np.array([2**64 - 1], np.uint64))[0]) == 2


def check(rows, docs):
    encode, at, want = library(), 0, []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return sorted(map(tuple, rows), key=repr), sorted(want, key=repr)


def test_whole_table(spark):
    d = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    got, want = check(TF.op7_token_files(spark, oracle.SF).collect(), [(r.doc_id, r.text) for r in d.collect()])
    assert got == want


def test_small_files_and_single_documents(spark):
    d = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    uri = fresh_path(spark, "t")
    manifest = TF.write_token_files(d, uri, max_ids=20_000)
    assert manifest.count() > 3
    got, want = check(TF.read_token_files(spark, uri, manifest).collect(), [(r.doc_id, r.text) for r in d.collect()])
    assert got == want
    path = manifest.first().path
    reader = TF.Reader(pafs.LocalFileSystem(), path)
    text = {r.doc_id: r.text for r in d.collect()}
    for k in (0, 1, len(reader.doc_ids) - 1):
        assert reader.document(k).tolist() == [*library().encode(text[int(reader.doc_ids[k])], add_special_tokens=False).ids, 2]


def test_odd_rows(spark, odd_docs, no_docs):
    uri = fresh_path(spark, "t")
    rows = TF.read_token_files(spark, uri, TF.write_token_files(odd_docs, uri)).collect()
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got, want = check(rows, docs)
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in want) and sum(r[2] for r in got) == sum(r[2] for r in want)
    spans = sorted((r[1], r[1] + r[2]) for r in got)
    assert [s[0] for s in spans] == [0, *(s[1] for s in spans[:-1])]
    uri = fresh_path(spark, "t")
    assert TF.read_token_files(spark, uri, TF.write_token_files(no_docs, uri)).count() == 0


def test_one_id_for_all_rows(spark):
    """Rows with one id are split over tasks, and their order is the same however the table is dealt."""
    texts = [f"text number {i % 50}" for i in range(600)]
    d = spark.createDataFrame([(7 if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for parts in (3, 5):
        uri = fresh_path(spark, "t")
        manifest = TF.write_token_files(d.repartition(parts), uri)
        assert manifest.count() > 1 and max(r.n_docs for r in manifest.collect()) < 400
        found.append(sorted(map(tuple, TF.read_token_files(spark, uri, manifest).collect()), key=lambda r: r[1]))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1] and len(found[0]) == 600 and [r[0] for r in found[0]] == [None] * 200 + [7] * 400


def test_ranges_by_bytes(spark):
    """However few shuffle partitions there are, a range holds a bounded part of the text."""
    d = spark.createDataFrame([(i, f"text of number {i} " * 40) for i in range(300)], "doc_id long, text string")
    uri = fresh_path(spark, "t")
    manifest = TF.write_token_files(d, uri, range_bytes=10_000)
    files = manifest.collect()
    assert len(files) > 12 and max(r.n_docs for r in files) < 60
    got, want = check(TF.read_token_files(spark, uri, manifest).collect(), [(r.doc_id, r.text) for r in d.collect()])
    assert got == want
