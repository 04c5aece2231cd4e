import random
import tracemalloc

import pytest

from bitloom.llm import warc as W
from bitloom.llm.common import fresh_path

from .. import oracle


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_whole_table_equals_sql(spark):
    assert oracle.rows(W.op9_warc(spark, oracle.SF)) == oracle.expected(W.OP9_SQL)


def test_revisits_and_odd_rows(spark):
    same = "x" * 200
    rows = [(5, "u", same), (3, "u", same), (3, "u", same), (9, None, same), (4, "u", None), (1, "a b\n", "y" * 99), (2, "u", "y" * 99), (None, "u", same), (7, "u", "é" * 60), (8, "", ""), (None, "u", "é" * 60)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    uri = fresh_path(spark, "w")
    got = W.read_archives(spark, uri, W.write_archives(d, uri, max_bytes=600)).collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(rows)
    kinds = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.payload_bytes, r.refers_to or -1) for r in got)
    assert kinds == sorted([(False, 5, "revisit", 200, 3), (False, 3, "response", 200, -1), (False, 3, "response", 200, -1), (False, 9, "revisit", 200, 3), (False, 4, "response", 0, -1), (False, 1, "response", 99, -1), (False, 2, "response", 99, -1), (True, 0, "revisit", 200, 3), (False, 7, "response", 120, -1), (False, 8, "response", 0, -1), (True, 0, "revisit", 120, 7)])
    uri = fresh_path(spark, "w")
    assert W.read_archives(spark, uri, W.write_archives(d.where("false"), uri)).count() == 0


RECORDS = [W.build_record(i, f"u{i}", (f"p{i} " * 60).encode(), None, False, "d") for i in range(20)]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("seed", range(40))
def test_salvage(packed, seed):
    """Damage to one place costs the records it touches; all later ones come back, and the gap is logged."""
    parts = [W.gzip_member(r, 6) if packed else r for r in RECORDS]
    ends = [sum(map(len, parts[: i + 1])) for i in range(20)]
    data, rng = bytearray(b"".join(parts)), random.Random(seed)
    at, kind = rng.randrange(len(data)), seed % 3
    cut = rng.randrange(1, 150) if kind == 1 else 0
    if kind == 0:
        data[at] ^= 0x5A
    elif kind == 1:
        del data[at : at + cut]
    else:
        data[at:at] = rng.randbytes(40)
    touched = {i for i in range(20) if (ends[i - 1] if i else 0) < at + max(cut, 1) + 1 and at - 1 <= ends[i]}
    s = W.Salvage(Bytes(bytes(data)))
    found = [h.get("x-page-id") for _, _, h, _ in s.records()]
    got = {int(i) for i in found if i and i.isdigit()}
    assert got >= set(range(20)) - touched
    # plain files have no checksum over headers, so a header may be read as it is
    assert s.gaps or len(found) == 20
    assert all(0 <= a < b <= len(data) for a, b, _ in s.gaps)


def test_checks():
    good = RECORDS[0]
    assert W.parse_record(good)[2] == len(good)
    for bad in (good.replace(b"p0 ", b"q0 "), good.replace(b"WARC/1.1", b"WERC/1.1"), good[:-4], good.replace(b"Content-Length: ", b"Content-Lengthy: ")):
        with pytest.raises(W.Damaged):
            W.parse_record(bad)
    assert [x for x in W.Salvage(Bytes(b"")).records()] == []
    s = W.Salvage(Bytes(b"garbage only"))
    assert list(s.records()) == [] and s.gaps == [(0, 12, "neither a member nor a version line")]


@pytest.mark.parametrize("stray", [b"\n", b"x", b"\r\n", b"WARC/1.", b"\x1f\x8b\x08"])
@pytest.mark.parametrize("packed", [True, False])
def test_stray_bytes_cost_no_record(stray, packed):
    parts = [W.gzip_member(r, 6) if packed else r for r in RECORDS]
    data = stray + stray.join(parts)
    s = W.Salvage(Bytes(data))
    assert [h["x-page-id"] for _, _, h, _ in s.records()] == [str(i) for i in range(20)]
    assert sum(b - a for a, b, _ in s.gaps) == 20 * len(stray)


def test_claims_of_damaged_headers_take_no_memory():
    """A length that is false, absurd or over the limit is a gap; records after it come back."""
    after = b"".join(RECORDS[1:3])
    for length in (b"99999", b"9" * 5000, b"-5", b"60000000"):
        bad = RECORDS[0].replace(b"Content-Length: %d" % (len(RECORDS[0].split(b"\r\n\r\n", 1)[1]) - 4), b"Content-Length: " + length)
        assert length in bad
        s = W.Salvage(Bytes(bad + after + b" " * 200_000), max_record=100_000)
        assert [h["x-page-id"] for _, _, h, _ in s.records()] == ["1", "2"] and s.gaps


def test_inflating_stops_at_the_limit(monkeypatch):
    bomb = W.gzip_member(b"WARC/1.1\r\nContent-Length: 5\r\n\r\n" + bytes(300 << 20), 9)
    s = W.Salvage(Bytes(bomb + W.gzip_member(RECORDS[1], 6)), max_record=8 << 20)
    tracemalloc.start()
    assert [h["x-page-id"] for _, _, h, _ in s.records()] == ["1"]
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_pages_without_digest_are_dealt_by_row(spark):
    rows = [(i, "u", None if i % 2 else "z" * 120) for i in range(400)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        uri = fresh_path(spark, "w")
        got = W.read_archives(spark, uri, W.write_archives(d, uri)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(i, "response" if i % 2 or i == 0 else "revisit", None if i % 2 or i == 0 else 0) for i in range(400)]
