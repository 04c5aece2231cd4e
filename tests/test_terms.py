import sqlite3

import pytest
from pyspark.sql import functions as F

from bitloom.operators import terms
from bitloom.sources import readers

ROWS = [
    (1, "空性", "emptiness", "p1", "other"), (2, "空性", "voidness", None, "佛教术语"), (3, "空性", "emptiness", None, "DoT定稿"), (4, "空性", "Emptiness", None, "DoT定稿"),
    (5, "空性见", "view of emptiness", None, "DoT定稿"), (6, "空性", "shunyata", None, "内部特色词"), (7, "止", "calm", None, "经论名"), (8, "空性", "sunyata", None, "经论名"), (9, " 空性 ", "empty", None, "佛教术语"),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "row_id int, zh string, en string, loc string, source string").cache()


def ids(df):
    return [r.row_id for r in df.collect()]


def test_order_of_results(table):
    assert ids(terms.search(table, "空性", limit=None)) == [3, 4, 6, 2, 9, 8, 1, 5]
    assert ids(terms.search(table, "空性")) == [3, 4, 6, 2, 9, 8, 1, 5]
    assert ids(terms.search(table, "空性", limit=0)) == []
    assert ids(terms.search(table, "EMPTINESS 空", limit=2)) == [5, 3]
    assert ids(terms.search(table, "", src="经论名")) == [8, 7]
    assert ids(terms.search(table, "", loc="P1")) == [1]
    assert len(ids(terms.search(table, "", src=""))) == 9


def test_query_words():
    assert terms.parse_query(["空性", "src:DoT定稿", "loc:x", "5"]) == {"query": "空性", "loc": "x", "src": "DoT定稿", "limit": 5}
    assert terms.parse_query(["5"])["query"] == "5"


def test_term_map(spark, table):
    c = spark.createDataFrame([(0, " 空性", "s"), (1, "空性", "later"), (2, "无", ""), (3, "止", "")], "ord int, source string, sense string")
    m = {r.source: r for r in terms.term_map(table, c).collect()}
    assert (m["空性"].preferred, m["空性"].allowed, m["空性"].sense) == ("emptiness", ["shunyata", "voidness", "empty", "sunyata"], "s")
    assert m["空性"].sources == ["DoT定稿", "内部特色词", "佛教术语", "经论名", "other"]
    assert (m["无"].status, m["无"].preferred, m["止"].preferred) == ("needs_human", None, "calm")
    assert {r.source: r for r in terms.term_map(table, c, limit=2).collect()}["空性"].allowed == []


def policy(spark, *rows):
    return spark.createDataFrame(rows, "source string, renderings array<string>, forbidden array<string>, needs_human boolean")


@pytest.mark.parametrize(("src", "tgt", "rows", "strict", "want"), [
    (["止"], ["avoid calmness"], [("止", ["calm", "calm abiding"], [], False)], False, "FAIL"),
    (["止止"], ["calm abiding"], [("止", ["calm", "calm abiding"], [], False)], False, "WARN"),
    (["止"], ["calm", "abiding"], [("止", ["calm abiding"], [], False)], False, "PASS"),
    (["甲"], ["x"], [("止", ["calm"], [], False)], False, "SKIP"),
    (["止"], ["calm stop"], [("止", ["calm"], ["stop"], False)], False, "FAIL"),
    (["止"], ["calm"], [("止", ["calm"], [], True)], False, "SKIP"),
    (["止" * 100], ["calm " * 98], [("止", ["calm"], [], False)], False, "WARN"),
    (["止" * 100], ["calm " * 98], [("止", ["calm"], [], False)], True, "FAIL"),
    (["止" * 100], ["calm " * 99], [("止", ["calm"], [], False)], True, "WARN"),
])
def test_terminology(spark, src, tgt, rows, strict, want):
    d = spark.createDataFrame([(1, src, tgt)], "doc_id int, src array<string>, tgt array<string>")
    assert terms.terminology(d, policy(spark, *rows), strict).first().status == want


def test_occurrences(spark):
    d = spark.createDataFrame([(1, "aaaa 空性空性"), (2, ""), (3, None), (4, "b")], "doc_id int, text string")
    t = spark.createDataFrame([("aa",), ("空性",), ("zz",), ("b",), ("b",), ("",)], "term string")
    want = [(1, "aa", 2), (1, "空性", 2), (4, "b", 1)]
    for limit in (1000, 0):  # one automaton, or a join
        assert sorted((r.doc_id, r.term, r.n) for r in terms.occurrences(d, t, limit).collect()) == want
    assert terms.occurrences(d, t.where("false")).count() == 0
    again = spark.createDataFrame([(1, "aaaa"), (1, "aa"), (1, "aa"), (None, "b b"), (None, "b")], "doc_id int, text string")
    both = [sorted(((r.doc_id, r.term, r.n) for r in terms.occurrences(again, t, limit).collect()), key=repr) for limit in (1000, 0)]
    assert both[0] == both[1] == sorted([(1, "aa", 2), (1, "aa", 1), (1, "aa", 1), (None, "b", 2), (None, "b", 1)], key=repr)


def test_unify(spark):
    a = spark.createDataFrame([("甲", "A"), ("", "x"), (None, "y")], "c string, e string")
    b = spark.createDataFrame([("乙", "B", "B2")], "zh string, en1 string, en2 string")
    u = terms.unify((a, {"zh": "c", "en": "e", "source": "=one"}), (b, {"zh": "zh", "en": "en1", "source": "=two"}), (b, {"zh": "zh", "en": "en2", "source": "=two"}))
    assert sorted(map(tuple, u.collect())) == [("乙", "B", None, "two"), ("乙", "B2", None, "two"), ("甲", "A", None, "one")]


@pytest.mark.parametrize(("text", "renderings", "n"), [
    ("the view of emptiness is emptiness", ["emptiness", "view of emptiness"], 2), ("a b c d e", ["b c d", "a b", "d e"], 1), ("calm  abiding, calm\tabiding", ["Calm Abiding", "calm"], 2), ("calmly calm_ calm", ["calm"], 1),
    ("a.b axb (a.b)", ["a.b"], 2), ("x (y) z(y)", ["(y)"], 2), ("\\\\Q a \\\\E b", ["\\\\E b", "\\\\Q"], 2), ("éclair clair", ["clair"], 1), ("one one one", ["one", "one", "ONE"], 3), ("none", ["", " "], 0),
])
def test_renderings(spark, text, renderings, n):
    d = spark.createDataFrame([(text, renderings)], "t string, r array<string>")
    assert d.select(terms.renderings_in(F.col("t"), terms.ranked_patterns(F.col("r")))).first()[0] == n


def test_renderings_equal_but_for_case(spark):
    d = spark.createDataFrame([(["calm", "Calm", "still", "CALM", "Still"],), ([],)], "r array<string>")
    assert [r[0] for r in d.select(terms.distinct_ignoring_case(F.col("r"))).collect()] == [["calm", "still"], []]


def test_term_table_file(spark, table, tmp_path):
    for name, mode in (("a.db", "delete"), ("b.db", "wal")):
        with sqlite3.connect(tmp_path / name) as db:
            db.execute(f"PRAGMA journal_mode={mode}")
            db.execute("CREATE TABLE terms (zh, en, loc, source, more)")
            db.executemany("INSERT INTO terms VALUES (?, ?, ?, ?, 1)", [r[1:] for r in ROWS])
            db.commit()
        db.close()
        before = sorted(p.name for p in tmp_path.iterdir())
        read = readers.term_table_sqlite(spark, str(tmp_path / name), batch=4)
        assert {r.problem for r in read.collect()} == {None}
        got = read.select("row_id", "zh", "en", "loc", "source")
        assert [tuple(r) for r in got.orderBy("row_id").collect()] == ROWS
        assert ids(terms.search(got, "空性", limit=None)) == ids(terms.search(table, "空性", limit=None))
        assert sorted(p.name for p in tmp_path.iterdir()) == before


def test_term_table_file_unreadable_or_empty(spark, tmp_path):
    (tmp_path / "broken.db").write_bytes(b"no database at all" * 9)
    with sqlite3.connect(tmp_path / "other.db") as db:
        db.execute("CREATE TABLE words (zh, en, loc, source)")
        db.execute('CREATE TABLE "a ""b" (zh, en, loc, source)')
    db.close()
    read = readers.term_table_sqlite(spark, str(tmp_path / "*.db"))
    assert [(r.path.rsplit("/", 1)[1], r.row_id, r.problem) for r in read.orderBy("path").collect()] == [("broken.db", None, "unreadable"), ("other.db", None, "unreadable")]
    assert readers.term_table_sqlite(spark, str(tmp_path / "other.db"), table="words").count() == 0
    assert readers.term_table_sqlite(spark, str(tmp_path / "other.db"), table='a "b').count() == 0


def test_repeated_ids_stay_apart(spark):
    """Rows with one doc_id, or none, have their own terms."""
    rows = [(1, ["止 观"], ["calm and insight"]), (1, ["观"], ["nothing"]), (None, ["止"], ["calm"]), (None, ["止"], ["x"]), (2, ["无"], ["x"]), (3, None, None)]
    d = spark.createDataFrame(rows, "doc_id int, src array<string>, tgt array<string>")
    p = spark.createDataFrame([("止", ["calm"], [], False), ("观", ["insight"], [], False)], "source string, renderings array<string>, forbidden array<string>, needs_human boolean")
    got = sorted(((r.doc_id, r.status, r.checked, r.failed) for r in terms.terminology(d, p).collect()), key=repr)
    assert got == sorted([(1, "PASS", 2, ""), (1, "FAIL", 1, "观"), (None, "PASS", 1, ""), (None, "FAIL", 1, "止"), (2, "SKIP", 0, ""), (3, "SKIP", 0, "")], key=repr)
