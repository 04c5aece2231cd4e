from pyspark.sql import functions as F

from bitloom.operators import articles as A


def test_write_back_takes_the_last(spark):
    r = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "c")], "slide int, shape int, run int, text string")
    t = spark.createDataFrame([(1, 1, 1, "x", 0), (1, 1, 1, "y", 1), (1, 1, 2, " ", 2)], "slide int, shape int, run int, text string, ord int")
    assert [x.text for x in A.write_back(r, t).orderBy("slide", "shape", "run").collect()] == ["y", "b", "c"]


def test_article(spark):
    rows = [(1, i, f"{c}", f"e{i}") for i, c in enumerate(["题", "副", "一、", "一、甲", "1. x", "文"])]
    c = A.classify_pairs(spark.createDataFrame(rows, "doc_id int, ord int, cn string, en string"), contents=1)
    assert [r.kind for r in c.orderBy("ord").collect()] == ["title", "subtitle", "toc", "heading", "subheading", "para"]
    got = [r.text for r in A.article(c, "目录", "Contents").orderBy("section", "row", "sub").collect()]
    assert got == ["题", "e0", "", "副", "e1", "", "目录", "一、", "Contents", "e2", "一、甲", "e3", "", "1. x", "e4", "", "文", "e5", ""]


def test_hash_states(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", "1")], "path string, sha256 string")
    b = spark.createDataFrame([("p", "1"), ("q", "2"), ("s", "1")], "path string, sha256 string")
    assert {r.path: r.state for r in A.unchanged(a, b).collect()} == {"p": "same", "q": "changed", "r": "gone", "s": "new"}
    x = spark.createDataFrame([(1, "a  b\n"), (2, "c"), (3, "d")], "doc_id int, text string")
    y = spark.createDataFrame([(1, "a b"), (2, "C")], "doc_id int, text string")
    assert {r.doc_id: r.same for r in A.fidelity(x, y).collect()} == {1: True, 2: False, 3: False}


def test_checkpoint_and_candidates(spark):
    b = spark.createDataFrame([("p", i, "h") for i in range(3)], "project string, batch int, source_sha256 string")
    k = spark.createDataFrame([("p", 0, "h", "s"), ("p", 1, "old", "s"), ("p", 2, "h", "t")], "project string, batch int, source_sha256 string, settings string")
    assert sorted(r.batch for r in A.remaining(b, k, "s").collect()) == [1, 2]
    d = spark.createDataFrame([(1, "甲乙")], "doc_id int, text string")
    c = spark.createDataFrame([(1, "甲"), (1, "丙"), (2, "甲")], "doc_id int, source string")
    assert sorted(tuple(r) for r in A.missing_candidates(c, d).collect()) == [(1, "丙"), (2, "甲")]


def test_focus_text(spark):
    f = spark.createDataFrame([(1, 10, "L10", ["a"]), (1, 2, "L2", ["b"])], "doc_id int, line_no int, paragraph_id string, reasons array<string>")
    assert A.focus_text(f).first().text == "L2\nL10" and A.focus_text(f, "args").first().text == "--paragraph L2 --paragraph L10"
    assert A.focus_text(f, "json").first().text == '[{"paragraph_id":"L2","reasons":["b"]},{"paragraph_id":"L10","reasons":["a"]}]'


def test_columns(spark):
    r = spark.range(1).select(
        A.split_numbered(F.lit("x 1) a 2) b 3) c")).alias("a"), A.split_numbered(F.lit("1) a 2) b")).alias("b"), A.colour(F.lit(0x102030)).alias("c"), A.colour(F.lit(0)).alias("d"),
        A.split_verses(F.lit("一、礼敬愿我成愿我行愿我证五、回向"), ["愿我"]).alias("e"), A.split_verses(F.lit("愿我"), ["愿我"]).alias("f"), A.strip_page_numbers(F.lit("正文。 42")).alias("g"), A.strip_page_numbers(F.lit("in 2024")).alias("h"),
    ).first()
    assert r.a == ["x", "1) a", "2) b", "3) c"] and r.b == ["1) a 2) b"] and tuple(r.c) == (16, 32, 48) and r.d is None
    assert [tuple(x) for x in r.e] == [("numbered", "一、礼敬"), ("verse_line", "愿我成"), ("verse_line", "愿我行"), ("verse_line", "愿我证"), ("numbered", "五、回向")]
    assert [x.kind for x in r.f] == ["body"] and r.g == "正文。" and r.h == "in 2024"


def test_bold_and_spans(spark):
    d = spark.createDataFrame([(1, 1, "**第一条 甲**"), (1, 2, ""), (1, 3, "乙。**"), (1, 4, "**第二条**"), (1, 5, "**第三条**")], "doc_id int, line_no int, text string")
    assert [r.text for r in A.join_bold(d).orderBy("line_no").collect()] == ["**第一条 甲乙。**", "**第二条**", "**第三条**"]
    s = spark.createDataFrame([("Tiny", 5.0), ("Tiny", 9.0), ("Wingdings-Regular", 9.0)], "font string, size double")
    assert [r.is_bullet for r in A.keep_spans(s, ["Tiny"], 6.0, ["Wingdings"]).orderBy("font").collect()] == [False, True]
