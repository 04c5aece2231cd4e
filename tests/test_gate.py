import pytest
from pyspark.sql import Row, functions as F

from bitloom.functions import text as X
from bitloom.operators import alignment, cleanup, gate


def docs(spark, *pairs):
    return spark.createDataFrame([Row(doc_id=i, src=list(s), tgt=list(t)) for i, (s, t) in enumerate(pairs)], "doc_id int, src array<string>, tgt array<string>")


def status(spark, check, src, tgt):
    rows = gate.structure_checks(docs(spark, (src, tgt))).where(F.col("check") == check).collect()
    return rows[0].status


@pytest.mark.parametrize(("check", "src", "tgt", "want"), [
    ("repeated_titles", ["- 三、甲", "#### 3．甲"], ["- III. Title", "#### 3. Title"], "PASS"),
    ("repeated_titles", ["- 甲", "# 甲"], ["- One", "# Two"], "FAIL"),
    ("emphasis", ["*甲*与*乙*"], ["*one* and two"], "FAIL"),
    ("emphasis", ["甲"], ["*one*"], "PASS"),
    ("comments", ["甲 {% keep %}"], ["A %} keep {%"], "FAIL"),
    ("comments", ["{% a", "b %}"], ["{% x", "y %}"], "PASS"),
    ("cjk_leakage", ["甲"], ["(中文残留)"], "FAIL"),
    ("cjk_leakage", ["甲"], ["\U00020000"], "FAIL"),
    ("cjk_leakage", ["甲"], ["[source](#中文锚点) {#锚}"], "PASS"),
    ("punctuation_leakage", ["甲"], ["a，b"], "FAIL"),
    ("bold_leakage", ["甲"], ["a **b**"], "FAIL"),
    ("headings", ["# 甲", "乙"], ["# A"], "FAIL"),
    ("headings", ["#甲"], ["# A"], "FAIL"),
    ("blank_alignment", ["甲", ""], ["A", "b"], "FAIL"),
    ("paragraphs", ["甲", "", "乙"], ["A", "", "B"], "PASS"),
    ("non_empty", ["", " "], ["A", ""], "FAIL"),
    ("line_count", ["a"], ["a", "b"], "FAIL"),
])
def test_checks(spark, check, src, tgt, want):
    assert status(spark, check, src, tgt) == want


def test_roll_up_precedence(spark):
    c = spark.createDataFrame([(1, 1, "a", "PASS"), (1, 2, "b", "SKIP"), (1, 3, "c", "WARN"), (2, 1, "a", "FAIL"), (2, 2, "b", "SKIP"), (3, 1, "a", "PASS")], "doc_id int, check_no int, check string, status string")
    assert {r.doc_id: r.overall for r in gate.roll_up(c).collect()} == {1: "WARN", 2: "FAIL", 3: "PASS"}
    assert {r.doc_id: r.overall for r in gate.roll_up(c, strict=True).collect()} == {1: "SKIP", 2: "FAIL", 3: "PASS"}


def test_split_lines(spark):
    texts = ["a\nb\n", "", "a", "\n", "a\r\nb\rc\x0bd\x85e f", "a\n\n", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(X.split_lines("t").alias("l")).collect()
    assert [r.l for r in d] == [None if t is None else t.splitlines() for t in texts]


def test_interleave_and_split(spark):
    d = docs(spark, (["甲", "", "乙"], ["A", "", "B"]), (["", "", "甲"], ["", "", "A"]), ([], []))
    lines = alignment.bilingual_lines(d)
    assert [r.lines for r in lines.orderBy("doc_id").collect()] == [["甲", "A", "", "", "乙", "B", ""], ["", "", "甲", "A", ""], []]
    back = alignment.split_bilingual(lines).orderBy("doc_id").collect()
    assert [(r.src, r.tgt) for r in back] == [(["甲", "", "乙"], ["A", "", "B"]), (["", "", "甲"], ["", "", "A"]), ([], [])]
    odd = spark.createDataFrame([(1, ["2024", "In 2024", "", "", "中文", "English", ""]), ], "doc_id int, lines array<string>")
    r = alignment.split_bilingual(odd).first()
    assert (r.src, r.tgt) == (["2024", "", "中文"], ["In 2024", "", "English"])
    with pytest.raises(Exception, match="not a pair"):
        alignment.split_bilingual(spark.createDataFrame([(1, ["a", ""])], "doc_id int, lines array<string>")).collect()


def test_freshness(spark):
    d = alignment.bilingual_lines(docs(spark, (["甲"], ["A"]), (["甲"], ["A"]), (["甲"], ["A"])))
    d = d.withColumn("lines", F.when(F.col("doc_id") == 1, F.array(F.lit("甲"), F.lit("B"), F.lit(""))).when(F.col("doc_id") == 2, None).otherwise(F.col("lines")))
    assert [r.status for r in alignment.freshness(d).orderBy("doc_id").collect()] == ["PASS", "FAIL", "SKIP"]


def test_mixed_document_pairing(spark):
    lines = ["甲句", "", "A sentence", "乙", "丙", "B", "C"]
    d = spark.createDataFrame([(1, lines)], "doc_id int, lines array<string>")
    assert [(r.cn, r.en) for r in alignment.neighbour_pairs(d).collect()] == [("甲句", "A sentence"), ("丙", "B")]
    assert [(r.cn, r.en) for r in alignment.block_pairs(d).collect()] == [("甲句", "A sentence"), ("乙", "B"), ("丙", "C")]
    assert [(r.cn, r.en) for r in alignment.forward_pairs(d).collect()] == [("甲句", "A sentence"), ("乙", "B"), ("丙", "C")]


def test_sequential_matches(spark):
    d = spark.createDataFrame([(1, "One two. Two three four. One two.", ["one two.", "TWO three", "One two.", "absent"])], "doc_id int, body string, parts array<string>")
    found = alignment.find_in_order(d, least_step=1)
    assert [r["at"] for r in found.orderBy("ord").collect()] == [0, 9, 25, None]
    # segments are cut from the body as it is
    assert [r.segment for r in alignment.segments(found, d).orderBy("ord").collect()] == ["One two.", "Two three four.", "One two."]


def test_predicates(spark):
    r = spark.range(1).select(
        X.title_key(F.lit("## 三、 甲  乙")).alias("a"), X.is_analytic_chinese(F.lit("中文 one two")).alias("b"), X.is_offset_datetime(F.lit("2026-01-02T03:04:05Z")).alias("c"),
        X.is_offset_datetime(F.lit("2026-01-02T03:04:05")).alias("d"), X.contains_like(F.lit("Éa B"), "A b").alias("e"), X.contains_like(F.lit("éa"), "Éa").alias("f"),
        X.split_toc(F.lit("Intro ..... 12")).alias("g"), X.split_mixed(F.lit("你好 Hello there")).alias("h"), X.split_compact_list(F.lit("1. a 2. b")).alias("i"), X.fix_typesetting(F.lit("2.How")).alias("j"),
        X.word_differences(F.lit("a b c"), F.lit("a x c d")).alias("k"), X.split_steps(F.lit("甲 第一步乙 第二步丙")).alias("l"), X.sentences(F.lit("Short one. This is a longer sentence here! And another long sentence.")).alias("m"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("甲 乙", True, True, False, True, False)
    assert (r.g.title, r.g.page, r.h.cn, r.h.en, r.i, r.j) == ("Intro", 12, "你好", "Hello there", ["1. a", "2. b"], "2. How")
    assert [(x.i, x.a, x.b) for x in r.k] == [(1, "b", "x"), (3, None, "d")]
    assert r.l == ["甲", "第一步乙", "第二步丙"] and r.m == ["This is a longer sentence here!", "And another long sentence."]


def test_allowed_strings_and_structure(spark):
    """Allowed strings may hold script and punctuation; braces and brackets inside a destination hide nothing."""
    d = spark.createDataFrame([("see 《心经》 here",), ("[x](中(b)",), ("[x](中文) {#锚}",), ("{#a{中}",)], "t string")
    r = d.select(X.has_cjk_leak("t", ("《心经》",)), X.has_punctuation_leak("t", ("《心经》",)), X.has_cjk_leak("t"), X.has_punctuation_leak("t")).collect()
    assert [tuple(x) for x in r] == [(False, False, True, True), (True, False, True, False), (False, False, False, False), (True, False, True, False)]


def test_line_kinds(spark):
    d = spark.createDataFrame([("一，空",), ("一.空",), ("三、",), ("12、x",), ("12，x",), ("【序】",), ("2024",), ("207",), ("见......9",)], "t string")
    r = d.select(X.is_section_header("t"), X.is_outline_toc("t"), X.is_pdf_noise("t")).collect()
    assert [tuple(x) for x in r] == [(True, True, False), (False, False, False), (True, False, False), (True, True, False), (False, False, False), (True, False, False), (False, False, False), (False, False, True), (False, True, False)]


def test_default_body_class(spark):
    """Compatibility ideographs count as body; marks between the blocks don't."""
    rows = [(1, 1, "序"), (1, 2, ""), (1, 3, "\uf900\uf901\uf902"), (2, 1, "\u4dc0\u4dc1\u4dc2")]
    got = cleanup.toc_end(spark.createDataFrame(rows, "doc_id int, line_no int, text string")).collect()
    assert {r.doc_id: r.toc_end for r in got} == {1: 1, 2: 0}
