"""The line-parity gate over aligned source and target lines.

A document is one row (doc_id, src, tgt) of line arrays, so aligning by line number is
``arrays_zip`` inside the row: a full outer join by position without a shuffle, in which a missing
line is null. All structural checks are counts over that array, so the gate and its report need no exchange;
only reports by title or line explode it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X

PASS, WARN, SKIP, FAIL = "PASS", "WARN", "SKIP", "FAIL"
#: Structural checks in the order in which they are reported.
CHECKS = ("non_empty", "line_count", "blank_alignment", "paragraphs", "headings", "repeated_titles", "emphasis", "comments", "cjk_leakage", "punctuation_leakage", "bold_leakage")


def as_lines(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """doc_id, src, tgt from whole texts; null texts have no lines."""
    return pairs.select("doc_id", X.split_lines(F.coalesce(F.col(source), F.lit(""))).alias("src"), X.split_lines(F.coalesce(F.col(target), F.lit(""))).alias("tgt"))


def aligned(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), src, tgt; a side that ends early is null from there on."""
    zipped = F.arrays_zip("src", "tgt")
    return docs.select("doc_id", F.posexplode(zipped).alias("i", "p")).select("doc_id", (F.col("i") + 1).alias("line_no"), F.col("p.src").alias("src"), F.col("p.tgt").alias("tgt"))


def comment_depth(tokens: Column) -> Column:
    """Struct (depth, errors): open delimiters left and closings without one, over ``{%`` and ``%}``."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("errors"))

    def step(s: Column, t: Column) -> Column:
        opens = t == "{%"
        return F.struct(
            F.when(opens, s["depth"] + 1).otherwise(F.greatest(s["depth"] - 1, F.lit(0))).alias("depth"),
            (s["errors"] + F.when(~opens & (s["depth"] == 0), 1).otherwise(0)).alias("errors"),
        )

    return F.aggregate(tokens, start, step)


def repeated_titles(docs: DataFrame) -> DataFrame:
    """doc_id, title, lines, renderings of source titles that occur at least twice in a document."""
    a = aligned(docs).where(F.col("src").isNotNull() & F.col("tgt").isNotNull() & X.is_title_line("src"))
    keyed = a.select("doc_id", X.title_key("src").alias("title"), X.title_key("tgt").alias("rendering")).where("title <> ''")
    return keyed.groupBy("doc_id", "title").agg(F.count("*").alias("lines"), F.countDistinct("rendering").alias("renderings")).where("lines >= 2")


def structure_counts(docs: DataFrame, allow_cjk: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, src, tgt) as one row of issue counts per document, all computed inside the row."""
    def flags(p: Column) -> Column:
        s, t = p["src"], p["tgt"]
        both = s.isNotNull() & t.isNotNull()
        level = lambda x: F.when(x.isNotNull(), X.heading_level(x))
        tokens = lambda x: F.when(x.isNotNull(), X.comment_tokens(x))
        title = both & X.is_title_line(s)
        return F.struct(
            (s.isNotNull() & ~X.is_blank(s)).alias("src_text"), (t.isNotNull() & ~X.is_blank(t)).alias("tgt_text"), both.alias("both"),
            (~level(s).eqNullSafe(level(t))).alias("headings"), (both & (X.emphasis_count(t) < X.emphasis_count(s))).alias("emphasis"), (~tokens(s).eqNullSafe(tokens(t))).alias("comment_lines"),
            (t.isNotNull() & X.has_cjk_leak(t, allow_cjk)).alias("cjk_leakage"), (t.isNotNull() & X.has_punctuation_leak(t, allow_cjk)).alias("punctuation_leakage"), (t.isNotNull() & X.has_bold(t)).alias("bold_leakage"),
            F.when(title, X.title_key(s)).alias("title"), F.when(title, X.title_key(t)).alias("rendering"),
        )

    d = docs.select("doc_id", "src", "tgt", F.transform(F.arrays_zip("src", "tgt"), flags).alias("lines"))
    n = lambda f: F.size(F.filter("lines", f)).cast("long")
    # a line with text that none precedes opens a paragraph
    opens = lambda side: F.size(F.filter("lines", lambda x, i: x[side] & ((i == 0) | ~F.get("lines", i - 1)[side])))
    renderings = F.array_distinct(F.transform(F.filter("lines", lambda x: x["title"] != ""), lambda x: F.struct(x["title"].alias("title"), x["rendering"].alias("rendering"))))
    d = d.withColumn("titles", F.array_sort(F.transform(renderings, lambda x: x["title"])))
    several = F.size(F.array_distinct(F.filter("titles", lambda x, i: x == F.get("titles", i - 1))))
    flag = lambda k: lambda x: x[k]
    simple = ("headings", "emphasis", "comment_lines", "cjk_leakage", "punctuation_leakage", "bold_leakage")
    return d.select(
        "doc_id", F.size("src").alias("src_lines"), F.size("tgt").alias("tgt_lines"), opens("src_text").alias("src_paragraphs"), opens("tgt_text").alias("tgt_paragraphs"),
        comment_depth(X.comment_tokens(F.array_join("src", "\n"))).alias("src_comments"), comment_depth(X.comment_tokens(F.array_join("tgt", "\n"))).alias("tgt_comments"),
        n(lambda x: x["src_text"]).alias("src_nonblank"), n(lambda x: x["tgt_text"]).alias("tgt_nonblank"), n(lambda x: x["both"] & (x["src_text"] != x["tgt_text"])).alias("blank_alignment"),
        *(n(flag(k)).alias(k) for k in simple), several.cast("long").alias("repeated_titles"),
    )


def structure_report(docs: DataFrame, allow_cjk: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, checks: an array of (check_no, check, issues, status) of the eleven structural checks."""
    c = structure_counts(docs, allow_cjk)
    same_lines = F.col("src_lines") == F.col("tgt_lines")
    broken = F.col("src_comments.depth") + F.col("src_comments.errors") + F.col("tgt_comments.depth") + F.col("tgt_comments.errors")
    issues = {
        "non_empty": F.when((F.col("src_nonblank") > 0) & (F.col("tgt_nonblank") > 0), 0).otherwise(1),
        "line_count": F.abs(F.col("src_lines") - F.col("tgt_lines")),
        "blank_alignment": F.when(same_lines, F.col("blank_alignment")).otherwise(F.abs(F.col("src_lines") - F.col("tgt_lines"))),
        "paragraphs": F.abs(F.col("src_paragraphs") - F.col("tgt_paragraphs")),
        "headings": F.col("headings"),
        "repeated_titles": F.when(same_lines, F.col("repeated_titles")).otherwise(1),
        "emphasis": F.col("emphasis"),
        "comments": F.when(broken > 0, broken).otherwise(F.col("comment_lines")),
        "cjk_leakage": F.col("cjk_leakage"),
        "punctuation_leakage": F.col("punctuation_leakage"),
        "bold_leakage": F.col("bold_leakage"),
    }
    rows = (F.struct(F.lit(i).alias("check_no"), F.lit(n).alias("check"), issues[n].cast("long").alias("issues"), F.when(issues[n] == 0, PASS).otherwise(FAIL).alias("status")) for i, n in enumerate(CHECKS, 1))
    return c.select("doc_id", F.array(*rows).alias("checks"))


def structure_checks(docs: DataFrame, allow_cjk: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, check_no, check, issues, status of the eleven structural checks."""
    # outer, though there are always eleven: for the other kind a filter on the array is inferred, and the whole computation repeated in it
    return structure_report(docs, allow_cjk).select("doc_id", F.inline_outer("checks"))


def summary(checks: Column, strict: bool = False) -> list[Column]:
    """overall, passed, warned, skipped, failed of an array of checks: names in check order, comma-joined.

    FAIL beats all; in strict runs a SKIP makes the whole SKIP; then WARN; then PASS.
    """
    def names(status: str) -> Column:
        found = F.array_sort(F.transform(F.filter(checks, lambda x: x["status"] == status), lambda x: F.struct(x["check_no"], x["check"])))
        return F.array_join(F.transform(found, lambda x: x["check"]), ",")

    some = lambda status: F.exists(checks, lambda x: x["status"] == status)
    overall = F.when(some(FAIL), FAIL)
    if strict:
        overall = overall.when(some(SKIP), SKIP)
    overall = overall.when(some(WARN), WARN).otherwise(PASS)
    return [overall.alias("overall"), names(PASS).alias("passed"), names(WARN).alias("warned"), names(SKIP).alias("skipped"), names(FAIL).alias("failed")]


def roll_up(checks: DataFrame, strict: bool = False) -> DataFrame:
    """doc_id and the :func:`summary` of checks given as rows (doc_id, check_no, check, status)."""
    found = checks.groupBy("doc_id").agg(F.collect_list(F.struct("check_no", "check", "status")).alias("checks"))
    return found.select("doc_id", *summary(F.col("checks"), strict))


def full_report(docs: DataFrame, more: dict[str, DataFrame], strict: bool = False, allow_cjk: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the :func:`summary` of the structural checks and ``more``: tables of (doc_id, status) by the name of their check.

    Each further check is joined by doc_id; a document that it has no row for skips it.
    """
    d = structure_report(docs, allow_cjk).select("doc_id", F.transform("checks", lambda x: F.struct(x["check_no"].alias("check_no"), x["check"].alias("check"), x["status"].alias("status"))).alias("checks"))
    for i, (name, found) in enumerate(more.items(), len(CHECKS) + 1):
        one = F.struct(F.lit(i).alias("check_no"), F.lit(name).alias("check"), F.coalesce("more_status", F.lit(SKIP)).alias("status"))
        d = d.join(found.select("doc_id", F.col("status").alias("more_status")), "doc_id", "left").select("doc_id", F.array_append("checks", one).alias("checks"))
    return d.select("doc_id", *summary(F.col("checks"), strict))


def mismatched_lines(docs: DataFrame, condition: Column, first: int = 10) -> DataFrame:
    """doc_id, n, lines: how many aligned lines meet ``condition`` on src and tgt, and the first of them."""
    hit = aligned(docs).where(condition)
    lines = F.slice(F.array_sort(F.collect_list("line_no")), 1, first)
    return hit.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(lines, ",").alias("lines"))


def union_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
