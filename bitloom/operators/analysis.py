"""Semantic analyses: evidence rules, escalation by risk, and validation of reviews.

An analysis is a nested paragraph struct (see ``sources.schemas``); rules are higher-order functions
over it, inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X


def _ambiguous(items: Column) -> Column:
    return F.exists(items, lambda x: x["evidence_status"] == "ambiguous")


def risk_reasons(p: str = "analysis") -> Column:
    """Reasons to escalate a paragraph, in a fixed order."""
    c = lambda n: F.col(f"{p}.{n}")
    rules = [
        (c("status") == "needs_human", "needs_human"),
        (F.size(c("competing_interpretations")) > 0, "competing_interpretations"),
        (F.exists(c("predicates"), lambda x: _ambiguous(x["participants"])), "ambiguous_semantic_role"),
        (_ambiguous(c("relations")), "ambiguous_relation"),
        (_ambiguous(c("operators")), "ambiguous_scope"),
        (_ambiguous(c("references_and_ellipsis")), "ambiguous_reference_or_ellipsis"),
    ]
    return F.array_compact(F.array(*(F.when(r, F.lit(n)) for r, n in rules)))


def select_focus(paragraphs: DataFrame, manual: DataFrame) -> DataFrame:
    """doc_id, line_no, paragraph_id, reasons of paragraphs to escalate: by risk, or by hand.

    ``paragraphs``: doc_id, line_no, paragraph_id, analysis; ``manual``: doc_id, paragraph_id. A manual
    id must be unique and exist.
    """
    m = manual.groupBy("doc_id", "paragraph_id").agg(F.count("*").alias("n"))
    j = paragraphs.join(m, ["doc_id", "paragraph_id"], "full_outer")
    bad = F.when(F.col("line_no").isNull() | (F.col("n") > 1), F.raise_error(F.concat(F.lit("not a unique source line: "), F.col("paragraph_id"))).cast("boolean")).otherwise(True)
    reasons = F.concat(risk_reasons(), F.when(F.col("n").isNotNull(), F.array(F.lit("manual_escalation"))).otherwise(F.array().cast("array<string>")))
    return j.where(bad).select("doc_id", "line_no", "paragraph_id", reasons.alias("reasons")).where("size(reasons) > 0")


def _in(text: Column, part: Column) -> Column:
    return F.coalesce(F.contains(text, part), F.lit(False))


def evidence_problems(text: Column, source: Column, p: str = "analysis") -> Column:
    """Names of the rules a paragraph breaks: ``text`` is the paragraph, ``source`` the whole document.

    Evidence is a verbatim part of the paragraph (of the document where its status isn't explicit);
    an explicit role names a participant within its evidence; constraints are in Chinese; any
    ambiguity means the paragraph needs a person.
    """
    c = lambda n: F.col(f"{p}.{n}")
    explicit = lambda x: x["evidence_status"] == "explicit"

    def located(x: Column) -> Column:
        return F.when(explicit(x), _in(text, x["evidence"])).otherwise(x["evidence"].isNull() | _in(source, x["evidence"]))

    def role(x: Column) -> Column:
        named = x["participant"].isNotNull() & _in(text, x["participant"]) & _in(x["evidence"], x["participant"])
        return located(x) & (~explicit(x) | named)

    competing = F.flatten(F.transform(c("competing_interpretations"), lambda x: x["evidence"]))
    ambiguous = F.size(F.array_except(risk_reasons(p), F.array(F.lit("needs_human")))) > 0
    rules = [
        (F.forall(c("predicates"), lambda x: _in(text, x["evidence"])), "predicate evidence"),
        (F.forall(F.flatten(F.transform(c("predicates"), lambda x: x["participants"])), role), "role evidence"),
        (F.forall(c("relations"), located), "relation evidence"),
        (F.forall(c("operators"), located), "operator evidence"),
        (F.forall(c("references_and_ellipsis"), located), "reference evidence"),
        (F.forall(competing, lambda x: _in(source, x)), "interpretation evidence"),
        (F.forall(F.concat(c("must_preserve"), c("must_not_invent")), X.is_analytic_chinese), "constraint language"),
        (~ambiguous | (c("status") == "needs_human"), "ambiguity without needs_human"),
    ]
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(n)) for ok, n in rules)))


def coverage(expected: Column, actual: Column) -> Column:
    """Struct (missing, unknown, repeated, ordered) of ids against the ids asked for."""
    return F.struct(
        F.array_except(expected, actual).alias("missing"), F.array_except(actual, expected).alias("unknown"),
        (F.size(actual) != F.size(F.array_distinct(actual))).alias("repeated"), (expected == actual).alias("ordered"),
    )


def reorder(expected: Column, items: Column, key: str) -> Column:
    """``items`` in the order of ``expected`` ids; null where one is missing."""
    return F.transform(expected, lambda e: F.get(F.filter(items, lambda x: x[key] == e), F.lit(0)))


def review_problem(reviewer: str, prefix: str, allowed: Column | None = None) -> Column:
    """The first rule that a finding row breaks, or null: new findings are open, by this reviewer, in Chinese, on an allowed paragraph."""
    p = (
        F.when(~F.col("severity").isin("critical", "major", "minor", "discussion"), "severity").when(F.col("status") != "open", "status").when(F.col("reviewer") != reviewer, "reviewer")
        .when(~F.col("finding_id").startswith(prefix), "finding_id").when(~F.col("message").rlike(X.CJK_WIDE), "message")
    )
    return p if allowed is None else p.when(~F.array_contains(allowed, F.col("paragraph_id")), "paragraph_id")


def public_cases(cases: DataFrame) -> DataFrame:
    """Gold cases without what an annotator must not see: the gold, and the target in source analysis."""
    shown = F.when(F.col("track") != "source_analysis", F.col("target"))
    return cases.drop("gold").withColumn("target", shown)


def external_allowed(policy: Column, sensitive: Column) -> Column:
    return ~((policy == "deny") | F.coalesce(sensitive, F.lit(False)))
