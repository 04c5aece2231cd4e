"""Checks of a project's release: its review and approval, its certificate, the providers it may use, and whether another round may start.

Projects, certificates and analyses are one row each; a project's history is summed up in one row, too, as its certificate lists
all its ids. Each check gives a status and the problems that led to it, in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from .gate import FAIL, PASS, SKIP, WARN
from .history import BLOCKING, history_state, is_blocking

# Levels that are published, and the status words of certificates.
PUBLISHED = ("public", "sensitive")
CERTIFIED = ("clear", "blocking", "needs_human")

_STRINGS = "array<string>"


def _listed(*problems: tuple[Column, str]) -> Column:
    """The names of what holds, in order; a null condition doesn't hold."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for c, name in problems)), lambda x: x.isNotNull())


def _empty(c: str | Column) -> Column:
    return X.strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) == ""


def _no_list() -> Column:
    return F.array().cast(_STRINGS)


def governance(projects: DataFrame, findings: DataFrame, strict: bool = False) -> DataFrame:
    """project, status, problems, blockers.

    ``projects``: project, level, genre, source_origin_declared, delivery_format_declared, independent_review_required,
    named_approver_required, review_completed, reviewer, translator, approved, approver, has_findings (there is a file).
    Public, sensitive, scripture and strict releases must declare where the text comes from and goes to, require review and
    approval, and have no blockers; whoever requires them needs their records. Failures come before what is missing.
    """
    n = findings.groupBy("project").agg(F.count_if(is_blocking()).alias("blockers"))
    p = projects.join(n, "project", "left").fillna(0, ["blockers"])
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    published = F.col("level").isin(*PUBLISHED)
    guarded = F.lit(strict) | published | (F.col("genre") == "scripture")
    review, approval = true("independent_review_required") | guarded, true("named_approver_required") | guarded
    reviewed = true("review_completed") & ~_empty("reviewer")
    failures = _listed(
        (F.lit(strict) & ~published, "level"),
        (guarded & ~(true("source_origin_declared") & true("delivery_format_declared")), "declaration"),
        (guarded & ~true("independent_review_required"), "review not required"),
        (guarded & ~true("named_approver_required"), "approval not required"),
        (review & reviewed & X.same_folded("reviewer", "translator"), "reviewer is translator"),
        (approval & ~true("approved"), "not approved"),
        (guarded & (F.col("blockers") > 0), "blockers"),
    )
    missing = _listed((review & ~reviewed, "no review"), (review & ~true("has_findings"), "no findings"), (approval & _empty("approver"), "no approver"))
    d = p.withColumns({"failures": failures, "missing": missing})
    status = F.when(F.size("failures") > 0, FAIL).when(F.size("missing") > 0, SKIP).when(F.col("blockers") > 0, WARN).otherwise(PASS)
    problems = F.when((F.size("failures") + F.size("missing") > 0) | (F.col("blockers") == 0), F.concat("failures", "missing")).otherwise(F.array(F.lit("blockers")))
    return d.select("project", status.alias("status"), problems.alias("problems"), "blockers")


def _required(strict: bool) -> Column:
    return F.lit(strict) & F.coalesce(F.col("level").isin(*PUBLISHED), F.lit(False))


def semantic_review(current: DataFrame, certificates: DataFrame, findings: DataFrame, strict: bool = False) -> DataFrame:
    """project, status, problems: whether each certificate is of the current texts and of the whole history.

    ``current``: project, level, source_sha256, target_sha256. ``certificates``: project, source_sha256, target_sha256,
    findings_sha256, finding_ids, blocking_findings, blocking_finding_ids, review_round, status. A project without findings has no history.
    """
    names = ("source_sha256", "target_sha256", "findings_sha256", "finding_ids", "blocking_findings", "blocking_finding_ids", "review_round", "status")
    c = certificates.select("project", F.struct(*names).alias("c"))
    h = history_state(findings).select("project", "finding_ids", "blocking_ids", F.col("findings_sha256").alias("history"))
    j = current.join(c, "project", "left").join(h, "project", "left")
    of = lambda n: F.col(f"c.{n}")
    ids, blocking = F.coalesce("finding_ids", _no_list()), F.coalesce("blocking_ids", _no_list())
    known = F.col("source_sha256").isNotNull() & F.col("target_sha256").isNotNull()
    required = _required(strict)
    failures = _listed(
        (~known, "no hashes"), (known & (of("source_sha256") != F.col("source_sha256")), "source"), (known & (of("target_sha256") != F.col("target_sha256")), "target"),
        (F.col("history").isNull(), "no history"), (of("findings_sha256") != F.col("history"), "history"), (~of("finding_ids").eqNullSafe(ids), "finding ids"),
        (~of("blocking_findings").eqNullSafe(F.size(blocking)), "blocking count"), (~of("blocking_finding_ids").eqNullSafe(blocking), "blocking ids"),
        (required & (of("review_round") < 2), "first round"), (required & ((of("blocking_findings") != 0) | (of("status") != "clear")), "blockers"),
    )
    d = j.withColumn("problems", F.when(F.col("c").isNotNull(), failures).otherwise(_no_list()))
    status = F.when(F.col("c").isNull(), F.when(required, SKIP).otherwise(PASS)).when(F.size("problems") > 0, FAIL).when(of("blocking_findings") > 0, WARN).otherwise(PASS)
    return d.select("project", status.alias("status"), "problems")


def external_policy(current: DataFrame, analyses: DataFrame, certificates: DataFrame, findings: DataFrame, strict: bool = False) -> DataFrame:
    """project, status, problems: whether the analysis is of the current files, and whether closed projects used internal providers only.

    ``current``: project, level (null: no project file), external_semantic_review, source_sha256, project_sha256,
    term_map_sha256 (null: not compared), paragraph_ids. ``analyses``: project, provider, the digests and paragraph_ids;
    ``certificates``: project, provider; ``findings``: project, provider. Sensitive projects are closed, and those that deny.
    """
    names = ("source_sha256", "project_sha256", "term_map_sha256", "paragraph_ids", "provider")
    a = analyses.select("project", F.struct(*names).alias("a"))
    outside = lambda c: ~_empty(c) & ~X.same_folded(c, F.lit("internal"))
    f = findings.groupBy("project").agg(F.bool_or(outside("provider")).alias("outside"))
    j = current.join(a, "project", "left").join(certificates.select("project", F.col("provider").alias("certifier")), "project", "left").join(f, "project", "left")
    made = F.col("a").isNotNull() & F.col("source_sha256").isNotNull()
    differs = lambda n: made & (F.col(f"a.{n}") != F.col(n))
    closed = (F.col("level") == "sensitive") | (F.col("external_semantic_review") == "deny")
    problems = _listed(
        (differs("source_sha256"), "source"), (differs("project_sha256"), "project"), (differs("term_map_sha256"), "term map"),
        ((F.size("paragraph_ids") > 0) & differs("paragraph_ids"), "paragraphs"),
        (closed & outside("a.provider"), "analysis provider"), (closed & outside("certifier"), "certificate provider"), (closed & F.col("outside"), "finding provider"),
    )
    d = j.withColumn("problems", problems)
    status = F.when(F.col("a").isNull() & _required(strict), SKIP).when(F.size("problems") > 0, FAIL).otherwise(PASS)
    return d.select("project", status.alias("status"), F.when(status == SKIP, _no_list()).otherwise(F.col("problems")).alias("problems"))


def next_rounds(projects: DataFrame, certificates: DataFrame, findings: DataFrame) -> DataFrame:
    """project, review_round, problem: the number of the next round, or the first reason why none may start.

    ``certificates`` are those of the rounds before (project, review_round, status, finding_ids, blocking_findings,
    blocking_finding_ids, findings_sha256); ``findings`` the histories now, with resolution_note. Certified findings must
    still be there and blockers as grave; after a certificate that asks for a person, the history must have changed and each
    blocker must be settled with a note.
    """
    names = ("review_round", "status", "finding_ids", "blocking_findings", "blocking_finding_ids", "findings_sha256")
    c = certificates.select("project", F.struct(*names).alias("c"))
    h = history_state(findings).select("project", F.struct("records", "finding_ids", "blocking_ids", "findings_sha256").alias("h"))
    j = projects.select("project").join(c, "project", "left").join(h, "project", "left")
    of = lambda n: F.col(f"c.{n}")
    sound = lambda ids: F.coalesce((F.size(ids) == F.size(F.array_distinct(ids))) & F.forall(ids, lambda i: ~F.coalesce(X.is_blank(i), F.lit(True))), F.lit(False))
    those = lambda test: F.transform(F.filter("h.records", test), lambda r: r["finding_id"])
    lost = lambda ids: F.size(F.array_except(ids, F.col("h.finding_ids"))) > 0
    among = lambda test: F.arrays_overlap(of("blocking_finding_ids"), those(test))
    grave = lambda r: r["severity"].isin(*BLOCKING)
    person = of("status") == "needs_human"
    problem = (
        F.when(F.coalesce(of("review_round") < 1, F.lit(True)), "bad round").when(~F.coalesce(of("status").isin(*CERTIFIED), F.lit(False)), "bad status").when(F.col("h").isNull(), "no history")
        .when(of("finding_ids").isNull() | ~sound(of("finding_ids")), "bad finding ids").when(lost(of("finding_ids")), "finding lost")
        .when(of("blocking_finding_ids").isNull(), "bad blocking ids").when(lost(of("blocking_finding_ids")) | among(lambda r: ~grave(r)), "blocker lost or downgraded")
        .when(person & F.coalesce(of("findings_sha256") == F.col("h.findings_sha256"), F.lit(True)), "nothing recorded")
        .when(person & ((F.size(of("blocking_finding_ids")) == 0) | ~sound(of("blocking_finding_ids")) | ~of("blocking_findings").eqNullSafe(F.size(of("blocking_finding_ids")))), "no list of blockers")
        .when(person & (F.size("h.blocking_ids") > 0), "still blocked")
        .when(person & among(lambda r: ~r["status"].isin("resolved", "rejected")), "not settled").when(person & among(lambda r: F.coalesce(X.is_blank(r["resolution_note"]), F.lit(True))), "no note")
    )
    d = j.withColumn("problem", F.when(F.col("c").isNotNull(), problem))
    number = F.when(F.col("c").isNull(), 1).when(F.col("problem").isNull(), of("review_round") + 1)
    return d.select("project", number.cast("int").alias("review_round"), "problem")
