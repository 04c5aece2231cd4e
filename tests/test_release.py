"""Release checks: every status and problem occurs in the queries, and cases that those can't hold."""

import pytest
from pyspark.sql import functions as F

from bitloom.functions import text as X
from bitloom.operators import history, release
from bitloom.plans import review_queries as Q

from . import oracle


@pytest.mark.parametrize(("name", "statuses", "problems"), [
    ("governance", {"FAIL", "SKIP", "WARN", "PASS"}, {"level", "declaration", "review not required", "approval not required", "reviewer is translator", "not approved", "blockers", "no review", "no findings", "no approver"}),
    ("semantic_freshness", {"FAIL", "SKIP", "WARN", "PASS"}, {"no hashes", "target", "no history", "history", "finding ids", "blocking count", "blocking ids", "first round", "blockers"}),
    ("external_policy", {"FAIL", "SKIP", "PASS"}, {"source", "project", "term map", "paragraphs", "analysis provider", "certificate provider", "finding provider"}),
])
def test_every_branch(spark, name, statuses, problems):
    names, rows = oracle.rows(Q.QUERIES[name](spark, "/root/testdata/sf0.01"))
    assert (names, rows) == oracle.expected(Q.SQL[name], "/root/testdata/sf0.01")
    assert {r[names.index("status")] for r in rows} == statuses
    assert {x for r in rows for x in r[names.index("problems")].split(",") if x} == problems


def test_next_rounds(spark):
    names, rows = oracle.rows(Q.round_violations(spark, "/root/testdata/sf0.01"))
    assert (names, rows) == oracle.expected(Q.SQL["round_violations"], "/root/testdata/sf0.01")
    assert {r[names.index("problem")] for r in rows} == {None, "bad status", "no history", "finding lost", "blocker lost or downgraded", "no list of blockers", "still blocked", "no note"}
    # what these histories can't hold
    kind = "project int, ord int, finding_id string, severity string, status string, resolution_note string, round int"
    f = spark.createDataFrame([(p, 0, "a", "major", "open", None, 1) for p in range(6)], kind)
    c = history.certificates(f).withColumn("status", F.lit("needs_human")).withColumns({
        "review_round": F.when(F.col("project") == 3, 0).otherwise(1), "finding_ids": F.when(F.col("project") == 4, F.array(F.lit("a"), F.lit("a"))).otherwise(F.col("finding_ids")),
        "blocking_finding_ids": F.when(F.col("project") == 5, F.lit(None).cast("array<string>")).otherwise(F.col("blocking_finding_ids")),
    })
    now = f.withColumns({"status": F.when(F.col("project") == 1, "resolved").otherwise("open"), "resolution_note": F.when(F.col("project") == 1, "done")})
    got = {r.project: (r.review_round, r.problem) for r in release.next_rounds(spark.range(7).withColumnRenamed("id", "project"), c, now).collect()}
    assert got == {0: (None, "nothing recorded"), 1: (2, None), 2: (None, "nothing recorded"), 3: (None, "bad round"), 4: (None, "bad finding ids"), 5: (None, "bad blocking ids"), 6: (1, None)}


def test_a_changed_finding_changes_the_digest(spark):
    f = spark.createDataFrame([("p", 0, "a", "critical", "open", 1), ("p", 1, "b", "minor", "open", 1)], "project string, ord int, finding_id string, severity string, status string, round int")
    digest = lambda d: history.certificates(d).first().findings_sha256
    softer = f.withColumn("severity", F.lit("minor"))
    assert len({digest(f), digest(softer), digest(f.where("ord = 0")), digest(f.withColumn("ord", -F.col("ord")))}) == 4


def test_folding(spark):
    """All characters of both planes with letters, beside their case forms, as Python folds them."""
    pairs = [("Straße", "STRASSE"), ("ann", "ANN"), ("ΟΔΟΣ", "οδος"), ("é", "e"), ("ann", "anna"), ("ı", "i"), ("İ", "i")]
    for c in map(chr, [*range(1, 0xD800), *range(0xE001, 0x20000)]):
        pairs += [(c, v) for v in {c.upper(), c.lower(), c.title(), c.casefold()} - {c}]
    d = spark.createDataFrame([(a, b, a.casefold() == b.casefold()) for a, b in pairs], "a string, b string, want boolean")
    wrong = d.where(X.same_folded("a", "b") != F.col("want"))
    assert d.count() > 2500 and [(r.a, r.b) for r in wrong.collect()] == []
