"""Registered queries of review histories and of annotator scoring, with the SQL of the same results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import history, release, scoring
from . import inputs as I


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An existing history of the events with odd length of type or even id; all as incoming, every thirteenth with another severity."""
    f = I.findings(spark, sf_dir)
    old = f.where("ord % 2 = 0")
    return old, f.withColumn("severity", F.when(F.col("ord") % 13 == 0, "critical").otherwise(F.col("severity")))


def history_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.merge_plan(*_split(spark, sf_dir))


HISTORY_MERGE_SQL = f"""WITH {I.FINDINGS_SQL}
SELECT finding_id, ord, CASE WHEN ord % 2 <> 0 THEN 'add' WHEN ord % 13 = 0 AND severity <> 'critical' THEN 'conflict' ELSE 'skip' END AS action FROM findings"""


def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged history of incoming findings that don't conflict."""
    f = I.findings(spark, sf_dir)
    return history.merge(f.where("ord % 2 = 0"), f).select("finding_id", "ord", "severity", "status")


HISTORY_APPEND_SQL = f"""WITH {I.FINDINGS_SQL}, l AS (SELECT coalesce(max(ord), -1) AS last FROM findings WHERE ord % 2 = 0)
SELECT finding_id, CASE WHEN ord % 2 = 0 THEN ord ELSE ord + last + 1 END AS ord, severity, status FROM findings, l"""


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = I.findings(spark, sf_dir)
    before = history.certificates(f.where("round = 1")).select("project", "status")
    c = history.certificates(f, before)
    return c.withColumns({n: F.array_join(n, ",") for n in ("finding_ids", "blocking_finding_ids")})


CERTIFICATES_SQL = f"""WITH {I.FINDINGS_SQL}, b AS (
  SELECT *, severity IN ('critical', 'major') AND status IN ('open', 'deferred') AS blocker FROM findings
), p AS (SELECT project, count(*) FILTER (blocker) > 0 AS blocked FROM b WHERE round = 1 GROUP BY project
), c AS (SELECT project, max(round) AS review_round, count(*) AS findings, count(*) FILTER (blocker) AS blocking_findings,
  sha256(string_agg('{{"finding_id":"' || finding_id || '","severity":"' || severity || '","status":"' || status || '"}}' || chr(10), '' ORDER BY ord)) AS findings_sha256,
  string_agg(finding_id, ',' ORDER BY ord) AS finding_ids, coalesce(string_agg(finding_id, ',' ORDER BY ord) FILTER (blocker), '') AS blocking_finding_ids FROM b GROUP BY project)
SELECT c.project, review_round, findings, blocking_findings, finding_ids, blocking_finding_ids, CASE WHEN blocking_findings = 0 THEN 'clear' WHEN p.blocked THEN 'needs_human' ELSE 'blocking' END AS status, findings_sha256
FROM c LEFT JOIN p USING (project)"""


def review_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.rounds(I.findings(spark, sf_dir))


REVIEW_ROUNDS_SQL = f"""WITH {I.FINDINGS_SQL}, r AS (
  SELECT project, round, count(*) AS new, count(*) FILTER (severity IN ('critical', 'major') AND status IN ('open', 'deferred')) AS b FROM findings GROUP BY project, round
), s AS (SELECT project, round, new, CAST(sum(b) OVER w AS BIGINT) AS blocking_so_far FROM r WINDOW w AS (PARTITION BY project ORDER BY round)),
t AS (SELECT *, lag(blocking_so_far) OVER (PARTITION BY project ORDER BY round) AS before FROM s)
SELECT project, round, new, blocking_so_far, CASE WHEN blocking_so_far = 0 THEN 'clear' WHEN coalesce(before, 0) > 0 THEN 'needs_human' ELSE 'blocking' END AS status FROM t"""


def _on(condition: str, value: object, other: object) -> Column:
    return F.when(F.expr(condition), F.lit(value)).otherwise(F.lit(other))


def _both(check: Callable[[bool], DataFrame]) -> DataFrame:
    """A check of drafts and of strict runs, problems comma-joined."""
    return reduce(DataFrame.unionByName, (check(strict).withColumns({"strict": F.lit(strict), "problems": F.array_join("problems", ",")}) for strict in (False, True)))


_PROJECTS_SQL = "p AS (SELECT DISTINCT c_custkey % 97 AS k FROM customer), runs AS (SELECT unnest([false, true]) AS strict)"
_BLOCKED_SQL = "n AS (SELECT project, count(*) FILTER (severity IN ('critical', 'major') AND status IN ('open', 'deferred')) AS b FROM findings GROUP BY project)"


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each remainder of the customers' keys, whose fields follow from it."""
    p = I.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 97).alias("project")).distinct()
    level = F.element_at(F.array(*map(F.lit, ("draft", "internal", "public", "sensitive"))), (F.col("project") % 4 + 1).cast("int"))
    return p.select(
        "project", level.alias("level"), _on("project % 11 = 0", "scripture", "book").alias("genre"), _on("project % 5 = 0", False, True).alias("source_origin_declared"), _on("project % 19 = 0", False, True).alias("delivery_format_declared"),
        _on("project % 3 = 0", False, True).alias("independent_review_required"), _on("project % 3 = 1 AND project % 2 = 0", False, True).alias("named_approver_required"), _on("project % 7 = 0", False, True).alias("review_completed"),
        F.when(F.expr("project % 13 = 0"), " ").when(F.expr("project % 6 = 1"), "ANN").otherwise("bob").alias("reviewer"), F.lit("Ann").alias("translator"), _on("project % 9 = 4", False, True).alias("approved"), _on("project % 8 = 5", None, "carl").alias("approver"),
        _on("project % 10 = 7", False, True).alias("has_findings"), _on("project % 3 = 0", "deny", "allow").alias("external_semantic_review"),
    )


_FIELDS_SQL = """f AS (SELECT k, strict, ['draft', 'internal', 'public', 'sensitive'][k % 4 + 1] AS level, k % 11 = 0 AS scripture, k % 5 <> 0 AND k % 19 <> 0 AS declared, k % 3 <> 0 AS need_review, NOT (k % 3 = 1 AND k % 2 = 0) AS need_approval,
  k % 7 <> 0 AND k % 13 <> 0 AS reviewed, k % 13 <> 0 AND k % 6 = 1 AS same, k % 9 <> 4 AS approved, k % 8 = 5 AS nameless, k % 10 <> 7 AS has_findings, coalesce(b, 0) AS b FROM p CROSS JOIN runs LEFT JOIN n ON n.project = k)"""


def governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every fifth history has no open findings, so that some projects have no blockers
    f = I.findings(spark, sf_dir).where("project % 5 <> 2 OR status = 'resolved'")
    return _both(lambda strict: release.governance(_projects(spark, sf_dir), f, strict))


GOVERNANCE_SQL = f"""WITH {I.FINDINGS_SQL.replace("findings AS", "every AS", 1)}, findings AS (SELECT * FROM every WHERE project % 5 <> 2 OR status = 'resolved'), {_PROJECTS_SQL}, {_BLOCKED_SQL}, {_FIELDS_SQL},
g AS (SELECT *, strict OR level IN ('public', 'sensitive') OR scripture AS guarded FROM f),
r AS (SELECT *, list_filter([CASE WHEN strict AND level NOT IN ('public', 'sensitive') THEN 'level' END, CASE WHEN guarded AND NOT declared THEN 'declaration' END, CASE WHEN guarded AND NOT need_review THEN 'review not required' END,
    CASE WHEN guarded AND NOT need_approval THEN 'approval not required' END, CASE WHEN (need_review OR guarded) AND reviewed AND same THEN 'reviewer is translator' END, CASE WHEN (need_approval OR guarded) AND NOT approved THEN 'not approved' END,
    CASE WHEN guarded AND b > 0 THEN 'blockers' END], lambda x: x IS NOT NULL) AS bad,
  list_filter([CASE WHEN (need_review OR guarded) AND NOT reviewed THEN 'no review' END, CASE WHEN (need_review OR guarded) AND NOT has_findings THEN 'no findings' END, CASE WHEN (need_approval OR guarded) AND nameless THEN 'no approver' END], lambda x: x IS NOT NULL) AS gone FROM g)
SELECT k AS project, strict, b AS blockers, CASE WHEN len(bad) > 0 THEN 'FAIL' WHEN len(gone) > 0 THEN 'SKIP' WHEN b > 0 THEN 'WARN' ELSE 'PASS' END AS status,
  array_to_string(CASE WHEN len(bad) + len(gone) > 0 OR b = 0 THEN bad || gone ELSE ['blockers'] END, ',') AS problems FROM r"""


def _certificates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Certificates of the findings up to now, or of the first two rounds, with a fault in some; and the findings."""
    f = I.findings(spark, sf_dir).where("project % 6 <> 3 OR severity NOT IN ('critical', 'major')")
    c = history.certificates(f).withColumns({"source_sha256": F.concat(F.lit("s"), "project"), "target_sha256": _on("project % 5 = 1", "old", "t"), "provider": _on("project % 4 = 0", "Internal", "other")})
    return c.withColumns({
        "finding_ids": F.when(F.expr("project % 7 = 2"), F.reverse("finding_ids")).otherwise(F.col("finding_ids")), "blocking_findings": F.col("blocking_findings") + F.when(F.expr("project % 7 = 3"), 1).otherwise(0),
        "blocking_finding_ids": F.when(F.expr("project % 7 = 4"), F.slice("blocking_finding_ids", 1, F.greatest(F.size("blocking_finding_ids") - 1, F.lit(0)))).otherwise(F.col("blocking_finding_ids")),
        "review_round": F.when(F.expr("project % 3 = 0"), 1).otherwise(F.col("review_round")), "findings_sha256": F.when(F.expr("project % 7 = 5"), "old").otherwise(F.col("findings_sha256")),
    }).where("project % 13 <> 0"), f.where("project % 17 <> 5")


def semantic_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = _certificates(spark, sf_dir)
    now = _projects(spark, sf_dir).select("project", "level", F.concat(F.when(F.expr("project % 8 <> 6"), "s"), "project").alias("source_sha256"), F.lit("t").alias("target_sha256"))
    return _both(lambda strict: release.semantic_review(now, c, f, strict))


SEMANTIC_FRESHNESS_SQL = f"""WITH {I.FINDINGS_SQL}, h AS (SELECT project, max(round) AS r, count(*) AS n, count(*) FILTER (severity IN ('critical', 'major') AND status IN ('open', 'deferred')) AS b FROM findings
  WHERE project % 6 <> 3 OR severity NOT IN ('critical', 'major') GROUP BY project), {_PROJECTS_SQL},
c AS (SELECT k, strict, strict AND k % 4 IN (2, 3) AS required, k % 13 <> 0 AND h.project IS NOT NULL AS made, k % 17 = 5 AS lost, k % 8 = 6 AS unknown, n, b, b + CASE WHEN k % 7 = 3 THEN 1 ELSE 0 END AS says,
    CASE WHEN k % 3 = 0 THEN 1 ELSE r END AS r FROM p CROSS JOIN runs LEFT JOIN h ON h.project = k),
d AS (SELECT *, CASE WHEN NOT made THEN CAST([] AS VARCHAR[]) ELSE list_filter([CASE WHEN unknown THEN 'no hashes' END, CASE WHEN NOT unknown AND k % 5 = 1 THEN 'target' END, CASE WHEN lost THEN 'no history' END, CASE WHEN NOT lost AND k % 7 = 5 THEN 'history' END,
    CASE WHEN lost OR k % 7 = 2 AND n > 1 THEN 'finding ids' END, CASE WHEN says <> CASE WHEN lost THEN 0 ELSE b END THEN 'blocking count' END,
    CASE WHEN lost AND b - CASE WHEN k % 7 = 4 AND b > 0 THEN 1 ELSE 0 END > 0 OR NOT lost AND k % 7 = 4 AND b > 0 THEN 'blocking ids' END, CASE WHEN required AND r < 2 THEN 'first round' END,
    CASE WHEN required AND (says <> 0 OR b > 0) THEN 'blockers' END], lambda x: x IS NOT NULL) END AS problems FROM c)
SELECT k AS project, strict, CASE WHEN NOT made THEN CASE WHEN required THEN 'SKIP' ELSE 'PASS' END WHEN len(problems) > 0 THEN 'FAIL' WHEN says > 0 THEN 'WARN' ELSE 'PASS' END AS status, array_to_string(problems, ',') AS problems FROM d"""


def external_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _projects(spark, sf_dir)
    ids = F.transform(F.sequence(F.lit(1), F.col("project") % 4 + 1), lambda i: F.concat(F.lit("L"), i))
    now = p.select("project", F.when(F.expr("project % 23 <> 1"), F.col("level")).alias("level"), F.when(F.expr("project % 23 <> 1"), F.col("external_semantic_review")).alias("external_semantic_review"),
                   F.lit("h").alias("source_sha256"), F.lit("p").alias("project_sha256"), _on("project % 2 = 0", "m", None).alias("term_map_sha256"), ids.alias("paragraph_ids"))
    made = now.where("project % 9 <> 0").select(
        "project", _on("project % 8 = 1", "old", "h").alias("source_sha256"), _on("project % 12 = 5", "old", "p").alias("project_sha256"), _on("project % 5 = 2", "old", "m").alias("term_map_sha256"),
        F.when(F.col("project") % 10 == 7, F.reverse("paragraph_ids")).otherwise(F.col("paragraph_ids")).alias("paragraph_ids"), _on("project % 4 = 3", "INTERNAL", "outside").alias("provider"))
    certified = p.where("project % 7 <> 1").select("project", _on("project % 5 = 0", "elsewhere", "internal").alias("provider"))
    f = I.findings(spark, sf_dir).select("project", F.when(F.expr("ord % 31 = 0"), "outside").when(F.expr("ord % 3 = 0"), " ").when(F.expr("ord % 3 = 1"), "internal").alias("provider"))
    return _both(lambda strict: release.external_policy(now, made, certified, f, strict))


EXTERNAL_POLICY_SQL = f"""WITH {I.FINDINGS_SQL}, {_PROJECTS_SQL}, o AS (SELECT project, bool_or(ord % 31 = 0) AS outside FROM findings GROUP BY project),
c AS (SELECT k, strict, k % 9 <> 0 AS made, k % 23 <> 1 AND strict AND k % 4 IN (2, 3) AS required, k % 23 <> 1 AND (k % 4 = 3 OR k % 3 = 0) AS closed, coalesce(outside, false) AS outside FROM p CROSS JOIN runs LEFT JOIN o ON o.project = k),
d AS (SELECT *, list_filter([CASE WHEN made AND k % 8 = 1 THEN 'source' END, CASE WHEN made AND k % 12 = 5 THEN 'project' END, CASE WHEN made AND k % 2 = 0 AND k % 5 = 2 THEN 'term map' END, CASE WHEN made AND k % 10 = 7 AND k % 4 > 0 THEN 'paragraphs' END,
  CASE WHEN made AND closed AND k % 4 <> 3 THEN 'analysis provider' END, CASE WHEN closed AND k % 7 <> 1 AND k % 5 = 0 THEN 'certificate provider' END, CASE WHEN closed AND outside THEN 'finding provider' END], lambda x: x IS NOT NULL) AS problems FROM c)
SELECT k AS project, strict, CASE WHEN NOT made AND required THEN 'SKIP' WHEN len(problems) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN NOT made AND required THEN '' ELSE array_to_string(problems, ',') END AS problems FROM d"""


def round_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next round of each project after its first two were certified, with some findings lost, downgraded or settled since."""
    f = I.findings(spark, sf_dir)
    early = f.where("round < 3 AND (project % 4 > 0 OR ord % 3 = 0)")
    c = history.certificates(early).where("project % 13 <> 0").withColumns({
        "status": F.when(F.expr("project % 19 = 7"), "done").when(F.expr("project % 2 = 0 AND blocking_findings > 0"), "needs_human").otherwise(F.col("status")),
        "blocking_findings": F.col("blocking_findings") + F.when(F.expr("project % 11 = 4"), 1).otherwise(0),
    })
    now = early.where("project % 5 <> 1 OR ord % 17 > 0").withColumns({
        "severity": F.when(F.expr("project % 7 = 3 AND severity = 'critical'"), "minor").otherwise(F.col("severity")),
        "status": F.when(F.expr("project % 3 > 0 AND severity IN ('critical', 'major') AND status IN ('open', 'deferred')"), "resolved").otherwise(F.col("status")),
        "resolution_note": F.when(F.expr("project % 10 <> 4"), "seen"),
    }).where("project % 23 <> 9")
    return release.next_rounds(_projects(spark, sf_dir), c, now)


# the digest covers the notes, so every history with a certificate that asks for a person has changed here
ROUND_VIOLATIONS_SQL = f"""WITH {I.FINDINGS_SQL}, e AS (SELECT *, severity IN ('critical', 'major') AND status IN ('open', 'deferred') AS blocker FROM findings WHERE round < 3 AND (project % 4 > 0 OR ord % 3 = 0)),
s AS (SELECT project, max(round) AS r, count(*) FILTER (blocker) AS b, bool_or(project % 5 = 1 AND ord % 17 = 0) AS lost, bool_or(blocker AND project % 7 = 3 AND severity = 'critical') AS down,
    bool_or(blocker AND project % 3 = 0 AND NOT (project % 7 = 3 AND severity = 'critical') AND NOT (project % 5 = 1 AND ord % 17 = 0)) AS still FROM e GROUP BY project),
p AS (SELECT DISTINCT c_custkey % 97 AS k FROM customer),
v AS (SELECT k, r, s.project IS NOT NULL AND k % 13 <> 0 AS made, k % 2 = 0 AND b > 0 AND k % 19 <> 7 AS person, CASE WHEN k % 19 = 7 THEN 'bad status' WHEN k % 23 = 9 THEN 'no history' WHEN lost THEN 'finding lost' WHEN down THEN 'blocker lost or downgraded'
    WHEN k % 2 = 0 AND b > 0 AND k % 11 = 4 THEN 'no list of blockers' WHEN k % 2 = 0 AND b > 0 AND still THEN 'still blocked' WHEN k % 2 = 0 AND b > 0 AND k % 10 = 4 THEN 'no note' END AS problem FROM p LEFT JOIN s ON s.project = k)
SELECT k AS project, CAST(CASE WHEN NOT made THEN 1 WHEN problem IS NULL THEN r + 1 END AS INTEGER) AS review_round, CASE WHEN made THEN problem END AS problem FROM v"""


# --- scoring --------------------------------------------------------------------------------


def pair_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of the word sets of each conversation pair."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    return I.pairs(spark, sf_dir).select("doc_id", F.round(scoring.set_f1(words("source"), words("target")), 6).alias("f1"))


PAIR_F1_SQL = f"""WITH {I.PAIRS_SQL}, w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(source), '[a-z]+')) AS e, list_distinct(regexp_extract_all(lower(target), '[a-z]+')) AS a FROM pairs)
SELECT doc_id, round(CASE WHEN len(e) = 0 AND len(a) = 0 THEN 1.0 WHEN len(e) = 0 OR len(a) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(e, a)) / (len(e) + len(a)) END, 6) AS f1 FROM w"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("provider"), (F.col("user_id") % 10).alias("track"), (F.col("event_id") % 3 + 1).cast("int").alias("run"), (F.col("event_id") % 7 != 0).alias("schema_valid"), (F.col("event_id") % 11 == 0).alias("timed_out"), F.col("value").alias("latency_seconds"), F.when(F.col("event_id") % 5 != 0, scoring.cost(F.col("event_id") % 1000, F.col("user_id") % 100, F.lit(0.5), F.lit(2.0))).alias("estimated_cost"))


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summaries(_runs(spark, sf_dir), ["provider", "track"])


_RUNS_SQL = """runs AS (SELECT event_type AS provider, user_id % 10 AS track, CAST(event_id % 3 + 1 AS INTEGER) AS run, event_id % 7 <> 0 AS schema_valid, event_id % 11 = 0 AS timed_out, value AS latency_seconds,
  CASE WHEN event_id % 5 <> 0 THEN round(((event_id % 1000) * 0.5::DOUBLE + (user_id % 100) * 2.0::DOUBLE) / 1e6, 8) END AS estimated_cost FROM events)"""
RUN_SUMMARIES_SQL = f"""WITH {_RUNS_SQL}
SELECT provider, track, count(*) AS runs, count(*) = 3 AS run_count_valid, round(count(*) FILTER (schema_valid) / count(*), 6) AS schema_valid_rate, round(count(*) FILTER (timed_out) / count(*), 6) AS timeout_rate,
  round(median(latency_seconds), 6) AS median_latency_seconds, round(max(latency_seconds), 6) AS max_latency_seconds, round(sum(estimated_cost), 8) AS total_estimated_cost, round(median(estimated_cost), 8) AS median_estimated_cost_per_run
FROM runs GROUP BY provider, track"""


def run_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("provider"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("run"), (F.col("o_custkey") % 4 + F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0)).cast("string").alias("request_sha256"))
    return scoring.run_sets(e, ["provider"])


RUN_SETS_SQL = """SELECT o_custkey AS provider, list_sort(list(CAST(o_orderkey % 3 + 1 AS INTEGER))) = [1, 2, 3] AS complete, count(DISTINCT o_custkey % 4 + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END) = 1 AS same_request FROM orders GROUP BY o_custkey"""


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider with the best rates per track among those with few timeouts; none on a tie."""
    s = run_summaries(spark, sf_dir).withColumn("hard_gate_pass", F.col("timeout_rate") <= 0.12)
    return scoring.select_best(s, [F.col("schema_valid_rate").desc(), F.col("timeout_rate").asc()], ["track"])


SELECTION_SQL = f"""WITH s AS ({RUN_SUMMARIES_SQL.replace("WITH", "WITH", 1)}), r AS (SELECT *, rank() OVER (PARTITION BY track ORDER BY schema_valid_rate DESC, timeout_rate) AS place FROM s WHERE timeout_rate <= 0.12),
f AS (SELECT track, CASE WHEN count(*) = 1 THEN any_value(provider) END AS selected FROM r WHERE place = 1 GROUP BY track)
SELECT t.track, f.selected FROM (SELECT DISTINCT track FROM s) t LEFT JOIN f USING (track)"""


def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of line items' flags over an order's lines, as runs of one case per part brand."""
    li = I.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("provider"), F.col("l_linenumber").alias("run"), (F.col("l_tax") < 0.09).alias("schema_valid"), (F.col("l_partkey") % 40).alias("case_id"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))
    return scoring.consistency(li, ["a", "b"], ["provider"])


CONSISTENCY_SQL = """WITH r AS (SELECT l_suppkey AS provider, l_linenumber AS run, l_tax < 0.09 AS ok, l_partkey % 40 AS c, l_returnflag AS a, l_linestatus AS b FROM lineitem),
s AS (SELECT provider, count(DISTINCT run) AS n, bool_and(ok) AS valid FROM r GROUP BY provider),
f AS (SELECT provider, avg(CAST(k = 1 AS INTEGER)) AS share FROM (SELECT provider, c, count(DISTINCT a) AS k FROM r GROUP BY provider, c UNION ALL SELECT provider, c, count(DISTINCT b) FROM r GROUP BY provider, c) GROUP BY provider)
SELECT provider, CASE WHEN valid AND n >= 2 THEN round(share, 6) ELSE 0.0 END AS consistency FROM s LEFT JOIN f USING (provider)"""


def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events")
    kind = scoring.failure_kind(F.col("event_id") % 7 != 0, F.col("event_id") % 11 == 0, F.when(F.col("event_id") % 13 == 0, 429).when(F.col("event_id") % 2 == 0, 200), F.col("event_id") % 3 != 0)
    return e.groupBy(F.coalesce(kind, F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


FAILURE_KINDS_SQL = """SELECT CASE WHEN event_id % 11 = 0 THEN 'timeout' WHEN event_id % 13 = 0 THEN 'http_429' WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN 'schema_invalid' WHEN event_id % 7 = 0 THEN 'provider_failure' ELSE 'none' END AS kind, count(*) AS n FROM events GROUP BY 1"""


def blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved blockers per project, with their ids in history order."""
    f = I.findings(spark, sf_dir).where(history.is_blocking())
    ids = F.array_sort(F.collect_list(F.struct("ord", "finding_id")))
    return f.groupBy("project").agg(F.count("*").alias("n"), F.array_join(F.transform(ids, lambda x: x["finding_id"]), ",").alias("ids"))


BLOCKERS_SQL = f"WITH {I.FINDINGS_SQL} SELECT project, count(*) AS n, string_agg(finding_id, ',' ORDER BY ord) AS ids FROM findings WHERE severity IN ('critical', 'major') AND status IN ('open', 'deferred') GROUP BY project"


def duplicate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("finding_id"))
    return history.duplicates(e)


QUERIES = {n: globals()[n] for n in ("history_merge", "history_append", "certificates", "review_rounds", "round_violations", "governance", "semantic_freshness", "external_policy", "blockers", "duplicate_findings", "pair_f1", "run_summaries", "run_sets", "selection", "consistency", "failure_kinds")}
SQL = {n: globals()[n.upper() + "_SQL"] for n in QUERIES if n != "duplicate_findings"} | {"duplicate_findings": "SELECT user_id || ':' || event_type AS finding_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1"}
