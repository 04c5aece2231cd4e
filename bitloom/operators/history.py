"""Append-only review histories, their certificates and rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Severities that block a release, and the statuses in which they do.
BLOCKING = ("critical", "major")
UNRESOLVED = ("open", "deferred")


def canonical(*columns: str) -> Column:
    """A row's values as JSON with nulls kept, for equality tests."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def merge_plan(existing: DataFrame, incoming: DataFrame, key: str = "finding_id") -> DataFrame:
    """key, ord, action: ``add`` a new id, ``skip`` an identical one, ``conflict`` for a different one.

    Both have the key, an order and the same further columns. One shuffle by key on each side.
    """
    values = sorted(c for c in incoming.columns if c not in (key, "ord"))
    old = existing.select(key, canonical(*values).alias("old"))
    new = incoming.select(key, "ord", canonical(*values).alias("new"))
    action = F.when(F.col("old").isNull(), "add").when(F.col("old") == F.col("new"), "skip").otherwise("conflict")
    return new.join(old, key, "left").select(key, "ord", action.alias("action"))


def merge(existing: DataFrame, incoming: DataFrame, key: str = "finding_id") -> DataFrame:
    """The history with new findings appended in order; any conflict is an error and nothing is returned."""
    plan = merge_plan(existing, incoming, key)
    checked = F.when(F.col("action") == "conflict", F.raise_error(F.concat(F.lit("a different finding has this id: "), F.col(key)))).otherwise(F.col("action"))
    add = plan.withColumn("action", checked).where("action = 'add'").select(key)
    last = existing.agg(F.coalesce(F.max("ord"), F.lit(-1)).cast("long").alias("last"))
    fresh = incoming.join(add, key, "left_semi").join(F.broadcast(last))  # one row
    return existing.unionByName(fresh.withColumn("ord", F.col("ord") + F.col("last") + 1).drop("last"))


def duplicates(findings: DataFrame, key: str = "finding_id") -> DataFrame:
    return findings.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def is_blocking(severity: Column | str = "severity", status: Column | str = "status") -> Column:
    """A critical or major finding that is open or deferred."""
    s = F.col(severity) if isinstance(severity, str) else severity
    t = F.col(status) if isinstance(status, str) else status
    return s.isin(*BLOCKING) & t.isin(*UNRESOLVED)


def history_state(findings: DataFrame) -> DataFrame:
    """project, records, finding_ids, blocking_ids, findings_sha256 of each project's history.

    ``findings``: project, ord, finding_id, severity, status and any further fields. The digest is over all fields of all
    records, in order, one JSON text a line, so that any change of a finding changes it. A row is as large as one history file.
    """
    fields = sorted(c for c in findings.columns if c not in ("project", "ord", "round"))
    note = F.col("resolution_note") if "resolution_note" in fields else F.lit(None).cast("string")
    record = F.struct("ord", "finding_id", "severity", "status", note.alias("resolution_note"), canonical(*fields).alias("line"))
    d = findings.groupBy("project").agg(F.array_sort(F.collect_list(record)).alias("records"))
    ids = lambda rows: F.transform(rows, lambda r: r["finding_id"])
    lines = F.concat(F.array_join(F.transform("records", lambda r: r["line"]), "\n"), F.lit("\n"))
    return d.select("project", "records", ids("records").alias("finding_ids"), ids(F.filter("records", lambda r: is_blocking(r["severity"], r["status"]))).alias("blocking_ids"), F.sha2(lines, 256).alias("findings_sha256"))


def certificates(findings: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """project, review_round, findings, blocking_findings, status, findings_sha256, finding_ids, blocking_finding_ids over each project's whole history.

    clear without blockers; blocking, or needs_human when the certificate before was blocking or needs_human, too.
    ``previous`` has project, status. The digest binds all records (:func:`history_state`).
    """
    last = findings.groupBy("project").agg(F.max("round").alias("review_round"))
    c = history_state(findings).join(last, "project")
    if previous is None:
        before = F.lit(None).cast("string")
    else:
        c = c.join(previous.select("project", F.col("status").alias("before")), "project", "left")
        before = F.col("before")
    n = F.size("blocking_ids")
    status = F.when(n == 0, "clear").when(before.isin("blocking", "needs_human"), "needs_human").otherwise("blocking")
    return c.select("project", "review_round", F.size("finding_ids").cast("long").alias("findings"), n.cast("long").alias("blocking_findings"), status.alias("status"), "findings_sha256", "finding_ids", F.col("blocking_ids").alias("blocking_finding_ids"))


def rounds(findings: DataFrame) -> DataFrame:
    """project, round, new, blocking_so_far, status: the state of each project after each round, in order.

    The status rule looks one round back, so it is a window over rounds, of which there are few per
    project: findings are first summed per round.
    """
    per = findings.groupBy("project", "round").agg(F.count("*").alias("new"), F.count_if(is_blocking()).alias("blocking"))
    w = Window.partitionBy("project").orderBy("round")
    so_far = F.sum("blocking").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = per.withColumn("blocking_so_far", so_far)
    blocked = F.col("blocking_so_far") > 0
    before = F.lag("blocking_so_far").over(w) > 0
    return d.select("project", "round", "new", "blocking_so_far", F.when(~blocked, "clear").when(F.coalesce(before, F.lit(False)), "needs_human").otherwise("blocking").alias("status"))


def with_provenance(findings: DataFrame, stage: str, provider: str, model: str, source_sha256: str, target_sha256: str) -> DataFrame:
    return findings.withColumns({k: F.lit(v) for k, v in dict(stage=stage, provider=provider, model=model, source_sha256=source_sha256, target_sha256=target_sha256).items()})
