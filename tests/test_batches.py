"""Checkpointed batches that end early, and rounds as a stream, against unbroken runs and batch results."""

import random

import pytest
from pyspark.sql import functions as F

from bitloom.operators import batches as B, history, release
from bitloom.streaming import rounds as R


@pytest.fixture(scope="module")
def checkpoints(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def lines(spark, change=None):
    rows = [(p, i, f"text {p}{i}" if (p, i) != change else "changed") for p in "abc" for i in range(1, 12)]
    return spark.createDataFrame(rows, "project string, line_no int, text string")


def shout(batch_rows):
    return batch_rows.select("project", "batch", F.upper(F.array_join(F.transform("items", lambda x: x["text"]), "|")).alias("output"), F.lit(None).cast("string").alias("problem"))


def rows_of(df):
    return sorted((r.project, r.batch, r.output, r.problem) for r in df.collect())


def test_a_killed_run_ends_like_an_unbroken_one(spark, checkpoints, tmp_path):
    planned = B.plan(lines(spark), {"model": "m"})
    whole = B.run(planned, f"file://{tmp_path}/whole", shout)
    assert len(rows_of(whole)) == 9 and all(r[2] for r in rows_of(whole))
    seen = []

    def breaks(batch_rows):
        seen.append(batch_rows.count())
        if len(seen) > 2:
            raise RuntimeError("killed")
        return shout(batch_rows)

    path = f"file://{tmp_path}/broken"
    with pytest.raises(RuntimeError, match="killed"):
        B.run(planned, path, breaks, waves=4)
    kept = B.saved(spark, path).count()
    assert 0 < kept < 9
    again = []
    assert rows_of(B.run(planned, path, lambda d: again.append(d.count()) or shout(d), waves=4)) == rows_of(whole)
    assert sum(again) == 9 - kept and {r.attempt for r in B.results(planned, path).collect()} == {1}


def test_changed_inputs_and_settings_are_done_again(spark, checkpoints, tmp_path):
    path, done = f"file://{tmp_path}/t", []
    note = lambda d: done.append(sorted((r.project, r.batch) for r in d.collect())) or shout(d)
    B.run(B.plan(lines(spark), {"model": "m"}), path, note)
    changed = B.plan(lines(spark, ("b", 2)), {"model": "m"})
    out = {(r.project, r.batch): r for r in B.run(changed, path, note).collect()}
    assert len(done[0]) == 9 and done[1] == [("b", 0)] and "CHANGED" in out["b", 0].output and len(out) == 9
    B.run(B.plan(lines(spark, ("b", 2)), {"model": "other"}), path, note)
    assert len(done[2]) == 9 and len(done) == 3


def test_problems_are_tried_again(spark, checkpoints, tmp_path):
    def fails(d):
        bad = (F.col("project") == "a") | (F.col("project") == "b") & (F.col("attempt") < 2)
        return d.select("project", "batch", F.when(~bad, "ok").alias("output"), F.when(bad, "timeout").alias("problem"))

    got = {}
    for r in B.run(B.plan(lines(spark), {}), f"file://{tmp_path}/t", fails, max_attempts=3).collect():
        got.setdefault(r.project, set()).add((r.attempt, r.output, r.problem))
    assert got == {"a": {(3, None, "timeout")}, "b": {(2, "ok", None)}, "c": {(1, "ok", None)}}


def histories(r, steps):
    """Histories of one project that grow, and sometimes lose, soften or settle findings."""
    now, out = [], []
    for _ in range(steps):
        now = [dict(f) for f in now]
        for f in now:
            if r.random() < 0.5 and f["status"] in ("open", "deferred"):
                f["status"], f["resolution_note"] = r.choice(["resolved", "rejected", "deferred", "resolved"]), r.choice(["seen", "seen", " ", None])
            if r.random() < 0.05:
                f["severity"] = "minor"
        if now and r.random() < 0.15:
            now = now[:-1]
        for _ in range(r.randrange(3)):
            now.append({"finding_id": f"F{r.random():.9f}", "resolution_note": None, "severity": r.choice(["critical", "major", "minor"]), "status": r.choice(["open", "open", "resolved"])})
        out.append(now)
    return out


def test_rounds_as_a_stream(spark, tmp_path):
    r, steps = random.Random(8), 6
    every = {f"p{i}": histories(r, steps) for i in range(14)}
    kind = f"project string, seq long, history {R.HISTORY}"
    flat = "project string, ord int, finding_id string, resolution_note string, severity string, status string"
    want, certified = set(), None
    for k in range(steps):  # each step by the batch operators
        f = spark.createDataFrame([(p, i, *(x[n] for n in ("finding_id", "resolution_note", "severity", "status"))) for p, h in every.items() for i, x in enumerate(h[k])], flat)
        projects = spark.createDataFrame([(p,) for p, h in every.items() if h[k]], "project string")
        before = certified if certified is not None else spark.createDataFrame([], "project string, review_round int, status string, finding_ids array<string>, blocking_findings long, blocking_finding_ids array<string>, findings_sha256 string")
        step = release.next_rounds(projects, before, f)
        made = history.certificates(f.withColumn("round", F.lit(1)), before.select("project", "status")).drop("review_round", "findings").join(step, "project")
        rows = made.collect()
        want |= {(x.project, k, x.review_round, None if x.problem else x.status, x.problem) for x in rows}
        new = made.where("problem is null").select(before.columns)
        kept = before.join(new.select("project"), "project", "left_anti").select(before.columns)
        certified = spark.createDataFrame(new.unionByName(kept).collect(), before.schema)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (range(2), range(2, 3), range(3, steps)):  # three runs of one query
            rows = [(p, k, h[k]) for p, h in every.items() for k in part if h[k]]
            r.shuffle(rows)
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = R.certified_rounds(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select("project", "seq", "review_round", "status", "problem").collect()}
    assert got == want
    assert {x[4] for x in want} >= {None, "finding lost", "still blocked"} and {x[3] for x in want} >= {"clear", "blocking", "needs_human"}
