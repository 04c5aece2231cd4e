import json

import pytest
from pyspark.sql import functions as F

from bitloom.functions import json_schema
from bitloom.operators import analysis, cleanup, history, scoring, subtitles
from bitloom.sources import readers, writers
from bitloom.streaming import histories

FIND = "finding_id string, ord long, severity string, status string"


def test_merge(spark):
    old = spark.createDataFrame([("a", 0, "major", "open"), ("b", 1, "minor", "open")], FIND)
    new = spark.createDataFrame([("b", 0, "minor", "open"), ("c", 1, "major", "open")], FIND)
    merged = history.merge(old, new)
    assert [r.finding_id for r in merged.orderBy("ord").collect()] == ["a", "b", "c"]
    assert history.merge(merged, new).count() == 3  # once more changes nothing
    with pytest.raises(Exception, match="different finding"):
        history.merge(old, spark.createDataFrame([("a", 0, "minor", "open")], FIND)).collect()


def test_rounds_and_certificates(spark):
    f = spark.createDataFrame([("p", "a", 0, "minor", "open", 1), ("p", "b", 1, "minor", "open", 2), ("p", "c", 2, "critical", "open", 3), ("q", "d", 3, "major", "open", 1), ("q", "e", 4, "minor", "open", 2)], "project string, finding_id string, ord int, severity string, status string, round int")
    assert {(r.project, r.round): r.status for r in history.rounds(f).collect()} == {("p", 1): "clear", ("p", 2): "clear", ("p", 3): "blocking", ("q", 1): "blocking", ("q", 2): "needs_human"}
    before = history.certificates(f.where("round < 3"))
    after = {r.project: r.status for r in history.certificates(f, before).collect()}
    assert after == {"p": "blocking", "q": "needs_human"}


def test_f1(spark):
    e = lambda a, b: spark.range(1).select(scoring.set_f1(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>"))).first()[0]
    assert (e([], []), e(["a"], []), e(["a", "b"], ["b", "c", "b"]), e(["a"], ["a"])) == (1.0, 0.0, 0.5, 1.0)


def test_selection_with_a_tie(spark):
    s = spark.createDataFrame([("t", "x", 0.5, True), ("t", "y", 0.5, True), ("u", "x", 0.5, True), ("u", "y", 0.9, False), ("v", "x", 0.1, False)], "track string, provider string, s double, hard_gate_pass boolean")
    assert {r.track: r.selected for r in scoring.select_best(s, [F.col("s").desc()], ["track"]).collect()} == {"t": None, "u": "x", "v": None}


def test_review_scores(spark):
    gold = spark.createDataFrame([("c1", ["x", "y"], False), ("c2", [], True)], "case_id string, blocking_codes array<string>, control boolean")
    runs = spark.createDataFrame([("p", 1, "c1", [("x", "major"), ("z", "minor")]), ("p", 1, "c2", [("w", "minor")]), ("q", 1, None, None)], "provider string, run int, case_id string, findings array<struct<code:string,severity:string>>")
    assert {r.provider: (r.blocking_recall, r.control_false_positive_rate) for r in scoring.review_scores(gold, runs).collect()} == {"p": (0.5, 1.0), "q": (0.0, 0.0)}


def test_source_scores(spark):
    role = "array<struct<predicate:string,role:string,participant:string,evidence_status:string>>"
    kinds = f"predicates array<string>, roles {role}, relations array<string>, scopes array<string>, ambiguities array<string>"
    gold = spark.createDataFrame([("c", ["a"], [("a", "agent", None, "ambiguous")], [], [], ["a.agent"])], f"case_id string, {kinds}")
    runs = spark.createDataFrame([("p", 1, "c", ["a", "b"], [("a", "agent", None, "ambiguous")], [], [], []), ("p", 2, None, None, None, None, None, None), ("q", 1, "c", ["a"], [("a", "agent", "x", "explicit")], [], [], [])], f"provider string, run int, case_id string, {kinds}")
    got = {r.provider: r for r in scoring.source_scores(gold, runs).collect()}
    assert (round(got["p"].predicate_f1, 4), got["p"].role_f1, got["p"].ambiguity_preservation_rate) == (0.3333, 0.5, 0.5)
    assert (got["q"].role_f1, got["q"].ambiguity_preservation_rate) == (0.0, 0.0)


def test_subtitles(spark):
    c = spark.createDataFrame([("t", 1, 0, 2000, "x" * 90), ("u", 1, 0, 2000, "short"), ("u", 2, 2000, 2000, "y")], "track string, cue int, start_ms long, end_ms long, text string")
    got = {r.track: (r.timing, r.line_length, r.reading_speed) for r in subtitles.checks(c).collect()}
    assert got == {"t": ("PASS", "FAIL", "FAIL"), "u": ("FAIL", "PASS", "FAIL")}
    vtt = subtitles.render(c, vtt=True)
    assert vtt.where("track = 'u'").first().file.startswith("WEBVTT\n\n00:00:00.000 --> 00:00:02.000\nshort\n")
    assert {r.problem for r in subtitles.parse(vtt, vtt=True).collect()} == {None}
    bad = spark.createDataFrame([("b", "2\n00:00:00,000 --> 00:00:01,000\nx\n\n2\nnever\ny\n\n3\n00:00:00,000 --> 00:00:01,000")], "track string, file string")
    assert [r.problem for r in subtitles.parse(bad).orderBy("cue").collect()] == ["bad index", "bad time line", "too few lines"]
    m = spark.createDataFrame([("t", "a", 0.0, 1.5, 1), ("t", "b", 1.0, 0.5, 0)], "track string, id string, start double, end double, source_line int")
    assert [(r.id, r.problem) for r in subtitles.map_problems(m).collect()] == [("b", "ends before it starts")]


def test_clean_up(spark):
    rows = ["第一行中文", "接着", "12", "", "一、标题", "Alone", "后文", "more", "", "", "x"]
    d = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(rows)], "doc_id int, line_no int, text string")
    joined = [r.text for r in cleanup.join_body(d).orderBy("line_no").collect()]
    assert joined == ["第一行中文接着", "", "一、标题", "Alone", "后文more", "", "", "x"]
    assert cleanup.toc_end(d).first().toc_end == 0
    h = spark.createDataFrame([(1, 1, "a-"), (1, 2, "b-"), (1, 3, "c"), (1, 4, "d-"), (1, 5, "E")], "doc_id int, line_no int, text string")
    assert [r.text for r in cleanup.dehyphenate(h).orderBy("line_no").collect()] == ["abc", "d-", "E"]
    assert [r.text for r in cleanup.dehyphenate(h, chains=False).orderBy("line_no").collect()] == ["ab-", "c", "d-", "E"]
    t = spark.createDataFrame([(1, "emptiness and emptiness and calm")], "doc_id int, text string")
    assert cleanup.first_mentions(t, ["emptiness", "calm", "zz"]).first().text == "*emptiness* and emptiness and *calm*"
    assert [r.line_no for r in cleanup.body_from(h, "c").orderBy("line_no").collect()] == [3, 4, 5]


@pytest.mark.parametrize("size", [1, 2, 4, 9])
def test_batches_report_each_line_once(spark, size):
    d = spark.createDataFrame([(1, i) for i in range(1, 7)], "doc_id int, line_no int")
    got = cleanup.batches(d, size).collect()
    assert sorted(r.line_no for r in got if r.role == "focus") == [1, 2, 3, 4, 5, 6]
    for b in {r.batch for r in got}:
        own = [r.line_no for r in got if r.batch == b and r.role == "focus"]
        assert sorted(r.line_no for r in got if r.batch == b and r.role == "context") == [x for x in (own[0] - 1, own[-1] + 1) if 1 <= x <= 6]


def test_json_schema():
    s = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "uniqueItems": True, "items": {"type": ["string", "null"], "minLength": 1}}, "c": {"enum": [1, "x"]}}, "additionalProperties": False, "if": {"properties": {"a": {"const": 2}}}, "then": {"required": ["b"]}}
    first = json_schema.first_error
    assert first('{"a": 1}', s) is None and first('{"a": 1.0}', s) is None
    assert first('{"a": true}', s) == "$.a: not integer" and first("{", s) == "$: not JSON" and first("{}", s) == "$: lacks b"
    assert first('{"a": 2}', s) == "$: lacks b" and first('{"a": 0}', s) == "$.a: out of range" and first('{"a": 1, "z": 1}', s) == "$: unknown field z"
    assert first('{"a": 1, "b": ["x", "x"]}', s) == "$.b: repeated items" and first('{"a": 1, "b": [null, ""]}', s) == "$.b[1]: too short" and first('{"a": 1, "c": true}', s) == "$.c: not one of the allowed values"
    assert json_schema.wire_schema({"type": "object", "properties": {"pattern": {"type": "string", "pattern": "x"}}}) == {"type": "object", "properties": {"pattern": {"type": "string"}}}


def test_readers(spark, tmp_path):
    (tmp_path / "a.dj").write_bytes("甲\r\n\n乙".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff")
    d = {r.path.rsplit("/", 1)[1]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert {k: v.problem for k, v in d.items()} == {"a.dj": None, "b.txt": "not UTF-8"}
    lines = readers.document_lines(readers.read_documents(spark, f"{tmp_path}/a.dj")).orderBy("line_no").collect()
    assert [(r.line_no, r.paragraph_id, r.text) for r in lines] == [(1, "L1", "甲"), (2, None, ""), (3, "L3", "乙")]
    n = readers.normalise_plain(spark.createDataFrame([("p", "é\r\nx")], "path string, text string"))
    assert n.first().text == "é\nx\n"


def test_term_readers(spark):
    md = "| 中文 | English |\n|---|---|\n| 止、奢摩他 | calm / calm abiding |\n| 止 | stillness |\n"
    t = readers.term_map_table(spark.createDataFrame([("p", md)], "path string, text string"))
    got = {r.source: r.renderings for r in t.collect()}
    assert got["止"] == ["stillness"] and got["奢摩他"] == ["calm", "calm abiding"]
    j = '{"version": 1, "terms": [{"source": "止", "preferred": "calm", "status": "selected"}, {"source": "", "preferred": "x", "status": "selected"}, {"source": "观", "preferred": "insight", "forbidden": ["Insight"], "status": "selected"}]}'
    assert [r.problem for r in readers.term_map_json(spark.createDataFrame([("p", j), ("q", "no")], "path string, text string")).orderBy("path", "term.preferred").collect()] == [None, "allowed and forbidden", "no source", "unreadable"]
    c = readers.term_candidates(spark.createDataFrame([("p", '{"terms": ["止", {"source": "观", "sense": "s"}, " 止 "]}'), ("q", '["甲"]')], "path string, text string"))
    assert [(r.path, r.source, r.sense) for r in c.orderBy("path", "ord").collect()] == [("p", "止", ""), ("p", "观", "s"), ("q", "甲", "")]


def test_findings_reader(spark):
    ok = '{"finding_id": "a", "paragraph_id": "L1", "severity": "major", "category": "meaning", "message": "m", "suggestion": "", "status": "open", "reviewer": "r"}'
    other = lambda i, *change: ok.replace('"a"', f'"{i}"').replace(*change)
    lines = [
        ok, "", "[1]", other("b", "}", ', "x": 1}'), other("c", "major", "suggestion"), other("d", "major", "discussion"), other("e", '"m"', '" "'), other("f", "open", "deferred"), other("g", "open", "needs_human"),
        other("h", "meaning", "c"), ok, other("i", "}", ', "source_sha256": "AB"}'), other("j", ', "reviewer": "r"', ""), other("k", '"suggestion": ""', '"suggestion": null'),
    ]
    d = spark.createDataFrame([("p", i, t) for i, t in enumerate(lines)], "path string, line_no int, text string")
    enum = "not one of the allowed values"
    want = [None, "blank line", "$: not object", "$: unknown field x", f"$.severity: {enum}", None, "$.message: does not match", None, f"$.status: {enum}", f"$.category: {enum}", "repeated id", "$.source_sha256: does not match", "$: lacks reviewer", "$.suggestion: not string"]
    assert [r.problem for r in readers.findings_jsonl(d, history=True).orderBy("line_no").collect()] == want
    assert [r.problem for r in readers.findings_jsonl(d).orderBy("line_no").collect()] == [w for w in want if w != "blank line"]


def test_certificate_reader(spark):
    h = "0" * 64
    ok = {"schema_version": 1, "stage": "semantic_review", "provider": "p", "model": "m", "source_sha256": h, "target_sha256": h, "review_round": 2, "blocking_findings": 1, "blocking_finding_ids": ["a"], "status": "blocking", "finding_ids": ["a", "b"], "findings_sha256": h, "generated_at": "2026-01-02T03:04:05Z", "summary": "s"}
    cases = [
        ({}, None), ({"schema_version": 2}, "$.schema_version: not 1"), ({"stage": "x"}, '$.stage: not "semantic_review"'), ({"review_round": True}, "$.review_round: not integer"), ({"review_round": 0}, "$.review_round: out of range"),
        ({"finding_ids": ["a", "a"]}, "$.finding_ids: repeated items"), ({"finding_ids": [" "]}, "$.finding_ids[0]: does not match"), ({"summary": ""}, "$.summary: does not match"), ({"x": 1}, "$: unknown field x"),
        ({"blocking_findings": 2}, "count does not match"), ({"status": "clear"}, "status does not match"), ({"generated_at": "2026-01-02T03:04:05"}, "bad time"), ({"blocking_findings": 0, "blocking_finding_ids": [], "status": "clear"}, None),
    ]
    d = spark.createDataFrame([(str(i).zfill(2), json.dumps(ok | change)) for i, (change, _) in enumerate(cases)] + [("zz", "{")], "path string, text string")
    assert [r.problem for r in readers.certificates_json(d).orderBy("path").collect()] == [want for _, want in cases] + ["$: not JSON"]


def test_manifest(spark, tmp_path):
    base = f"file://{tmp_path}"
    writers.commit_together(spark, base, {"a": spark.range(2), "b": spark.range(3)})
    writers.commit_together(spark, base, {"a": spark.range(5), "b": spark.range(6)})
    assert {k: v.count() for k, v in writers.read_current(spark, base).items()} == {"a": 5, "b": 6}


def test_sheet(spark, tmp_path):
    (tmp_path / "t.csv").write_text('zh,en,en,,\n甲,"two\nlines",x,,\n,,,,\n乙,B\n', encoding="utf-8")
    d = readers.sheet_csv(spark, str(tmp_path / "t.csv"))
    assert d.columns == ["zh", "en", "en_2"] and [tuple(r) for r in d.collect()] == [("甲", "two\nlines", "x"), ("乙", "B", "")]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "finding_id string, n int").coalesce(1).write.parquet(str(src))
    read = lambda: spark.readStream.schema("finding_id string, n int").parquet(str(src))
    for _ in range(2):
        histories.append_new(read(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        spark.createDataFrame([("c", 4), ("b", 5)], "finding_id string, n int").coalesce(1).write.mode("append").parquet(str(src))
    assert sorted(r.finding_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_coverage_and_review_rules(spark):
    c = spark.range(1).select(analysis.coverage(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"))).alias("c")).first().c
    assert (c.missing, c.unknown, c.repeated, c.ordered) == ([], [], False, False)
    f = spark.createDataFrame([("X-1", "major", "open", "me", "消息"), ("X-2", "major", "open", "me", "no"), ("Y-3", "major", "open", "me", "消息")], "finding_id string, severity string, status string, reviewer string, message string")
    assert [r.p for r in f.select(analysis.review_problem("me", "X-").alias("p")).collect()] == [None, "message", "finding_id"]
