"""Validation of records, scores without a grid, and the gate over all checks."""

import json

import pytest
from pyspark.sql import functions as F

from bitloom.operators import gate, scoring, subtitles
from bitloom.sources import validation as V, writers

HEX = "ab" * 32


def texts(spark, *values):
    return spark.createDataFrame([(str(i), v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "path string, text string")


def problems(df):
    return [r.problem for r in df.orderBy(F.col("path").cast("int")).collect()]


def case(i, track, **more):
    return {"case_id": i, "track": track, "source": "s", "gold": {}} | ({"target": "t"} if track == "bilingual_review" else {}) | more


def test_gold(spark):
    a, b = case("a", "source_analysis"), case("b", "bilingual_review")
    good = {"version": 1, "cases": [a, b]}
    bad = [
        good | {"version": 2}, good | {"cases": [a, b, a]}, good | {"cases": [a]}, good | {"cases": [a | {"target": "t"}, b]}, good | {"cases": [a, {k: v for k, v in b.items() if k != "target"}]}, good | {"cases": [a | {"source_context": []}, b]},
        good | {"cases": [a | {"metadata": {"genre": "x"}}, b]}, good | {"cases": [a, b | {"track": "other"}]}, "no json", good | {"cases": [a | {"case_id": ""}, b]},
    ]
    found = problems(V.read_gold(texts(spark, good, good | {"cases": [a | {"metadata": {"formality": "f"}, "source_context": ["x"]}, b]}, *bad)))
    assert found[:2] == [None, None] and all(found[2:]), found


def test_analyses_and_freshness(spark):
    a = {"provider": "p", "source_sha256": HEX, "project_sha256": HEX, "term_map_sha256": HEX, "paragraphs": [{"paragraph_id": "L2", "status": "clear"}, {"paragraph_id": "L10", "status": "needs_human"}]}
    read = V.read_analyses(texts(spark, a, a | {"provider": " "}, a | {"source_sha256": "AB"}, a | {"paragraphs": [{"paragraph_id": "L0"}]}, a | {"paragraphs": 2 * a["paragraphs"][:1]}, "x", a))
    assert problems(read) == [None, "no provider", "bad digest", "bad paragraph_id", "repeated paragraph_id", "no provider", None]
    current = spark.createDataFrame([("0", HEX, HEX, HEX), ("6", HEX, "cd" * 32, HEX)], "path string, source_sha256 string, project_sha256 string, term_map_sha256 string")
    assert [(r.doc_id, r.line_no, r.paragraph_id) for r in V.fresh_paragraphs(read, current).orderBy("line_no").collect()] == [("0", 2, "L2"), ("0", 10, "L10")]


def test_shown_fields(spark):
    terms = {"version": 1, "terms": [{"source": "空", "preferred": "e", "allowed": ["f"], "reviewer": "someone", "status": "approved"}]}
    assert json.loads(V.shown_terms(texts(spark, terms)).first().json) == {"version": 1, "terms": [{"source": "空", "preferred": "e", "allowed": ["f"], "status": "approved"}]}
    shown = json.loads(V.shown_project(texts(spark, {"title": "t", "translator": "x", "versions": {}, "release": {"level": "public", "approval": {"approver": "y"}}})).first().json)
    assert shown == {"title": "t", "release": {"level": "public"}}


def test_runs_and_costs(spark):
    run = {"provider": "p", "model": "m", "track": "source_analysis", "run": 1, "request_sha256": HEX, "usage": {"prompt_tokens": 1_000_000, "completion_tokens": 500_000}}
    prices = spark.createDataFrame([("p", "m", 2.0, 4.0)], "provider string, model string, prompt_price double, completion_price double")
    got = V.read_runs(texts(spark, run, run | {"model": "other"}, run | {"track": "x"}, run | {"request_sha256": "1"}, "{}"), prices).orderBy(F.col("path").cast("int")).collect()
    assert [(r.estimated_cost, r.problem) for r in got] == [(4.0, None), (None, None), (4.0, "bad track"), (4.0, "bad digest"), (None, "unreadable")]


def test_source_responses(spark):
    role = {"predicate": "p", "role": "agent", "participant": None, "evidence_status": "ambiguous"}
    one = {"case_id": "a", "predicates": ["p"], "roles": [role], "relations": ["cause"], "scopes": [{"kind": "tense", "marker": None, "scope": "s"}], "ambiguities": [], "must_not_invent": [], "status": "clear"}
    cases = spark.createDataFrame([(0, "a", "source_analysis"), (1, "b", "bilingual_review")], "ord int, case_id string, track string")
    bad = [one | {"status": "x"}, one | {"roles": [role | {"role": "hero"}]}, one | {"relations": ["love"]}, one | {"scopes": [{"kind": "tense"}]}, one | {"extra": 1}, one | {"case_id": "b"}, one | {"predicates": [1]}]
    found = problems(V.response_problems(texts(spark, {"results": [one]}, *({"results": [x]} for x in bad), {"results": []}, {}), cases, "source_analysis"))
    assert found[0] is None and all(found[1:])


def test_scores_of_missing_cases(spark):
    """A case without output scores 0, and so does a whole invalid run; nothing is paired that doesn't share a case."""
    role = "array<struct<predicate:string,role:string,participant:string,evidence_status:string>>"
    gold = spark.createDataFrame([("a", ["p"], [], [], [], ["p.r"]), ("b", ["q"], [], [], [], [])], f"case_id string, predicates array<string>, roles {role}, relations array<string>, scopes array<string>, ambiguities array<string>")
    runs = spark.createDataFrame([("x", 1, "a", ["p"], [("p", "r", None, "ambiguous")], [], []), ("x", 2, None, None, None, None, None), ("y", 1, None, None, None, None, None)], f"provider string, run int, case_id string, predicates array<string>, roles {role}, relations array<string>, scopes array<string>")
    got = {r.provider: r for r in scoring.source_scores(gold, runs).collect()}
    assert (got["x"].predicate_f1, got["x"].relation_f1, got["x"].ambiguity_preservation_rate, got["y"].predicate_f1) == (0.25, 0.25, 0.5, 0.0)


def test_full_report(spark):
    d = spark.createDataFrame([(1, ["a"], ["b"]), (2, ["a"], ["b"]), (3, ["a"], ["**b**"])], "doc_id int, src array<string>, tgt array<string>")
    digits = spark.createDataFrame([(1, "PASS"), (2, "WARN"), (3, "PASS")], "doc_id int, status string")
    terms = spark.createDataFrame([(1, "PASS"), (2, "PASS")], "doc_id int, status string")
    got = {(strict, r.doc_id): r for strict in (False, True) for r in gate.full_report(d, {"digits": digits, "terminology": terms}, strict).collect()}
    assert [got[False, i].overall for i in (1, 2, 3)] == ["PASS", "WARN", "FAIL"] and got[False, 2].warned == "digits" and got[False, 3].skipped == "terminology" and got[False, 3].failed == "bold_leakage"
    skipping = {r.doc_id: r.overall for r in gate.full_report(d, {"terminology": terms.where("doc_id = 1")}, True).collect()}
    assert skipping == {1: "PASS", 2: "SKIP", 3: "FAIL"}


def test_checked_writing(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "bad")], "k int, problem string")
    with pytest.raises(ValueError, match="bad"):
        writers.write_checked(rows, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()
    writers.write_checked(rows.where("k = 1"), str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).collect()[0].k == 1


def test_timing_of_all_files(spark):
    cue = lambda e: spark.createDataFrame([(1, 1, 0, 1000), (1, 2, 1000, e)], "track int, cue int, start_ms long, end_ms long")
    got = subtitles.same_timing_all({"source.srt": cue(2000), "source.vtt": cue(2000), "target.srt": cue(2500)}, "source.srt").collect()
    assert {r.file: r.aligned for r in got} == {"source.vtt": True, "target.srt": False}
