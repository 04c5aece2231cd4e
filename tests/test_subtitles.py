"""The whole subtitle report, source maps in the order given, and bare headers."""

from bitloom.operators import subtitles
from bitloom.plans import text_queries as Q
from bitloom.sources import readers

from . import oracle


def test_report(spark):
    names, rows = oracle.rows(Q.subtitle_report(spark, "/root/testdata/sf0.01"))
    assert (names, rows) == oracle.expected(Q.SUBTITLE_REPORT_SQL, "/root/testdata/sf0.01")
    seen = {(r[names.index("check")], r[names.index("status")]) for r in rows}
    assert {c for c, s in seen if s == "FAIL"} >= {"target.vtt:coverage", "source.srt:coverage", "bilingual_timing_alignment", "srt_vtt_content_alignment", "english_reading_speed"}
    assert len({c for c, _ in seen}) == 17


def test_report_without_cues(spark):
    none = spark.createDataFrame([], "track string, file string, cue int, start_ms long, end_ms long, text string")
    got = {r.check: r.status for r in subtitles.report(none, spark.createDataFrame([("t", 1)], "track string, n int")).collect()}
    assert {c for c, s in got.items() if s == "FAIL"} == {f"{f}:coverage" for f in subtitles.FILES} and len(got) == 17


def test_source_maps(spark):
    text = '{"segments": [{"id": "a", "start": 0, "end": 1, "source_line": 1}, {"id": "c", "start": 4, "end": 5, "source_line": 2}, {"id": "b", "start": 2, "end": 3, "source_line": 9}, {"id": "d", "start": -1, "end": 6, "source_line": 1}, {"id": "e", "start": 6, "end": 7}]}'
    m = readers.source_map_json(spark.createDataFrame([("t", text)], "path string, text string"))
    n = spark.createDataFrame([("t", 3)], "track string, n long")
    assert {r.id: r.problem for r in subtitles.map_problems(m, n).collect()} == {"b": "overlaps", "d": "bad time", "e": "no line"}
    late = m.where("id <> 'c'").select("track", "ord", "id", "start", "end", "source_line")
    assert {r.id: r.problem for r in subtitles.map_problems(late, n).collect()} == {"b": "no line", "d": "bad time", "e": "no line"}


def test_header(spark):
    d = spark.createDataFrame([("a", "WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nx\n"), ("b", "WEBVTT junk\n\n00:00:00.000 --> 00:00:01.000\nx\n")], "track string, file string")
    got = {(r.track, r.problem) for r in subtitles.parse(d, vtt=True).collect()}
    assert ("a", None) in got and {p for t, p in got if t == "b"} == {"no header"}
