"""Subtitle cues: timestamps, rendering, parsing, and quality checks.

A cue is (track, cue, start_ms, end_ms, text); times are whole milliseconds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import as_column, is_blank, split_lines

# Limits of line length and reading speed.
MAX_CHINESE_LINE, MAX_ENGLISH_LINE, MAX_CPS = 22, 42, 20.0


def milliseconds(seconds: Column | str) -> Column:
    """Seconds as a double to whole milliseconds, ties to even."""
    return F.bround(as_column(seconds) * 1000, 0).cast("long")


def timestamp(ms: Column | str, vtt: bool = False) -> Column:
    """``HH:MM:SS,mmm``, with a dot in VTT."""
    t = as_column(ms)
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    hours = F.floor(t / 3600000).cast("long")
    # lpad would cut more than two digits off
    hh = F.when(hours < 100, part(hours, 2)).otherwise(hours.cast("string"))
    return F.concat(hh, F.lit(":"), part(F.floor(t / 60000).cast("long") % 60, 2), F.lit(":"), part(F.floor(t / 1000).cast("long") % 60, 2), F.lit("." if vtt else ","), part(t % 1000, 3))


def parse_timestamp(text: Column | str) -> Column:
    """Milliseconds of ``HH:MM:SS,mmm`` or ``HH:MM:SS.mmm``; null for other texts."""
    t = as_column(text)
    m = "\\A(\\d{2,}):([0-5]\\d):([0-5]\\d)[,.](\\d{3})\\z"
    g = lambda i: F.regexp_extract(t, m, i).cast("long")
    return F.when(t.rlike(m), ((g(1) * 60 + g(2)) * 60 + g(3)) * 1000 + g(4))


def render(cues: DataFrame, vtt: bool = False) -> DataFrame:
    """track, file: numbered SRT blocks, or VTT with its header, in cue order."""
    body = F.concat(timestamp("start_ms", vtt), F.lit(" --> "), timestamp("end_ms", vtt), F.lit("\n"), F.col("text"), F.lit("\n"))
    block = body if vtt else F.concat(F.col("cue").cast("string"), F.lit("\n"), body)
    sorted_ = F.array_sort(F.collect_list(F.struct("cue", block.alias("b"))))
    joined = F.array_join(F.transform(sorted_, lambda x: x["b"]), "\n")
    return cues.groupBy("track").agg((F.concat(F.lit("WEBVTT\n\n"), joined) if vtt else joined).alias("file"))


def parse(files: DataFrame, vtt: bool = False) -> DataFrame:
    """track, cue, start_ms, end_ms, text, problem of each block of ``file``.

    SRT blocks need an index that counts from 1, a time line and text; VTT needs its header.
    problem is null for a sound block.
    """
    text = F.regexp_replace(F.regexp_replace("file", "\\r\\n?", "\n"), "\\A\\x{FEFF}", "")
    head = text.startswith("WEBVTT\n")
    body = F.regexp_replace(text, "\\AWEBVTT\\n+", "") if vtt else text
    blocks = F.filter(F.split(body, "\\n{2,}"), lambda b: ~is_blank(b))
    d = files.select("track", F.posexplode(blocks).alias("i", "b"), head.alias("head")).withColumn("l", F.filter(F.split("b", "\\n"), lambda x: ~is_blank(x)))
    at = 0 if vtt else 1
    times = F.split(F.get("l", F.lit(at)), "\\s+-->\\s+")
    start, end = parse_timestamp(F.trim(F.get(times, F.lit(0)))), parse_timestamp(F.trim(F.regexp_replace(F.get(times, F.lit(1)), "\\s.*\\z", "")))
    problem = F.when(F.size("l") < at + 2, "too few lines").when(start.isNull() | end.isNull(), "bad time line")
    if vtt:
        problem = F.when(~F.col("head"), "no header").otherwise(problem)
    else:
        problem = F.when(~F.coalesce(F.trim(F.get("l", F.lit(0))) == (F.col("i") + 1).cast("string"), F.lit(False)), "bad index").otherwise(problem)
    lines = F.when(F.size("l") > at + 1, F.slice("l", at + 2, F.greatest(F.size("l") - at - 1, F.lit(1))))
    return d.select("track", (F.col("i") + 1).alias("cue"), start.alias("start_ms"), end.alias("end_ms"), F.array_join(lines, "\n").alias("text"), problem.alias("problem"))


def characters_per_second(text: Column, start: Column, end: Column) -> Column:
    """Characters without line ends per second; null for an empty span."""
    n = F.length(F.regexp_replace(text, "\\n", ""))
    return F.when(end > start, n * 1000.0 / (end - start))


def ordered(cues: DataFrame) -> DataFrame:
    """``cues`` with ok_order: a cue ends after it starts and starts no earlier than the one before ends."""
    before = F.lag("end_ms").over(Window.partitionBy("track").orderBy("cue"))
    return cues.withColumn("ok_order", (F.col("end_ms") > F.col("start_ms")) & (F.col("start_ms") >= F.coalesce(before, F.lit(0))))


def checks(cues: DataFrame, english: bool = True) -> DataFrame:
    """track, cues, timing, line_length, reading_speed: PASS or FAIL over all cues of each track."""
    limit = MAX_ENGLISH_LINE if english else MAX_CHINESE_LINE
    d = ordered(cues)
    short = F.forall(split_lines("text"), lambda x: F.length(x) <= limit)
    slow = F.coalesce(characters_per_second(F.col("text"), F.col("start_ms"), F.col("end_ms")) <= MAX_CPS, F.lit(False))
    say = lambda c: F.when(F.bool_and(c), "PASS").otherwise("FAIL")
    return d.groupBy("track").agg(F.count("*").alias("cues"), say(F.col("ok_order")).alias("timing"), say(short).alias("line_length"), (say(slow) if english else F.lit("N/A")).alias("reading_speed"))


def same_timing(a: DataFrame, b: DataFrame) -> DataFrame:
    """track, aligned: both have the same cues with the same times (a full outer join by cue)."""
    x = a.select("track", "cue", F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"))
    y = b.select("track", "cue", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    j = x.join(y, ["track", "cue"], "full_outer")
    return j.groupBy("track").agg(F.bool_and(F.col("s1").eqNullSafe(F.col("s2")) & F.col("e1").eqNullSafe(F.col("e2"))).alias("aligned"))


def same_timing_all(tracks: dict[str, DataFrame], source: str) -> DataFrame:
    """track, file, aligned: each file of ``tracks`` (by name) against the ``source`` file, cue by cue."""
    found = [same_timing(tracks[source], d).withColumn("file", F.lit(n)) for n, d in tracks.items() if n != source]
    return reduce(DataFrame.unionByName, found)


def from_map(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """Cues from a source map: segments (track, id, start, end in seconds, source_line) with their non-blank lines; a blank or missing line is an error."""
    n = F.row_number().over(Window.partitionBy("track").orderBy("start", "id"))
    j = segments.join(lines.select("track", F.col("line_no").alias("source_line"), F.col("text").alias("line")), ["track", "source_line"], "left")
    text = F.when(F.col("line").isNull() | is_blank("line"), F.raise_error(F.concat(F.lit("no text for segment "), F.col("id").cast("string")))).otherwise(F.col("line"))
    return j.select("track", n.cast("int").alias("cue"), milliseconds("start").alias("start_ms"), milliseconds("end").alias("end_ms"), text.alias("text"))


def map_problems(segments: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """track, id, problem of segments, in the order given by ``ord`` (without it, by start), that have no sound times, end before they start, start before the one before them ends, repeat an id or name no line.

    ``lines`` (track, n) has the number of lines of each source, beyond which there are none.
    """
    w = Window.partitionBy("track").orderBy(*(["ord"] if "ord" in segments.columns else ["start", "id"]))
    d = segments.withColumn("before", F.lag("end").over(w)).withColumn("same", F.count("*").over(Window.partitionBy("track", "id")))
    d = d.join(lines.select("track", "n"), "track", "left") if lines is not None else d.withColumn("n", F.lit(None).cast("long"))
    sound = lambda c: F.coalesce((F.col(c) >= 0) & (F.col(c) < float("inf")) & ~F.isnan(c), F.lit(False))
    problem = (
        F.when(~sound("start") | ~sound("end"), "bad time").when(F.col("end") <= F.col("start"), "ends before it starts").when(F.col("start") < F.col("before"), "overlaps").when(F.col("same") > 1, "repeated id")
        .when(F.coalesce(F.col("source_line") < 1, F.lit(True)) | F.coalesce(F.col("source_line") > F.col("n"), F.lit(False)), "no line")
    )
    return d.withColumn("problem", problem).where("problem is not null").select("track", "id", "problem")


# The files of a subtitled project.
STEMS = ("source", "target", "bilingual")
FILES = tuple(f"{stem}.{kind}" for kind in ("srt", "vtt") for stem in STEMS)


def report(cues: DataFrame, expected: DataFrame) -> DataFrame:
    """track, check, status: all checks of the six files of each track.

    ``cues``: track, file, cue, start_ms, end_ms, text; ``expected``: track, n, the segments of its source map. Each file covers
    all segments and is in order; all have one timing; each SRT file says what its VTT file says; lines are short and English is slow
    enough to read. A file without cues covers nothing and is in order. One pass by (track, file) and one by (track, cue).
    """
    before = F.lag("end_ms").over(Window.partitionBy("track", "file").orderBy("cue"))
    english = F.col("file") == "target.srt"
    lines = lambda limit: F.forall(split_lines("text"), lambda x: F.length(x) <= limit)
    d = cues.withColumn("in_order", (F.col("end_ms") > F.col("start_ms")) & (F.col("start_ms") >= F.coalesce(before, F.col("start_ms"))))
    slow = F.coalesce(characters_per_second(F.col("text"), F.col("start_ms"), F.col("end_ms")) <= MAX_CPS, F.lit(False))
    of = lambda f: F.col("file") == f
    every = lambda which, ok: F.coalesce(F.bool_and(F.when(which, ok)), F.lit(True))
    sums = [F.count_if(of(f)).alias(f"{f}:n") for f in FILES] + [every(of(f), F.col("in_order")).alias(f"{f}:timing") for f in FILES]
    own = d.groupBy("track").agg(*sums, every(of("source.srt"), lines(MAX_CHINESE_LINE)).alias("chinese_line_length"), every(english, lines(MAX_ENGLISH_LINE)).alias("english_line_length"), every(english, slow).alias("english_reading_speed"))
    when = F.struct("start_ms", "end_ms")
    whole = F.struct("start_ms", "end_ms", "text")
    mirrored = [(F.count_if(F.col("file").startswith(f"{s}.")) % 2 == 0) & (F.count_distinct(F.when(F.col("file").startswith(f"{s}."), whole)) <= 1) for s in STEMS]
    cue = cues.groupBy("track", "cue").agg(((F.count("*") == len(FILES)) & (F.count_distinct(when) == 1)).alias("aligned"), (mirrored[0] & mirrored[1] & mirrored[2]).alias("mirrored"))
    both = cue.groupBy("track").agg(F.bool_and("aligned").alias("bilingual_timing_alignment"), F.bool_and("mirrored").alias("srt_vtt_content_alignment"))
    j = expected.join(own, "track", "left").join(both, "track", "left")
    covers = {f"{f}:coverage": F.coalesce(F.col(f"`{f}:n`"), F.lit(0)) == F.col("n") for f in FILES}
    rest = [*(f"{f}:timing" for f in FILES), "bilingual_timing_alignment", "srt_vtt_content_alignment", "chinese_line_length", "english_line_length", "english_reading_speed"]
    found = [*covers.items(), *((n, F.coalesce(F.col(f"`{n}`"), F.lit(True))) for n in rest)]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.when(ok, "PASS").otherwise("FAIL").alias("status")) for n, ok in found))).alias("r")
    return j.select("track", rows).select("track", "r.check", "r.status")
