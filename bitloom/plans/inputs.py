"""Derived inputs over the given tables, each as a DataFrame and as DuckDB SQL of the same rows.

The tables hold no Chinese text, headings or comment marks, so checks on these need inputs in which
they occur: ``marked`` puts marks into every line of every document by a fixed rule on its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import split_lines

SQL_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(column: str) -> Column:
    """Milliseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def sql_lines(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(regexp_replace({text}, '({SQL_END})$', ''), '{SQL_END}') END"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, target: each user turn and the assistant turn after it in its conversation."""
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return user.join(reply, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "source", "target")


PAIRS_SQL = """pairs AS (
  SELECT u.conv_id || ':' || u.turn AS doc_id, u.text AS source, a.text AS target
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def mark(line: Column, number: Column) -> Column:
    r = F.pmod(number, F.lit(11))
    return (
        F.when(r == 0, F.concat(F.lit("## "), line)).when(r == 1, F.concat(F.lit("- 1. "), line)).when(r == 2, F.concat(line, F.lit("空性")))
        .when(r == 3, F.concat(line, F.lit("，"))).when(r == 4, F.concat(F.lit("**"), line, F.lit("**"))).when(r == 5, F.concat(F.lit("{% "), line))
        .when(r == 6, F.concat(line, F.lit(" %}"))).when(r == 7, F.lit("")).otherwise(line)
    )


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, src, tgt: arrays of lines. Every seventh document's target marks move by a line, and every fifth loses its last."""
    d = table(spark, sf_dir, "documents").select("doc_id", split_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    src = F.transform("lines", lambda x, i: mark(x, F.col("doc_id") + i + 1))
    tgt = F.transform("lines", lambda x, i: mark(x, F.col("doc_id") + i + 1 + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)))
    d = d.select("doc_id", src.alias("src"), tgt.alias("tgt"))
    return d.withColumn("tgt", F.when(F.col("doc_id") % 5 == 0, F.slice("tgt", 1, F.greatest(F.size("tgt") - 1, F.lit(0)))).otherwise(F.col("tgt")))


def _sql_mark(number: str) -> str:
    return f"""CASE ({number}) % 11 WHEN 0 THEN '## ' || x WHEN 1 THEN '- 1. ' || x WHEN 2 THEN x || '空性' WHEN 3 THEN x || '，'
      WHEN 4 THEN '**' || x || '**' WHEN 5 THEN '{{% ' || x WHEN 6 THEN x || ' %}}' WHEN 7 THEN '' ELSE x END"""


MARKED_SQL = f"""base AS (
  SELECT doc_id, {sql_lines("coalesce(text, '')")} AS l FROM documents
), flat AS (
  SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS n, len(l) AS total FROM base
), marked AS (
  SELECT doc_id, n, {_sql_mark("doc_id + n")} AS src,
    CASE WHEN doc_id % 5 = 0 AND n = total THEN NULL ELSE {_sql_mark("doc_id + n + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END")} END AS tgt
  FROM flat)"""


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, zh, en, loc, source from the parts: names are terms, types are renderings, brands are places and sources."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("zh"), F.col("p_type").alias("en"), F.col("p_brand").alias("loc"), F.col("p_brand").alias("source"))


GLOSSARY_SQL = "glossary AS (SELECT p_partkey AS row_id, p_name AS zh, p_type AS en, p_brand AS loc, p_brand AS source FROM part)"


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, cue, start_ms, end_ms, text: a user's events are the cues of a track, at most nine seconds each."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", epoch_ms("ts").alias("ms"), "event_type")
    w = Window.partitionBy("user_id").orderBy("ms", "event_id")
    begin = F.first("ms").over(w)
    d = e.select("user_id", F.row_number().over(w).alias("cue"), (F.col("ms") - begin).alias("start_ms"), F.lead("ms").over(w).alias("next"), begin.alias("b"), "event_type", "event_id")
    end = F.least(F.coalesce(F.col("next") - F.col("b"), F.col("start_ms") + 2000), F.col("start_ms") + 9000)
    text = F.concat_ws(" ", "event_type", F.repeat(F.lit("word "), (F.col("event_id") % 23).cast("int")))
    return d.select(F.col("user_id").alias("track"), "cue", "start_ms", end.alias("end_ms"), text.alias("text"))


CUES_SQL = """ev AS (
  SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, event_type FROM events
), seq AS (
  SELECT *, row_number() OVER w AS cue, first_value(ms) OVER w AS b, lead(ms) OVER w AS next FROM ev
  WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)
), cues AS (
  SELECT user_id AS track, cue, ms - b AS start_ms,
    least(coalesce(next - b, ms - b + 2000), ms - b + 9000) AS end_ms,
    event_type || ' ' || repeat('word ', CAST(event_id % 23 AS INTEGER)) AS text
  FROM seq)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, ord, finding_id, severity, status, round from the events, in order of event_id."""
    e = table(spark, sf_dir, "events")
    severity = F.element_at(F.array(*map(F.lit, ("critical", "major", "minor", "discussion"))), (F.length("event_type") % 4 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("open", "resolved", "rejected", "deferred", "resolved"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select((F.col("user_id") % 97).alias("project"), F.col("event_id").alias("ord"), F.concat(F.lit("R-"), F.col("event_id").cast("string")).alias("finding_id"), severity.alias("severity"), status.alias("status"), (F.col("event_id") % 3 + 1).cast("int").alias("round"))


FINDINGS_SQL = """findings AS (
  SELECT user_id % 97 AS project, event_id AS ord, 'R-' || event_id AS finding_id,
    ['critical','major','minor','discussion'][CAST(length(event_type) % 4 + 1 AS INTEGER)] AS severity,
    ['open','resolved','rejected','deferred','resolved'][CAST(event_id % 5 + 1 AS INTEGER)] AS status,
    CAST(event_id % 3 + 1 AS INTEGER) AS round
  FROM events)"""
