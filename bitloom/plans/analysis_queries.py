"""Registered queries of number fidelity and semantic analyses, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import json_schema
from ..functions import text as X
from ..operators import analysis, cleanup, numbers
from ..sources import schemas as S
from . import inputs as I

_LINES_SQL = f"l0 AS (SELECT doc_id, {I.sql_lines("coalesce(text, '')")} AS l FROM documents), l1 AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS line_no FROM l0), lines AS (SELECT *, doc_id + line_no AS k FROM l1 WHERE NOT regexp_full_match(text, '\\s*'))"


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, paragraph_id, text, source, k, analysis: an analysis of each non-blank line, flawed by fixed rules on k = doc_id + line_no."""
    d = I.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("source"))
    d = d.select("doc_id", "source", F.posexplode(X.split_lines("source")).alias("i", "text")).where(~X.is_blank("text"))
    d = d.withColumn("line_no", F.col("i") + 1).withColumn("k", F.col("doc_id") + F.col("line_no"))
    every = lambda n: F.col("k") % n == 0
    t = F.col("text")
    state = lambda n: F.when(every(n), F.lit("ambiguous")).otherwise(F.lit("inferred"))
    none = F.lit(None).cast("string")

    def items(kind, **values: Column) -> Column:
        return F.array(F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields)))

    role = items(S.PARTICIPANT, role=F.lit("agent"), participant=F.when(~every(4), F.substring(t, 1, 3)), evidence=F.substring(t, 1, 5), evidence_status=F.when(every(3), F.lit("ambiguous")).otherwise(F.lit("explicit")))
    parts = {
        "paragraph_id": F.concat(F.lit("L"), F.col("line_no").cast("string")),
        "predicates": items(S.PREDICATE, predicate=F.lit("p"), evidence=F.when(every(6), F.lit("###")).otherwise(F.substring(t, 1, 5)), participants=role),
        "relations": items(S.RELATION, evidence=none, evidence_status=state(10)),
        "operators": items(S.OPERATOR, evidence=none, evidence_status=state(13)),
        "references_and_ellipsis": items(S.REFERENCE, evidence=none, evidence_status=state(17)),
        "competing_interpretations": F.when(every(7), items(S.INTERPRETATION, interpretation=F.lit("x"), evidence=F.array(F.substring(F.col("source"), 1, 4)))).otherwise(F.array().cast(S.T.ArrayType(S.INTERPRETATION))),
        "must_preserve": F.array(F.when(every(9), F.lit("english only")).otherwise(F.lit("保持原意"))),
        "must_not_invent": F.array().cast("array<string>"),
        "status": F.when(every(5), F.lit("needs_human")).otherwise(F.lit("clear")),
    }
    struct = F.struct(*(parts[f.name].cast(f.dataType).alias(f.name) for f in S.PARAGRAPH.fields))
    return d.select("doc_id", "line_no", parts["paragraph_id"].alias("paragraph_id"), "text", "source", "k", struct.alias("analysis"))


def risk_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs to escalate, with the first line of every document escalated by hand."""
    a = analysed(spark, sf_dir)
    manual = a.groupBy("doc_id").agg(F.min("line_no").alias("n")).select("doc_id", F.concat(F.lit("L"), F.col("n").cast("string")).alias("paragraph_id"))
    return analysis.select_focus(a, manual).select("doc_id", "paragraph_id", F.array_join("reasons", ",").alias("reasons"))


RISK_FOCUS_SQL = rf"""WITH {_LINES_SQL}, m AS (SELECT doc_id, min(line_no) AS first FROM lines GROUP BY doc_id), r AS (
  SELECT doc_id, 'L' || line_no AS paragraph_id, array_to_string(list_filter([
    CASE WHEN k % 5 = 0 THEN 'needs_human' END, CASE WHEN k % 7 = 0 THEN 'competing_interpretations' END, CASE WHEN k % 3 = 0 THEN 'ambiguous_semantic_role' END, CASE WHEN k % 10 = 0 THEN 'ambiguous_relation' END,
    CASE WHEN k % 13 = 0 THEN 'ambiguous_scope' END, CASE WHEN k % 17 = 0 THEN 'ambiguous_reference_or_ellipsis' END, CASE WHEN line_no = first THEN 'manual_escalation' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM lines JOIN m USING (doc_id))
SELECT * FROM r WHERE reasons <> ''"""


def evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysed(spark, sf_dir)
    p = analysis.evidence_problems(F.col("text"), F.col("source"))
    return a.select("doc_id", "paragraph_id", F.array_join(p, ",").alias("problems")).where("problems <> ''")


EVIDENCE_RULES_SQL = rf"""WITH {_LINES_SQL}, r AS (SELECT doc_id, 'L' || line_no AS paragraph_id, array_to_string(list_filter([
    CASE WHEN k % 6 = 0 AND NOT contains(text, '###') THEN 'predicate evidence' END, CASE WHEN k % 3 <> 0 AND k % 4 = 0 THEN 'role evidence' END, CASE WHEN k % 9 = 0 THEN 'constraint language' END,
    CASE WHEN k % 5 <> 0 AND (k % 7 = 0 OR k % 3 = 0 OR k % 10 = 0 OR k % 13 = 0 OR k % 17 = 0) THEN 'ambiguity without needs_human' END], lambda x: x IS NOT NULL), ',') AS problems FROM lines)
SELECT * FROM r WHERE problems <> ''"""


def id_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines asked for against lines answered, where every eleventh is left out and every fourth answered twice."""
    a = cleanup.explode_lines(I.table(spark, sf_dir, "documents")).where(~X.is_blank("text"))
    k = F.col("doc_id") + F.col("line_no")
    told = F.array_sort(F.collect_list(F.struct("line_no", k.alias("k"))))
    ids = a.groupBy("doc_id").agg(told.alias("t"))
    name = lambda x: F.concat(F.lit("L"), x["line_no"].cast("string"))
    want = F.transform("t", name)
    got = F.flatten(F.transform(F.filter("t", lambda x: x["k"] % 11 != 0), lambda x: F.when(x["k"] % 4 == 0, F.array(name(x), name(x))).otherwise(F.array(name(x)))))
    c = ids.select("doc_id", analysis.coverage(want, got).alias("c"))
    return c.select("doc_id", F.array_join("c.missing", ",").alias("missing"), F.array_join("c.unknown", ",").alias("unknown"), "c.repeated", "c.ordered")


ID_COVERAGE_SQL = rf"""WITH {_LINES_SQL}
SELECT doc_id, coalesce(string_agg('L' || line_no, ',' ORDER BY line_no) FILTER (k % 11 = 0), '') AS missing, '' AS unknown, count(*) FILTER (k % 11 <> 0 AND k % 4 = 0) > 0 AS repeated,
  count(*) FILTER (k % 11 = 0 OR k % 4 = 0) = 0 AS ordered FROM lines GROUP BY doc_id"""


#: Source and target by kind of line: equal, another number, a unit, no source number, an approximation without its word, a date, an ordinal.
_NUMBER_KINDS = {
    0: ("concat('共有 ', n, ' 人')", "concat('there were ', n, ' people')"),
    1: ("concat('共有 ', n, ' 人')", "concat('there were ', m, ' people')"),
    2: ("concat('约 ', n, ' 万元')", "concat('about ', n, '0,000 yuan')"),
    3: ("'没有数字'", "concat('note ', n, ' here')"),
    4: ("concat(n, '多万人')", "concat(n, '0000 people')"),
    5: ("concat('2024年8月', d, '日')", "concat('August ', d, ', 2024')"),
    6: ("concat('排在第', d, '位')", "concat('ranked ', d, CASE WHEN d IN (1, 21, 31) THEN 'st' WHEN d IN (2, 22) THEN 'nd' WHEN d IN (3, 23) THEN 'rd' ELSE 'th' END)"),
}


def _number_line(side: int, kind: str) -> str:
    """An expression that both engines read."""
    cases = " ".join(f"WHEN {k} THEN {v[side]}" for k, v in _NUMBER_KINDS.items())
    return f"CASE {kind} {cases} END"


def number_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines for each part, whose kinds and numbers come from its key."""
    d = I.table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", "p_partkey % 7 AS a", "(p_partkey + 1 + p_partkey % 3) % 7 AS b", "p_partkey % 900 + 101 AS n", "p_partkey % 900 + 102 AS m", "p_partkey % 31 + 1 AS d")
    d = d.select("doc_id", F.array(F.expr(_number_line(0, "a")), F.expr(_number_line(0, "b"))).alias("src"), F.array(F.expr(_number_line(1, "a")), F.expr(_number_line(1, "b"))).alias("tgt"))
    return numbers.check_numbers(d)


def _number_labels(values: dict[int, str]) -> str:
    """Labels of both lines, comma-joined, by kind of line."""
    line = lambda i, kind: f"CASE {kind} " + " ".join(f"WHEN {k} THEN concat('L{i}:', {v})" for k, v in values.items()) + " END"
    return f"coalesce(concat_ws(',', {line(1, 'a')}, {line(2, 'b')}), '')"


NUMBER_FIDELITY_SQL = f"""WITH d AS (SELECT p_partkey AS doc_id, p_partkey % 7 AS a, (p_partkey + 1 + p_partkey % 3) % 7 AS b, p_partkey % 900 + 101 AS n, p_partkey % 900 + 102 AS m FROM part)
SELECT doc_id, CASE WHEN a IN (1, 4) OR b IN (1, 4) THEN 'FAIL' WHEN a = 3 OR b = 3 THEN 'WARN' ELSE 'PASS' END AS status,
  {_number_labels({1: "n", 4: "n, '多万'"})} AS missing, {_number_labels({1: "m", 3: "n", 4: "n, '0000'"})} AS extra FROM d"""


EVENT_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 90}}, "additionalProperties": False}
EVENT_SCHEMA_SQL = "SELECT CASE WHEN CAST(props ->> 'k' AS BIGINT) > 90 THEN '$.k: out of range' ELSE 'none' END AS problem, count(*) AS n FROM events GROUP BY 1"


def event_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of all events against a schema; problems counted by text."""
    e = I.table(spark, sf_dir, "events").select("event_id", "props")
    return json_schema.validate(e, "props", EVENT_SCHEMA).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


#: A conversation as one nested text: turns in order, each with a role and a text of some length.
_TURN = {"type": "object", "additionalProperties": False, "required": ["role", "text"], "properties": {"turn": {"type": "integer", "minimum": 0}, "role": {"enum": ["user", "assistant"]}, "text": {"type": "string", "minLength": 40, "maxLength": 500}}}
NESTED_SCHEMA = {
    "type": "object", "required": ["id", "turns"], "properties": {"id": {"$ref": "#/$defs/id"}, "turns": {"type": "array", "minItems": 2, "maxItems": 8, "items": _TURN}},
    "if": {"properties": {"id": {"maximum": 20}}}, "then": {"properties": {"turns": {"maxItems": 3}}}, "$defs": {"id": {"type": "integer", "not": {"const": 7}}},
}
NESTED_SCHEMA_SQL = """WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), e AS (
  SELECT conv_id, count(*) AS n, arg_min(CASE
    WHEN role IS NULL THEN '$.turns[' || i || ']: lacks role' WHEN text IS NULL THEN '$.turns[' || i || ']: lacks text' WHEN role NOT IN ('user', 'assistant') THEN '$.turns[' || i || '].role: not one of the allowed values'
    WHEN length(text) < 40 THEN '$.turns[' || i || '].text: too short' WHEN length(text) > 500 THEN '$.turns[' || i || '].text: too long' WHEN turn < 0 THEN '$.turns[' || i || '].turn: out of range' END, i)
    FILTER (role IS NULL OR text IS NULL OR role NOT IN ('user', 'assistant') OR length(text) NOT BETWEEN 40 AND 500 OR turn < 0) AS first FROM t GROUP BY conv_id
)
SELECT conv_id, CASE WHEN conv_id <= 20 AND n > 3 THEN '$.turns: too many items' WHEN conv_id = 7 THEN '$.id: fits what it must not' WHEN n < 2 THEN '$.turns: too few items' WHEN n > 8 THEN '$.turns: too many items'
  ELSE first END AS problem FROM e"""


def nested_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation, written as one JSON text, against a nested schema."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = I.table(spark, sf_dir, "conversations").where("conv_id is not null").groupBy("conv_id").agg(turns.alias("turns"))
    texts = c.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("id"), "turns")).alias("json"))
    return json_schema.validate(texts, "json", NESTED_SCHEMA).select("conv_id", "problem")


QUERIES = {n: globals()[n] for n in ("risk_focus", "evidence_rules", "id_coverage", "number_fidelity", "event_schema", "nested_schema")}
SQL = {"risk_focus": RISK_FOCUS_SQL, "evidence_rules": EVIDENCE_RULES_SQL, "id_coverage": ID_COVERAGE_SQL, "number_fidelity": NUMBER_FIDELITY_SQL, "event_schema": EVENT_SCHEMA_SQL, "nested_schema": NESTED_SCHEMA_SQL}
