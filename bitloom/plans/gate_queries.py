"""Registered queries of the gate, alignment and line clean-up, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import alignment, gate
from . import inputs as I


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.table(spark, sf_dir, "documents").select("doc_id", "text", X.split_lines(F.coalesce("text", F.lit(""))).alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(F.filter("l", lambda x: ~X.is_blank(x))).cast("long").alias("n_nonblank"), X.paragraph_count(F.col("l")).cast("long").alias("n_paragraphs"), X.sha256_hex(F.coalesce("text", F.lit(""))).alias("sha256"))


DOCUMENT_LINES_SQL = f"""WITH base AS (SELECT doc_id, coalesce(text, '') AS t, {I.sql_lines("coalesce(text, '')")} AS l FROM documents)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(list_filter(l, lambda x: NOT regexp_full_match(x, '\\s*'))) AS BIGINT) AS n_nonblank,
  CAST(len(list_filter(range(1, len(l) + 1), lambda i: NOT regexp_full_match(l[i], '\\s*') AND (i = 1 OR regexp_full_match(l[i - 1], '\\s*')))) AS BIGINT) AS n_paragraphs,
  sha256(t) AS sha256
FROM base"""


def structure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.structure_checks(I.marked(spark, sf_dir)).select("doc_id", "check_no", "check", "issues", "status")


_SQL_CLEAN = r"regexp_replace(regexp_replace(tgt, '\{#[^{}\n]*\}', '', 'g'), '(\])\([^()\n]*\)', '\1', 'g')"
_SQL_TITLE = r"trim(regexp_replace(regexp_replace(regexp_replace({c}, '^\s*(?:#{{1,6}}\s+|-\s+)', ''), '(?i)^(?:[一二三四五六七八九十百]+[、．.]|\d+[．.]|[IVXLCDM]+[.)])\s*', ''), '\s+', ' ', 'g'))"


def _sql_depth(side: str) -> str:
    return f"""{side}_tokens AS (
  SELECT doc_id, n, unnest(regexp_extract_all({side}, '\\{{%|%\\}}')) AS t, generate_subscripts(regexp_extract_all({side}, '\\{{%|%\\}}'), 1) AS k FROM marked WHERE {side} IS NOT NULL
), {side}_sums AS (
  SELECT doc_id, n, k, sum(CASE WHEN t = '{{%' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY n, k ROWS UNBOUNDED PRECEDING) AS s FROM {side}_tokens
), {side}_broken AS (
  SELECT doc_id, arg_max(s, (n, k)) - least(0, min(s)) - least(0, min(s)) AS broken FROM {side}_sums GROUP BY doc_id
)"""


STRUCTURE_CTE = rf"""{I.MARKED_SQL}, {_sql_depth("src")}, {_sql_depth("tgt")}, lines AS (
  SELECT *, regexp_full_match(src, '\s*') AS sb, regexp_full_match(tgt, '\s*') AS tb,
    lag(src) OVER w AS ps, lag(tgt) OVER w AS pt, n = 1 AS top
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), per AS (
  SELECT doc_id, count(src) AS sl, count(tgt) AS tl,
    count(*) FILTER (NOT sb) AS sn, count(*) FILTER (tgt IS NOT NULL AND NOT tb) AS tn,
    count(*) FILTER (tgt IS NOT NULL AND sb <> tb) AS blanks,
    count(*) FILTER (NOT sb AND (top OR regexp_full_match(ps, '\s*'))) AS sp,
    count(*) FILTER (tgt IS NOT NULL AND NOT tb AND (top OR regexp_full_match(pt, '\s*'))) AS tp,
    count(*) FILTER (tgt IS NULL OR length(regexp_extract(src, '^(#{{1,6}})(?:\s|$)', 1)) <> length(regexp_extract(tgt, '^(#{{1,6}})(?:\s|$)', 1))) AS heads,
    count(*) FILTER (tgt IS NOT NULL AND len(regexp_extract_all(tgt, '\*[^*\n]+\*')) < len(regexp_extract_all(src, '\*[^*\n]+\*'))) AS emph,
    count(*) FILTER (tgt IS NULL OR regexp_extract_all(src, '\{{%|%\}}') <> regexp_extract_all(tgt, '\{{%|%\}}')) AS comm,
    count(*) FILTER (tgt IS NOT NULL AND regexp_matches({_SQL_CLEAN}, '[\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{20000}}-\x{{2FFFF}}\x{{30000}}-\x{{323AF}}]')) AS cjk,
    count(*) FILTER (tgt IS NOT NULL AND regexp_matches({_SQL_CLEAN}, '[，。、；：？！《》【】（）]')) AS punct,
    count(*) FILTER (tgt IS NOT NULL AND contains(tgt, '**')) AS bold
  FROM lines GROUP BY doc_id
), titles AS (
  SELECT doc_id, {_SQL_TITLE.format(c="src")} AS title, {_SQL_TITLE.format(c="tgt")} AS r
  FROM marked WHERE tgt IS NOT NULL AND (regexp_matches(src, '^#{{1,6}}(?:\s|$)') OR regexp_matches(src, '^\s*(?:#{{1,6}}\s+|-\s+)'))
), repeats AS (
  SELECT doc_id, count(*) FILTER (k > 1) AS bad FROM (
    SELECT doc_id, title, count(DISTINCT r) AS k FROM titles WHERE title <> '' GROUP BY doc_id, title HAVING count(*) >= 2) GROUP BY doc_id
), c AS (
  SELECT b.doc_id, coalesce(p.sl, 0) AS sl, coalesce(p.tl, 0) AS tl, coalesce(sn, 0) AS sn, coalesce(tn, 0) AS tn, coalesce(blanks, 0) AS blanks, coalesce(sp, 0) AS sp, coalesce(tp, 0) AS tp,
    coalesce(heads, 0) AS heads, coalesce(emph, 0) AS emph, coalesce(comm, 0) AS comm, coalesce(cjk, 0) AS cjk, coalesce(punct, 0) AS punct, coalesce(bold, 0) AS bold,
    coalesce(r.bad, 0) AS bad, coalesce(s.broken, 0) + coalesce(t.broken, 0) AS broken
  FROM base b LEFT JOIN per p USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN src_broken s USING (doc_id) LEFT JOIN tgt_broken t USING (doc_id)
), u AS (
  SELECT doc_id, unnest([
    {{'check_no': 1, 'check': 'non_empty', 'issues': CASE WHEN sn > 0 AND tn > 0 THEN 0 ELSE 1 END}},
    {{'check_no': 2, 'check': 'line_count', 'issues': abs(sl - tl)}},
    {{'check_no': 3, 'check': 'blank_alignment', 'issues': CASE WHEN sl = tl THEN blanks ELSE abs(sl - tl) END}},
    {{'check_no': 4, 'check': 'paragraphs', 'issues': abs(sp - tp)}},
    {{'check_no': 5, 'check': 'headings', 'issues': heads}},
    {{'check_no': 6, 'check': 'repeated_titles', 'issues': CASE WHEN sl = tl THEN bad ELSE 1 END}},
    {{'check_no': 7, 'check': 'emphasis', 'issues': emph}},
    {{'check_no': 8, 'check': 'comments', 'issues': CASE WHEN broken > 0 THEN broken ELSE comm END}},
    {{'check_no': 9, 'check': 'cjk_leakage', 'issues': cjk}},
    {{'check_no': 10, 'check': 'punctuation_leakage', 'issues': punct}},
    {{'check_no': 11, 'check': 'bold_leakage', 'issues': bold}}]) AS r FROM c
), checks AS (
  SELECT doc_id, CAST(r.check_no AS INTEGER) AS check_no, r."check" AS "check", CAST(r.issues AS BIGINT) AS issues, CASE WHEN r.issues = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM u
)"""
STRUCTURE_SQL = f"WITH {STRUCTURE_CTE} SELECT * FROM checks"


def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = gate.structure_report(I.marked(spark, sf_dir))
    return r.select("doc_id", *gate.summary(F.col("checks")))


GATE_REPORT_SQL = f"""WITH {STRUCTURE_CTE}
SELECT doc_id, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS overall,
  coalesce(string_agg("check", ',' ORDER BY check_no) FILTER (status = 'PASS'), '') AS passed, '' AS warned, '' AS skipped,
  coalesce(string_agg("check", ',' ORDER BY check_no) FILTER (status = 'FAIL'), '') AS failed
FROM checks GROUP BY doc_id"""


def pair_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = gate.structure_counts(gate.as_lines(I.pairs(spark, sf_dir)))
    return c.select("doc_id", F.col("src_lines").cast("long"), F.col("tgt_lines").cast("long"), "src_nonblank", "tgt_nonblank", F.col("src_paragraphs").cast("long"), F.col("tgt_paragraphs").cast("long"), F.col("blank_alignment").alias("blank_mismatches"))


PAIR_GATE_SQL = rf"""WITH {I.PAIRS_SQL}, l AS (
  SELECT doc_id, {I.sql_lines("source")} AS s, {I.sql_lines("target")} AS t FROM pairs)
SELECT doc_id, CAST(len(s) AS BIGINT) AS src_lines, CAST(len(t) AS BIGINT) AS tgt_lines,
  CAST(len(list_filter(s, lambda x: NOT regexp_full_match(x, '\s*'))) AS BIGINT) AS src_nonblank,
  CAST(len(list_filter(t, lambda x: NOT regexp_full_match(x, '\s*'))) AS BIGINT) AS tgt_nonblank,
  CAST(len(list_filter(range(1, len(s) + 1), lambda i: NOT regexp_full_match(s[i], '\s*') AND (i = 1 OR regexp_full_match(s[i - 1], '\s*')))) AS BIGINT) AS src_paragraphs,
  CAST(len(list_filter(range(1, len(t) + 1), lambda i: NOT regexp_full_match(t[i], '\s*') AND (i = 1 OR regexp_full_match(t[i - 1], '\s*')))) AS BIGINT) AS tgt_paragraphs,
  CAST(len(list_filter(range(1, least(len(s), len(t)) + 1), lambda i: regexp_full_match(s[i], '\s*') <> regexp_full_match(t[i], '\s*'))) AS BIGINT) AS blank_mismatches
FROM l"""


def mismatched_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda c: F.when(F.col(c).isNotNull(), X.heading_level(c))
    return gate.mismatched_lines(I.marked(spark, sf_dir), ~level("src").eqNullSafe(level("tgt")))


MISMATCHED_HEADINGS_SQL = rf"""WITH {I.MARKED_SQL}, h AS (
  SELECT doc_id, n FROM marked WHERE tgt IS NULL OR length(regexp_extract(src, '^(#{{1,6}})(?:\s|$)', 1)) <> length(regexp_extract(tgt, '^(#{{1,6}})(?:\s|$)', 1)))
SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(n))[1:10], ',') AS lines FROM h GROUP BY doc_id"""


# --- alignment ------------------------------------------------------------------------------


def bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = alignment.equal_lines(gate.as_lines(I.pairs(spark, sf_dir)))
    rows = alignment.interleave(d)
    return rows.select("doc_id", "line_no", "ord", "text")


BILINGUAL_CTE = rf"""{I.PAIRS_SQL}, l AS (
  SELECT doc_id, {I.sql_lines("source")} AS s, {I.sql_lines("target")} AS t FROM pairs
), ok AS (
  SELECT * FROM l WHERE len(s) = len(t) AND len(list_filter(range(1, len(s) + 1), lambda i: regexp_full_match(s[i], '\s*') <> regexp_full_match(t[i], '\s*'))) = 0
), e AS (
  SELECT doc_id, unnest(s) AS src, unnest(t) AS tgt, generate_subscripts(s, 1) AS line_no FROM ok
), rows_ AS (
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(unnest(CASE WHEN regexp_full_match(src, '\s*') THEN [1] ELSE [1, 2, 3] END) AS INTEGER) AS ord,
    unnest(CASE WHEN regexp_full_match(src, '\s*') THEN [''] ELSE [src, tgt, ''] END) AS text FROM e)"""
BILINGUAL_SQL = f"WITH {BILINGUAL_CTE} SELECT * FROM rows_"


def bilingual_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleave and split again: the result is the two sides' lines once more."""
    d = alignment.equal_lines(gate.as_lines(I.pairs(spark, sf_dir)))
    back = alignment.split_bilingual(alignment.bilingual_lines(d))
    return back.select("doc_id", F.array_join("src", "\n").alias("source"), F.array_join("tgt", "\n").alias("target"), F.size("src").cast("long").alias("n_lines"))


BILINGUAL_SPLIT_SQL = f"""WITH {BILINGUAL_CTE}
SELECT doc_id, array_to_string(list_transform(s, lambda x: CASE WHEN regexp_full_match(x, '\\s*') THEN '' ELSE x END), chr(10)) AS source,
  array_to_string(list_transform(t, lambda x: CASE WHEN regexp_full_match(x, '\\s*') THEN '' ELSE x END), chr(10)) AS target, CAST(len(s) AS BIGINT) AS n_lines FROM ok"""


def bilingual_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a bilingual file = 2 * non-blank lines + all lines."""
    d = alignment.equal_lines(gate.as_lines(I.pairs(spark, sf_dir)))
    n = F.size(F.filter("src", lambda x: ~X.is_blank(x))).cast("long")
    rows = alignment.bilingual_lines(d)
    return rows.select("doc_id", F.size("lines").cast("long").alias("bilingual_lines"), (2 * n + F.size("src")).cast("long").alias("expected_lines"))


BILINGUAL_IDENTITY_SQL = f"WITH {BILINGUAL_CTE}, k AS (SELECT doc_id, count(*) AS bilingual_lines FROM rows_ GROUP BY doc_id) SELECT doc_id, coalesce(bilingual_lines, 0) AS bilingual_lines, CAST(2 * len(list_filter(s, lambda x: NOT regexp_full_match(x, '\\s*'))) + len(s) AS BIGINT) AS expected_lines FROM ok LEFT JOIN k USING (doc_id)"


def bilingual_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bilingual file against its sources; those with ids of even length were made from another text."""
    d = alignment.equal_lines(gate.as_lines(I.pairs(spark, sf_dir)))
    stale = F.length("doc_id") % 2 == 0
    kept = alignment.bilingual_lines(d).withColumn("lines", F.when(stale, F.transform("lines", lambda x: F.regexp_replace(x, "e", "E"))).otherwise(F.col("lines")))
    return alignment.freshness(kept).select("doc_id", "status", F.col("differences").cast("long"))


BILINGUAL_FRESHNESS_SQL = f"""WITH {BILINGUAL_CTE}, k AS (SELECT doc_id, count(*) FILTER (contains(text, 'e')) AS n FROM rows_ GROUP BY doc_id), r AS (
  SELECT doc_id, CASE WHEN length(doc_id) % 2 = 0 THEN coalesce(n, 0) ELSE 0 END AS differences FROM ok LEFT JOIN k USING (doc_id))
SELECT doc_id, CASE WHEN differences = 0 THEN 'PASS' ELSE 'FAIL' END AS status, differences FROM r"""


def freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.freeze_target(gate.as_lines(I.pairs(spark, sf_dir))).select("doc_id", "accepted", "reason")


FREEZE_SQL = rf"""WITH {I.PAIRS_SQL}, l AS (SELECT doc_id, {I.sql_lines("source")} AS s, {I.sql_lines("target")} AS t FROM pairs), r AS (
  SELECT doc_id, CASE WHEN len(s) <> len(t) THEN 'line count'
    WHEN len(list_filter(range(1, len(s) + 1), lambda i: regexp_full_match(s[i], '\s*') <> regexp_full_match(t[i], '\s*'))) > 0 THEN 'blank lines' ELSE '' END AS reason FROM l)
SELECT doc_id, reason = '' AS accepted, reason FROM r"""


QUERIES = {
    "document_lines": document_lines, "structure_gate": structure_gate, "gate_report": gate_report, "pair_gate": pair_gate, "mismatched_headings": mismatched_headings,
    "bilingual": bilingual, "bilingual_split": bilingual_split, "bilingual_identity": bilingual_identity, "bilingual_freshness": bilingual_freshness, "freeze_target": freeze,
}
SQL = {
    "document_lines": DOCUMENT_LINES_SQL, "structure_gate": STRUCTURE_SQL, "gate_report": GATE_REPORT_SQL, "pair_gate": PAIR_GATE_SQL, "mismatched_headings": MISMATCHED_HEADINGS_SQL,
    "bilingual": BILINGUAL_SQL, "bilingual_split": BILINGUAL_SPLIT_SQL, "bilingual_identity": BILINGUAL_IDENTITY_SQL, "bilingual_freshness": BILINGUAL_FRESHNESS_SQL, "freeze_target": FREEZE_SQL,
}
