"""Registered queries of record validation, annotators' scores and the whole gate, with the SQL of the same results.

Records are made from the tables with one flaw each, chosen by the key, so that the problem to be found is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import spelling
from ..operators import gate, numbers, scoring, terms
from ..sources import validation as V
from . import inputs as I, term_queries


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text, k: a project file for each customer; k picks its flaw."""
    c = I.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), (F.col("c_custkey") % 12).alias("k"), F.col("c_name").alias("name"))
    bad = lambda n, wrong, right: F.when(F.col("k") == n, F.lit(wrong)).otherwise(F.lit(right))
    fields = F.struct(
        F.col("name").alias("project_id"), F.lit("T").alias("title"), bad(1, " ", "A").alias("author"), F.lit("B").alias("translator"), bad(2, "poem", "book").alias("genre"), F.lit("all").alias("audience"),
        F.struct(F.lit("plain").alias("voice"), F.when(F.col("k").isin(3, 4), "conversational").otherwise("neutral").alias("formality")).alias("register"), F.struct(bad(5, "some", "none").alias("policy")).alias("cultural_bridge"),
        F.struct(F.lit(True).alias("diacritics"), F.lit("english_only").alias("first_mention")).alias("sanskrit"), F.struct(bad(6, "abc", "0123abc").alias("toolkit_commit"), F.lit("t1").alias("termbase")).alias("versions"),
        F.struct(bad(7, "secret", "public").alias("level"), F.lit(True).alias("independent_review_required"), F.when(F.col("k") == 8, F.lit("x")).alias("owner")).alias("release"),
        F.when(F.col("k").isin(3, 9), "publication_book").when(F.col("k") == 10, "stone").alias("delivery_format"), F.when(F.col("k") == 11, "deny").alias("external_semantic_review"),
    )
    return c.select("path", "k", F.to_json(fields).alias("text"))


def project_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the problem of each project file is, and its policy."""
    d = V.read_projects(_projects(spark, sf_dir))
    return d.select("path", F.split_part("problem", F.lit(":"), F.lit(1)).alias("place"), "source_origin", "delivery_format", "external_semantic_review", "level", "approved")


PROJECT_PROBLEMS_SQL = """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS path, c_custkey % 12 AS k FROM customer)
SELECT path, CASE k WHEN 1 THEN '$.author' WHEN 2 THEN '$.genre' WHEN 3 THEN '$.register.formality' WHEN 5 THEN '$.cultural_bridge.policy' WHEN 6 THEN '$.versions.toolkit_commit' WHEN 7 THEN '$.release.level'
    WHEN 8 THEN '$.release' WHEN 10 THEN '$.delivery_format' END AS place,
  'unknown' AS source_origin, CASE WHEN k IN (3, 9) THEN 'publication_book' WHEN k = 10 THEN 'stone' ELSE 'other' END AS delivery_format, CASE WHEN k = 11 THEN 'deny' ELSE 'allow' END AS external_semantic_review,
  CASE WHEN k = 7 THEN 'secret' ELSE 'public' END AS level, false AS approved FROM c"""


def project_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an annotator sees of each project: no translator, versions or review."""
    return V.shown_project(_projects(spark, sf_dir))


PROJECT_PROJECTION_SQL = """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS path, c_custkey % 12 AS k, c_name AS name FROM customer)
SELECT path, concat('{"audience":"all","author":"', CASE WHEN k = 1 THEN ' ' ELSE 'A' END, '","cultural_bridge":{"policy":"', CASE WHEN k = 5 THEN 'some' ELSE 'none' END, '"}',
  CASE WHEN k IN (3, 9) THEN ',"delivery_format":"publication_book"' WHEN k = 10 THEN ',"delivery_format":"stone"' ELSE '' END, CASE WHEN k = 11 THEN ',"external_semantic_review":"deny"' ELSE '' END,
  ',"genre":"', CASE WHEN k = 2 THEN 'poem' ELSE 'book' END, '","project_id":"', name, '","register":{"formality":"', CASE WHEN k IN (3, 4) THEN 'conversational' ELSE 'neutral' END, '","voice":"plain"},"release":{"level":"',
  CASE WHEN k = 7 THEN 'secret' ELSE 'public' END, '"},"sanskrit":{"diacritics":true,"first_mention":"english_only"},"title":"T"}') AS json FROM c"""


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: an analysis of each document, whose first paragraph is ambiguous where doc_id % 5 is 0."""
    d = I.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("k"))
    digest = lambda c: F.sha2(F.concat(F.lit(c), F.col("path")), 256)
    one = lambda i, status: F.struct(i.alias("paragraph_id"), status.alias("status"))
    first = one(F.when(F.col("k") % 7 == 1, "x1").otherwise("L1"), F.when(F.col("k") % 5 == 0, "needs_human").otherwise("clear"))
    second = one(F.when(F.col("k") % 7 == 2, "L1").otherwise("L3"), F.lit("clear"))
    fields = F.struct(
        F.when(F.col("k") % 7 == 3, " ").otherwise("p").alias("provider"), F.when(F.col("k") % 7 == 4, F.lit("00")).otherwise(digest("s")).alias("source_sha256"), digest("p").alias("project_sha256"), digest("t").alias("term_map_sha256"),
        F.when(F.col("k") % 7 != 5, F.array(first, second)).alias("paragraphs"),
    )
    return d.select("path", "k", F.to_json(fields).alias("text"))


def analysis_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read_analyses(_analyses(spark, sf_dir)).select("path", "problem", F.size("paragraphs").alias("paragraphs"))


ANALYSIS_PROBLEMS_SQL = """SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 7 WHEN 1 THEN 'bad paragraph_id' WHEN 2 THEN 'repeated paragraph_id' WHEN 3 THEN 'no provider' WHEN 4 THEN 'bad digest' WHEN 5 THEN 'no paragraphs' END AS problem,
  CASE WHEN doc_id % 7 = 5 THEN NULL ELSE 2 END AS paragraphs FROM documents"""


def fresh_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of analyses that are sound and of the current source; every third source has changed."""
    a = _analyses(spark, sf_dir)
    digest = lambda c: F.sha2(F.concat(F.lit(c), F.col("path")), 256)
    current = a.select("path", F.when(F.col("k") % 3 == 0, digest("new")).otherwise(digest("s")).alias("source_sha256"), digest("p").alias("project_sha256"), digest("t").alias("term_map_sha256"))
    return V.fresh_paragraphs(V.read_analyses(a), current).select("doc_id", "line_no", "paragraph_id", F.col("analysis.status").alias("status"))


FRESH_PARAGRAPHS_SQL = """WITH d AS (SELECT doc_id AS k, unnest([1, 3]) AS n FROM documents WHERE doc_id % 7 IN (0, 6) AND doc_id % 3 <> 0)
SELECT CAST(k AS VARCHAR) AS doc_id, CAST(n AS INTEGER) AS line_no, 'L' || n AS paragraph_id, CASE WHEN n = 1 AND k % 5 = 0 THEN 'needs_human' ELSE 'clear' END AS status FROM d"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, case_id, track: a case for each nation, in two tracks."""
    n = I.table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("case_id"), F.when(F.col("n_nationkey") % 2 == 0, V.TRACKS[0]).otherwise(V.TRACKS[1]).alias("track"))


def response_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review of all cases by each supplier, with one flaw in its first result or in its list."""
    asked = _cases(spark, sf_dir).where(F.col("track") == V.TRACKS[1]).agg(F.array_sort(F.collect_list(F.struct("ord", "case_id"))).alias("cases"))
    s = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), (F.col("s_suppkey") % 9).alias("k")).join(F.broadcast(asked))  # one row
    k = F.col("k")
    first = lambda i, n, wrong, right: F.when((k == n) & (i == 0), F.lit(wrong)).otherwise(F.lit(right))
    finding = lambda i: F.struct(first(i, 1, "typo", "scope").alias("code"), first(i, 2, "bad", "major").alias("severity"), first(i, 3, "style", "meaning").alias("category"), first(i, 4, "", "m").alias("message"), F.lit("c").alias("constraint"))
    result = lambda c, i: F.struct(F.when((k == 5) & (i == 1), F.get("cases", F.lit(0))["case_id"]).otherwise(c["case_id"]).alias("case_id"), F.array(finding(i)).alias("findings"), F.when((k != 6) | (i > 0), "s").alias("summary"))
    results = F.transform(F.when(k == 7, F.reverse("cases")).when(k == 8, F.slice("cases", 1, 2)).otherwise(F.col("cases")), result)
    found = V.response_problems(s.select("path", F.to_json(F.struct(results.alias("results"))).alias("text")), _cases(spark, sf_dir), V.TRACKS[1])
    return found.select("path", F.split_part("problem", F.lit(":"), F.lit(1)).alias("place"))


RESPONSE_PROBLEMS_SQL = """SELECT CAST(s_suppkey AS VARCHAR) AS path, CASE s_suppkey % 9 WHEN 1 THEN '$.results[0].findings[0].code' WHEN 2 THEN '$.results[0].findings[0].severity' WHEN 3 THEN '$.results[0].findings[0].category'
  WHEN 4 THEN '$.results[0].findings[0].message' WHEN 5 THEN 'repeated case_id' WHEN 6 THEN '$.results[0]' WHEN 7 THEN 'cases or their order differ' WHEN 8 THEN 'cases or their order differ' END AS place FROM supplier"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold case for each supplier."""
    s = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda c, n: F.concat(F.lit(c), (F.col("k") % n).cast("string"))
    role = lambda n: F.struct(name("p", 3).alias("predicate"), name("r", n).alias("role"), name("x", 2).alias("participant"), F.lit("explicit").alias("evidence_status"))
    return s.select(
        "k", F.concat(F.lit("c"), F.col("k").cast("string")).alias("case_id"), F.array(name("p", 3), name("q", 4)).alias("predicates"), F.array(role(5), role(4)).alias("roles"), F.when(F.col("k") % 4 == 0, F.array()).otherwise(F.array(name("l", 6))).cast("array<string>").alias("relations"),
        F.array(name("s", 2)).alias("scopes"), F.array(F.concat_ws(".", name("p", 3), name("r", 5))).alias("ambiguities"), F.array(name("b", 4), name("b", 3)).alias("blocking_codes"), (F.col("k") % 10 == 0).alias("control"),
    )


def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators with three runs over the gold cases; the second reads other relations and leaves cases out."""
    g = _gold(spark, sf_dir)
    who = F.explode(F.array(*(F.struct(F.lit(p).alias("provider"), F.lit(r).alias("run")) for p in ("a", "b") for r in (1, 2, 3)))).alias("w")
    runs = g.select("*", who).select("*", "w.provider", "w.run").where((F.col("provider") == "a") | ((F.col("k") + F.col("run")) % 8 != 0))
    odd = F.col("provider") == "b"
    status = F.when((F.col("k") % 3 == 0) | odd, "explicit").otherwise("ambiguous")
    roles = F.transform("roles", lambda r: F.struct(r["predicate"].alias("predicate"), r["role"].alias("role"), F.when(status == "explicit", r["participant"]).alias("participant"), status.alias("evidence_status")))
    runs = runs.select("provider", "run", "case_id", F.when(odd, F.slice("predicates", 1, 1)).otherwise(F.col("predicates")).alias("predicates"), roles.alias("roles"), F.when(odd, F.array(F.lit("l0"))).otherwise(F.col("relations")).alias("relations"), "scopes")
    return scoring.source_scores(g, runs)


SOURCE_SCORES_SQL = """WITH g AS (SELECT s_suppkey AS k, s_suppkey % 5 = s_suppkey % 4 AS one_role FROM supplier), w AS (SELECT unnest(['a', 'a', 'a', 'b', 'b', 'b']) AS provider, unnest([1, 2, 3, 1, 2, 3]) AS run),
j AS (SELECT g.*, w.*, provider = 'a' OR (k + run) % 8 <> 0 AS there FROM g, w)
SELECT provider, round(avg(CASE WHEN NOT there THEN 0.0 WHEN provider = 'a' THEN 1.0 ELSE 2.0 / 3 END), 6) AS predicate_f1,
  round(avg(CASE WHEN NOT there OR NOT (k % 3 = 0 OR provider = 'b') THEN 0.0 ELSE 1.0 END), 6) AS role_f1,
  round(avg(CASE WHEN NOT there THEN 0.0 WHEN provider = 'a' THEN 1.0 WHEN k % 4 = 0 THEN 0.0 WHEN k % 6 = 0 THEN 1.0 ELSE 0.0 END), 6) AS relation_f1, round(avg(CASE WHEN there THEN 1.0 ELSE 0.0 END), 6) AS scope_f1,
  round(avg(CASE WHEN there AND NOT (k % 3 = 0 OR provider = 'b') THEN 1.0 ELSE 0.0 END), 6) AS ambiguity_preservation_rate
FROM j GROUP BY provider"""


def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviewers with three runs: one names all blocking codes, the other names the first as minor in every second case."""
    g = _gold(spark, sf_dir)
    who = F.explode(F.array(*(F.struct(F.lit(p).alias("provider"), F.lit(r).alias("run")) for p in ("a", "b") for r in (1, 2, 3)))).alias("w")
    runs = g.select("k", "case_id", "blocking_codes", "control", who).select("*", "w.provider", "w.run")
    severity = lambda c: F.when((F.col("provider") == "b") & (F.col("k") % 2 == 0) & (c == F.get("blocking_codes", F.lit(0))), "minor").otherwise("major")
    none = F.array().cast("array<struct<code:string,severity:string>>")
    found = F.when(F.col("control") & ((F.col("provider") == "a") | (F.col("k") % 20 == 0)), none).otherwise(F.transform("blocking_codes", lambda c: F.struct(c.alias("code"), severity(c).alias("severity"))))
    return scoring.review_scores(g.select("case_id", F.when(F.col("control"), F.array().cast("array<string>")).otherwise(F.col("blocking_codes")).alias("blocking_codes"), "control"), runs.select("provider", "run", "case_id", found.alias("findings")))


REVIEW_SCORES_SQL = """WITH g AS (SELECT s_suppkey AS k, s_suppkey % 10 = 0 AS control, CASE WHEN s_suppkey % 10 = 0 THEN 0 WHEN s_suppkey % 4 = s_suppkey % 3 THEN 1 ELSE 2 END AS n FROM supplier), w AS (SELECT unnest(['a', 'b']) AS provider)
SELECT provider, round(sum(CASE WHEN provider = 'b' AND k % 2 = 0 AND n > 0 THEN n - 1 ELSE n END) / sum(n), 6) AS blocking_recall,
  round(count(*) FILTER (control AND provider = 'b' AND k % 20 <> 0) / count(*) FILTER (control), 6) AS control_false_positive_rate FROM g, w GROUP BY provider"""


def full_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of a document in one strict report: structure, numbers and terminology of conversation pairs."""
    d = gate.as_lines(I.pairs(spark, sf_dir))
    t = terms.terminology(d.withColumn("src", F.transform("src", F.lower)), term_queries.policy(spark, sf_dir), strict=True)
    return gate.full_report(d, {"digits": numbers.check_numbers(d), "terminology": t}, strict=True)


def number_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of orders as words and as ordinals, and their prices as decimal words."""
    o = I.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("price"), (F.col("o_orderkey") * F.col("o_custkey") * 100_003 % 10**12).alias("large"))
    return o.select("o_orderkey", spelling.words("large").alias("words"), spelling.ordinal("o_orderkey").alias("ordinal"), spelling.decimal_words("price").alias("price"))


_HUNDRED_SQL = "[" + ", ".join(f"'{w}'" for w in spelling._BELOW_HUNDRED) + "]"
_THREE_SQL = lambda n: f"concat_ws(' ', CASE WHEN {n} >= 100 THEN w[{n} // 100 + 1] || ' hundred' END, CASE WHEN {n} % 100 > 0 THEN w[{n} % 100 + 1] END)"
_WORDS_SQL = lambda n: f"""CASE WHEN {n} = 0 THEN w[1] ELSE concat_ws(' ', nullif(concat_ws(' ', nullif({_THREE_SQL(f"({n} // 1000000000)")}, '') || ' thousand', nullif({_THREE_SQL(f"({n} // 1000000 % 1000)")}, '')), '') || ' million',
  nullif({_THREE_SQL(f"({n} // 1000 % 1000)")}, '') || ' thousand', nullif({_THREE_SQL(f"({n} % 1000)")}, '')) END"""  # noqa: E731
NUMBER_SPELLING_SQL = f"""WITH o AS (SELECT o_orderkey, o_orderkey * o_custkey * 100003 % 1000000000000 AS n, CAST(o_totalprice AS DECIMAL(15,2)) AS price, {_HUNDRED_SQL} AS w FROM orders),
p AS (SELECT *, CAST(floor(price) AS BIGINT) AS whole, rtrim(string_split(CAST(price AS VARCHAR), '.')[2], '0') AS tail FROM o)
SELECT o_orderkey, {_WORDS_SQL("n")} AS words, o_orderkey || CASE WHEN o_orderkey % 100 IN (11, 12, 13) THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
  {_WORDS_SQL("whole")} || CASE WHEN tail = '' THEN '' ELSE ' point ' || array_to_string(list_transform(string_split(tail, ''), lambda d: w[CAST(d AS INTEGER) + 1]), ' ') END AS price FROM p"""


QUERIES = {n: globals()[n] for n in ("project_problems", "project_projection", "analysis_problems", "fresh_paragraphs", "response_problems", "source_scores", "review_scores", "full_gate", "number_spelling")}
SQL = {n: globals()[n.upper() + "_SQL"] for n in QUERIES if n.upper() + "_SQL" in globals()}
