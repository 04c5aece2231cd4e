"""Projects, source analyses, gold cases, saved runs and annotators' responses: JSON texts with the first problem of each.

Shapes are JSON Schemas for :mod:`..functions.json_schema`; what a schema can't say (unique ids, coverage, fresh hashes) is a
column rule beside it. Texts come as rows (path, text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import json_schema
from ..functions import text as X
from . import schemas as S

# Allowed words of the closed fields.
GENRES = ("oral_talk", "written_article", "book", "guided_meditation", "qa", "scripture", "other")
ORIGINS = ("oral_talk", "written_text", "mixed", "unknown")
DELIVERIES = ("publication_article", "publication_book", "transcript", "subtitles", "audio_script", "guided_practice", "other")
FORMALITIES = ("conversational", "neutral", "formal", "liturgical")
BRIDGES = ("none", "minimal_inline", "first_mention", "footnotes_only")
FIRST_MENTIONS = ("english_only", "english_and_sanskrit", "sanskrit_and_english")
LEVELS = ("draft", "internal", "public", "sensitive")
TRACKS = ("source_analysis", "bilingual_review")
ROLES = ("agent", "experiencer", "patient", "theme", "beneficiary", "recipient", "instrument", "stimulus", "causer", "source", "goal", "location", "other")
RELATIONS = ("purpose", "cause", "condition", "result", "contrast", "progression", "cost", "concession", "coordination", "temporal", "other")
SCOPES = ("tense", "aspect", "modality", "negation", "quantity", "degree", "other")
EVIDENCE = ("explicit", "contextual_inference", "ambiguous")
REVIEW_CODES = ("predicate_drift", "role_drift", "logical_relation", "scope", "negation_scope", "unsupported_tense", "unsupported_modality", "omission", "addition", "terminology", "coreference_meaning", "publication_register", "other")
REVIEW_CATEGORIES = ("meaning", "omission", "addition", "terminology", "register", "other")
REVIEW_SEVERITIES = ("critical", "major", "minor", "discussion")

TEXT, FLAG = {"type": "string"}, {"type": "boolean"}
FILLED = {"type": "string", "pattern": "\\S"}


def words(allowed: tuple[str, ...]) -> dict:
    return {"enum": list(allowed)}


def record(optional: tuple[str, ...] = (), **fields: dict) -> dict:
    """An object with these fields and no others; all but the ``optional`` ones must be there."""
    return {"type": "object", "additionalProperties": False, "required": [n for n in fields if n not in optional], "properties": fields}


def several(item: dict, **more) -> dict:
    return {"type": "array", "items": item, **more}


_PUBLISHED = {"required": ["delivery_format"], "properties": {"delivery_format": words(("publication_article", "publication_book"))}}
_NOT_CONVERSATIONAL = {"properties": {"register": {"properties": {"formality": {"not": {"const": "conversational"}}}}}}
PROJECT = record(
    ("scriptures", "source_origin", "delivery_format", "external_semantic_review"),
    project_id=FILLED, title=FILLED, author=FILLED, translator=FILLED, genre=words(GENRES), audience=FILLED,
    register=record(voice=FILLED, formality=words(FORMALITIES)),
    cultural_bridge=record(("notes",), policy=words(BRIDGES), notes=TEXT),
    sanskrit=record(("notes",), diacritics=FLAG, first_mention=words(FIRST_MENTIONS), notes=TEXT),
    scriptures=several(record(("citation_policy",), work=TEXT, source_version=TEXT, target_version=TEXT, citation_policy=TEXT)),
    versions=record(("model", "skills"), toolkit_commit={"type": "string", "minLength": 7, "pattern": "\\S"}, termbase=FILLED, model=TEXT, skills={"type": "object", "additionalProperties": TEXT}),
    release=record(
        ("named_approver_required", "independent_review", "approval"), level=words(LEVELS), independent_review_required=FLAG, named_approver_required=FLAG,
        independent_review=record(("completed", "reviewer"), completed=FLAG, reviewer=TEXT), approval=record(("approved", "approver", "note"), approved=FLAG, approver=TEXT, note=TEXT),
    ),
    source_origin=words(ORIGINS), delivery_format=words(DELIVERIES), external_semantic_review=words(("allow", "deny")),
) | {"if": _PUBLISHED, "then": _NOT_CONVERSATIONAL}

_POLICY = (
    "project_id string, genre string, source_origin string, delivery_format string, external_semantic_review string, release struct<level: string, independent_review_required: boolean, "
    "named_approver_required: boolean, independent_review: struct<completed: boolean, reviewer: string>, approval: struct<approved: boolean, approver: string, note: string>>"
)


def read_projects(texts: DataFrame) -> DataFrame:
    """path, the release policy with its defaults, and problem of each project file."""
    p = F.from_json("text", _POLICY)
    d = json_schema.validate(texts.select("path", "text"), "text", PROJECT).withColumn("p", p)
    off, none = F.lit(False), F.lit("")
    return d.select(
        "path", "p.project_id", "p.genre", F.coalesce("p.source_origin", F.lit("unknown")).alias("source_origin"), F.coalesce("p.delivery_format", F.lit("other")).alias("delivery_format"),
        F.coalesce("p.external_semantic_review", F.lit("allow")).alias("external_semantic_review"), F.col("p.release.level").alias("level"), "p.release.independent_review_required",
        F.coalesce("p.release.named_approver_required", off).alias("named_approver_required"), F.coalesce("p.release.independent_review.completed", off).alias("review_completed"),
        X.strip(F.coalesce("p.release.independent_review.reviewer", none)).alias("reviewer"), F.coalesce("p.release.approval.approved", off).alias("approved"),
        X.strip(F.coalesce("p.release.approval.approver", none)).alias("approver"), "problem",
    )


#: What an annotator may see of a project and of a term map; keys in order.
_SHOWN_PROJECT = (
    "audience string, author string, cultural_bridge struct<notes: string, policy: string>, delivery_format string, external_semantic_review string, genre string, project_id string, "
    "register struct<formality: string, voice: string>, release struct<level: string>, sanskrit struct<diacritics: boolean, first_mention: string, notes: string>, "
    "scriptures array<struct<citation_policy: string, source_version: string, target_version: string, work: string>>, source_origin string, title string"
)
_SHOWN_TERMS = "terms array<struct<allowed: array<string>, forbidden: array<string>, preferred: string, rationale: string, sense: string, source: string, sources: array<string>, status: string>>, version int"


def shown_project(texts: DataFrame) -> DataFrame:
    """path, json: the fields of a project that may go to an annotator; fields that are absent or null stay away."""
    return texts.select("path", F.to_json(F.from_json("text", _SHOWN_PROJECT)).alias("json"))


def shown_terms(texts: DataFrame) -> DataFrame:
    """path, json: a term map without who decided on it."""
    return texts.select("path", F.to_json(F.from_json("text", _SHOWN_TERMS)).alias("json"))


def read_analyses(texts: DataFrame) -> DataFrame:
    """path, provider, three digests, paragraphs and problem of each source analysis."""
    d = texts.select("path", F.from_json("text", S.ANALYSIS).alias("a")).select("path", "a.*")
    digests = X.is_hex64("source_sha256") & X.is_hex64("project_sha256") & X.is_hex64("term_map_sha256")
    ids = F.transform("paragraphs", lambda p: p["paragraph_id"])
    problem = (
        F.when(F.coalesce(X.is_blank("provider"), F.lit(True)), "no provider").when(~F.coalesce(digests, F.lit(False)), "bad digest").when(F.col("paragraphs").isNull(), "no paragraphs")
        .when(F.exists(ids, lambda i: ~F.coalesce(X.is_line_id(i), F.lit(False))), "bad paragraph_id").when(F.size(ids) != F.size(F.array_distinct(ids)), "repeated paragraph_id")
    )
    return d.select("path", "provider", "source_sha256", "project_sha256", "term_map_sha256", "paragraphs", problem.alias("problem"))


def fresh_paragraphs(analyses: DataFrame, current: DataFrame) -> DataFrame:
    """doc_id, line_no, paragraph_id, analysis of sound analyses made from the current files; a stale or unsound one gives no row.

    ``current``: path, source_sha256, project_sha256, term_map_sha256.
    """
    same = [F.col(f"a.{n}") == F.col(f"c.{n}") for n in ("source_sha256", "project_sha256", "term_map_sha256")]
    j = analyses.where("problem is null").alias("a").join(current.alias("c"), F.col("a.path") == F.col("c.path")).where(same[0] & same[1] & same[2])
    d = j.select(F.col("a.path").alias("doc_id"), F.explode("a.paragraphs").alias("analysis"))
    return d.select("doc_id", F.substring("analysis.paragraph_id", 2, 12).cast("int").alias("line_no"), "analysis.paragraph_id", "analysis")


_METADATA = record(("source_origin", "delivery_format", "formality"), source_origin=TEXT, delivery_format=TEXT, formality=TEXT)
_OF = lambda track: {"properties": {"track": {"const": track}}}
GOLD = {
    "type": "object", "required": ["version", "cases"],
    "properties": {"version": {"const": 1}, "cases": several({
        "type": "object", "required": ["case_id", "track", "source", "gold"],
        "properties": {"case_id": {"type": "string", "minLength": 1}, "track": words(TRACKS), "source": TEXT, "source_context": several(TEXT, minItems=1), "metadata": _METADATA, "gold": {"type": "object"}},
        "allOf": [{"if": _OF("source_analysis"), "then": {"not": {"required": ["target"]}}}, {"if": _OF("bilingual_review"), "then": {"required": ["target"], "properties": {"target": TEXT}}}],
    })},
}


def read_gold(texts: DataFrame) -> DataFrame:
    """path, cases, problem of each gold file: ids are unique and both tracks occur."""
    d = json_schema.validate(texts.select("path", "text"), "text", GOLD)
    d = d.withColumn("cases", F.from_json("text", T.StructType().add("cases", T.ArrayType(S.GOLD_CASE)))["cases"])
    ids, tracks = F.transform("cases", lambda c: c["case_id"]), F.transform("cases", lambda c: c["track"])
    more = F.when(F.size(ids) != F.size(F.array_distinct(ids)), "repeated case_id").when(F.size(F.array_except(F.array(*map(F.lit, TRACKS)), tracks)) > 0, "a track is missing")
    return d.select("path", "cases", F.coalesce("problem", more).alias("problem"))


_RESULTS = {
    "source_analysis": record(
        case_id=TEXT, predicates=several(TEXT), roles=several(record(predicate=TEXT, role=words(ROLES), participant={"type": ["string", "null"]}, evidence_status=words(EVIDENCE))), relations=several(words(RELATIONS)),
        scopes=several(record(kind=words(SCOPES), marker={"type": ["string", "null"]}, scope=TEXT)), ambiguities=several(TEXT), must_not_invent=several(TEXT), status=words(("clear", "needs_human")),
    ),
    "bilingual_review": record(
        case_id=TEXT, findings=several(record(code=words(REVIEW_CODES), severity=words(REVIEW_SEVERITIES), category=words(REVIEW_CATEGORIES), message={"type": "string", "minLength": 1}, constraint={"type": "string", "minLength": 1})), summary=TEXT,
    ),
}


def response_schema(track: str) -> dict:
    return record(results=several(_RESULTS[track]))


def response_problems(responses: DataFrame, cases: DataFrame, track: str) -> DataFrame:
    """path, problem of annotators' responses: their shape, and one result for each case of the track in the order asked for.

    ``cases``: ord, case_id, track. The list of cases is one row, which is broadcast.
    """
    asked = cases.where(F.col("track") == track).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "case_id"))), lambda c: c["case_id"]).alias("asked"))
    d = json_schema.validate(responses.select("path", "text"), "text", response_schema(track)).join(F.broadcast(asked))
    given = F.transform(F.from_json("text", "results array<struct<case_id: string>>")["results"], lambda r: r["case_id"])
    more = F.when(F.size(given) != F.size(F.array_distinct(given)), "repeated case_id").when(given != F.col("asked"), "cases or their order differ")
    return d.select("path", F.coalesce("problem", more).alias("problem"))


def read_runs(texts: DataFrame, prices: DataFrame) -> DataFrame:
    """Saved runs with their cost: ``prices`` has provider, model, prompt_price, completion_price per million tokens; none gives a null cost."""
    from ..operators.scoring import cost

    d = texts.select("path", F.from_json("text", S.RUN).alias("r")).select("path", "r.*")
    problem = F.when(F.col("provider").isNull() | F.col("track").isNull() | F.col("run").isNull(), "unreadable").when(~F.col("track").isin(*TRACKS), "bad track").when(~X.is_hex64("request_sha256"), "bad digest")
    j = d.withColumn("problem", problem).join(prices, ["provider", "model"], "left")
    return j.withColumn("estimated_cost", cost(F.col("usage.prompt_tokens"), F.col("usage.completion_tokens"), F.col("prompt_price"), F.col("completion_price"))).drop("prompt_price", "completion_price")
