"""Schemas of the nested records that the operators read."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


PARTICIPANT = _struct(role=_S, participant=_S, evidence=_S, evidence_status=_S, notes=_S)
PREDICATE = _struct(predicate=_S, canonical_meaning=_S, evidence=_S, participants=_A(PARTICIPANT))
RELATION = _struct(source=_S, target=_S, relation=_S, evidence=_S, evidence_status=_S, notes=_S)
OPERATOR = _struct(operator=_S, scope=_S, kind=_S, evidence=_S, evidence_status=_S, notes=_S)
REFERENCE = _struct(expression=_S, kind=_S, referent=_S, evidence=_S, evidence_status=_S, notes=_S)
INTERPRETATION = _struct(interpretation=_S, evidence=_A(_S), consequence=_S, notes=_S)
PARAGRAPH = _struct(
    paragraph_id=_S, predicates=_A(PREDICATE), relations=_A(RELATION), operators=_A(OPERATOR), references_and_ellipsis=_A(REFERENCE),
    competing_interpretations=_A(INTERPRETATION), must_preserve=_A(_S), must_not_invent=_A(_S), status=_S,
)
ANALYSIS = _struct(project=_struct(project_id=_S), source_sha256=_S, project_sha256=_S, term_map_sha256=_S, provider=_S, model=_S, generated_at=_S, paragraphs=_A(PARAGRAPH))
FINDING = _struct(finding_id=_S, paragraph_id=_S, severity=_S, category=_S, message=_S, suggestion=_S, status=_S, reviewer=_S, resolution_note=_S, stage=_S, provider=_S, model=_S, source_sha256=_S, target_sha256=_S)
CERTIFICATE = _struct(schema_version=T.IntegerType(), stage=_S, provider=_S, model=_S, source_sha256=_S, target_sha256=_S, review_round=T.IntegerType(), blocking_findings=T.IntegerType(), blocking_finding_ids=_A(_S), status=_S, finding_ids=_A(_S), findings_sha256=_S, generated_at=_S, summary=_S)
TERM = _struct(source=_S, sense=_S, preferred=_S, allowed=_A(_S), forbidden=_A(_S), sources=_A(_S), rationale=_S, status=_S, reviewer=_S)
TERM_MAP = _struct(version=T.IntegerType(), terms=_A(TERM))
SEGMENT = _struct(id=_S, start=T.DoubleType(), end=T.DoubleType(), source_line=T.IntegerType())
SOURCE_MAP = _struct(schema_version=T.IntegerType(), media_sha256=_S, segments=_A(SEGMENT))
GOLD_CASE = _struct(case_id=_S, track=_S, source_context=_A(_S), source=_S, target=_S, gold=_S)
RUN = _struct(provider=_S, model=_S, track=_S, run=T.IntegerType(), request_sha256=_S, schema_valid=T.BooleanType(), timed_out=T.BooleanType(), latency_seconds=T.DoubleType(), usage=_struct(prompt_tokens=T.LongType(), completion_tokens=T.LongType()), output=_S)

# Allowed words of the closed fields.
SEVERITIES = ("critical", "major", "minor", "discussion")
FINDING_STATUSES = ("open", "resolved", "rejected", "deferred")
CATEGORIES = ("meaning", "omission", "addition", "terminology", "scripture", "register", "fluency", "format", "other")
FINDING_REQUIRED = ("finding_id", "paragraph_id", "severity", "category", "message", "suggestion", "status", "reviewer")
