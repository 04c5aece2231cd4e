"""Readers of the text and record formats, each as rows with a problem column instead of exceptions.

All files are read through Spark's readers, so they may lie in any store Spark can open.
"""

from __future__ import annotations

import sqlite3
import unicodedata
from contextlib import closing
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import json_schema, text as X
from . import schemas as S


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 (of the raw bytes), text, problem of each file: bytes are hashed and decoded from one read. Spark lists no empty files, so these have no row."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    whole = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(whole), whole)
    problem = F.when(text.isNull(), "not UTF-8").when(F.instr(text, "\0") > 0, "holds NUL")
    return raw.select("path", F.sha2("content", 256).alias("sha256"), text.alias("text"), problem.alias("problem"))


def format_of(path: Column | str) -> Column:
    """text, markdown or djot by the extension; null for others."""
    p = F.lower(X.as_column(path))
    return F.when(p.endswith(".txt"), "text").when(p.endswith(".md") | p.endswith(".markdown"), "markdown").when(p.endswith(".dj") | p.endswith(".djot"), "djot")


def document_lines(docs: DataFrame) -> DataFrame:
    """path, line_no, paragraph_id (``L3``, null for blank lines), text."""
    d = docs.select("path", F.posexplode(X.split_lines("text")).alias("i", "text"))
    n = F.col("i") + 1
    return d.select("path", n.alias("line_no"), F.when(~X.is_blank("text"), F.concat(F.lit("L"), n.cast("string"))).alias("paragraph_id"), "text")


def normalise_plain(docs: DataFrame) -> DataFrame:
    """``docs`` with text in NFC, LF line ends and one final LF. NFC has no built-in, so it is one Arrow-fed pass."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(text=[None if t is None else unicodedata.normalize("NFC", t) for t in f["text"]])

    return docs.withColumn("text", X.normalise_eol("text")).mapInPandas(batches, docs.schema)


def term_map_json(texts: DataFrame) -> DataFrame:
    """path, term struct, problem of each entry of term maps in JSON; one row with a problem for an unreadable file."""
    parsed = F.from_json("text", S.TERM_MAP, {"mode": "PERMISSIVE"})
    d = texts.select("path", parsed.alias("m")).select("path", F.explode_outer("m.terms").alias("term"))
    blank = lambda c: F.coalesce(X.is_blank(c), F.lit(True))
    twice = F.count("*").over(Window.partitionBy("path", F.col("term.source"))) > 1
    shared = F.size(F.array_intersect(F.transform(F.concat(F.array("term.preferred"), F.coalesce("term.allowed", F.array().cast("array<string>"))), F.lower), F.transform(F.coalesce("term.forbidden", F.array().cast("array<string>")), F.lower))) > 0
    problem = F.when(F.col("term").isNull(), "unreadable").when(blank("term.source"), "no source").when(blank("term.preferred"), "no preferred").when(~F.coalesce(F.col("term.status").isin("selected", "needs_human", "approved"), F.lit(False)), "bad status").when(twice, "repeated source").when(shared, "allowed and forbidden")
    return d.select("path", "term", problem.alias("problem"))


def term_map_table(texts: DataFrame) -> DataFrame:
    """path, source, renderings from Markdown tables, or lines with TAB or ``|``.

    Renderings and sources with ``/`` or ``、`` are several; the last entry of a source wins.
    """
    d = texts.select("path", F.posexplode(X.split_lines("text")).alias("i", "line"))
    line = F.regexp_replace(X.strip("line"), "\\A\\||\\|\\z", "")
    cells = F.transform(F.split(line, "\\t|\\|"), X.strip)
    d = d.select("path", "i", cells.alias("c")).where("size(c) >= 2").where(~F.col("c")[0].rlike("\\A[:\\s-]*\\z") & (F.col("c")[1] != "") & ~F.col("c")[1].rlike("\\A:?-{2,}:?\\z"))
    parts = lambda c: F.filter(F.transform(F.split(c, "[/、]"), X.strip), lambda x: x != "")
    one = d.select("path", "i", F.explode(parts(F.col("c")[0])).alias("source"), parts(F.col("c")[1]).alias("renderings"))
    return one.groupBy("path", "source").agg(F.max_by("renderings", "i").alias("renderings"))


def term_candidates(texts: DataFrame) -> DataFrame:
    """path, ord, source, sense of candidate lists: strings or objects, first of equal sources."""
    # both kinds of items parse as VARIANT, so one pass serves lists of strings and of objects
    v = F.parse_json("text")
    items = F.expr("coalesce(try_variant_get(v, '$.terms', 'array<variant>'), try_variant_get(v, '$', 'array<variant>'))")
    d = texts.select("path", v.alias("v")).select("path", F.posexplode(items).alias("ord", "x"))
    name = F.expr("coalesce(try_variant_get(x, '$.source', 'string'), CASE WHEN schema_of_variant(x) = 'STRING' THEN try_variant_get(x, '$', 'string') END)")
    d = d.select("path", "ord", X.strip(name).alias("source"), F.coalesce(X.strip(F.expr("try_variant_get(x, '$.sense', 'string')")), F.lit("")).alias("sense"))
    first = F.row_number().over(Window.partitionBy("path", "source").orderBy("ord"))
    return d.withColumn("k", first).where("k = 1").drop("k")


_FILLED, _DIGEST, _TEXT = {"type": "string", "pattern": "\\S"}, {"type": "string", "pattern": "^[0-9a-f]{64}\\z"}, {"type": "string"}
FINDING_SHAPE = {
    "type": "object", "additionalProperties": False, "required": list(S.FINDING_REQUIRED), "properties": {
        **dict.fromkeys(("finding_id", "paragraph_id", "message", "reviewer", "stage", "provider", "model"), _FILLED), **dict.fromkeys(("suggestion", "resolution_note"), _TEXT),
        **dict.fromkeys(("source_sha256", "target_sha256"), _DIGEST), "severity": {"enum": list(S.SEVERITIES)}, "category": {"enum": list(S.CATEGORIES)}, "status": {"enum": list(S.FINDING_STATUSES)},
    },
}


def findings_jsonl(lines: DataFrame, history: bool = False) -> DataFrame:
    """path, line_no, finding, problem of the lines of findings files (path, line_no, text); an id that came before is a problem.

    Blank lines are passed over, but in a ``history`` they are a problem.
    """
    kept = lines if history else lines.where(~X.is_blank("text"))
    d = json_schema.validate(kept.select("path", "line_no", "text"), "text", FINDING_SHAPE)
    d = d.withColumn("finding", F.when(~X.is_blank("text"), F.from_json("text", S.FINDING)))
    before = F.row_number().over(Window.partitionBy("path", "finding.finding_id").orderBy("line_no")) > 1
    more = F.when(before & F.col("finding.finding_id").isNotNull(), "repeated id")
    return d.select("path", "line_no", "finding", F.when(X.is_blank("text"), "blank line").otherwise(F.coalesce("problem", more)).alias("problem"))


_IDS = {"type": "array", "items": _FILLED, "uniqueItems": True}
CERTIFICATE_SHAPE = {
    "type": "object", "additionalProperties": False, "required": S.CERTIFICATE.fieldNames(), "properties": {
        "schema_version": {"const": 1}, "stage": {"const": "semantic_review"}, **dict.fromkeys(("provider", "model", "generated_at", "summary"), _FILLED), **dict.fromkeys(("source_sha256", "target_sha256", "findings_sha256"), _DIGEST),
        "review_round": {"type": "integer", "minimum": 1}, "blocking_findings": {"type": "integer", "minimum": 0}, "blocking_finding_ids": _IDS, "finding_ids": _IDS, "status": {"enum": ["clear", "blocking", "needs_human"]},
    },
}


def certificates_json(texts: DataFrame) -> DataFrame:
    """path, certificate, problem: the shape first, then whether the count, the status and the time agree with the rest."""
    d = json_schema.validate(texts.select("path", "text"), "text", CERTIFICATE_SHAPE).withColumn("c", F.from_json("text", S.CERTIFICATE))
    clear = (F.col("c.status") == "clear") == (F.col("c.blocking_findings") == 0)
    more = F.when(F.size("c.blocking_finding_ids") != F.col("c.blocking_findings"), "count does not match").when(~clear, "status does not match").when(~X.is_offset_datetime("c.generated_at"), "bad time")
    return d.select("path", F.col("c").alias("certificate"), F.coalesce("problem", more).alias("problem"))


def project_json(texts: DataFrame, required: tuple[str, ...], allowed: tuple[str, ...]) -> DataFrame:
    """path, missing, unknown: fields of project files against the required and allowed names."""
    keys = F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>"))
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return texts.select("path", F.array_except(lit(required), keys).alias("missing"), F.array_except(keys, lit((*required, *allowed))).alias("unknown"))


def source_map_json(texts: DataFrame) -> DataFrame:
    """track (the path), ord, id, start, end, source_line of source maps."""
    d = texts.select(F.col("path").alias("track"), F.posexplode(F.from_json("text", S.SOURCE_MAP)["segments"]).alias("ord", "s"))
    return d.select("track", "ord", "s.*")


def sheet_csv(spark: SparkSession, path: str) -> DataFrame:
    """A term sheet with multi-line fields: header names trimmed and made unique, empty trailing columns and rows gone."""
    df = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path)
    head = df.first()
    if head is None:
        return df
    n = max((i + 1 for i, v in enumerate(head) if v and v.strip()), default=0)
    seen: dict[str, int] = {}
    names = []
    for i, v in enumerate(head[:n]):
        name = (v or "").strip() or f"column{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    body = df.select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(m) for c, m in zip(df.columns, names, strict=False)))
    same = [F.col(f"`{m}`") == F.lit((v or "").strip()) for m, v in zip(names, head, strict=False)]
    any_ = F.greatest(*(F.length(F.col(f"`{m}`")) for m in names), F.lit(0)) > 0
    is_head = same[0]
    for s in same[1:]:
        is_head = is_head & s
    return body.where(any_ & ~is_head)


def term_table_sqlite(spark: SparkSession, path: str, table: str = "terms", batch: int = 10_000) -> DataFrame:
    """path, row_id, zh, en, loc, source, problem of database files: row_id is the place in the table, from 1; a file that can't be read is one row with a problem.

    A file is a row of bytes (so under 2 GB), opened in memory: nothing is written beside it, locked or
    waited for, and an unmerged write-ahead log is not read. Rows leave in batches of ``batch``.
    """
    query = 'SELECT CAST(zh AS TEXT), CAST(en AS TEXT), CAST(loc AS TEXT), CAST(source AS TEXT) FROM "{}"'.format(table.replace('"', '""'))
    names = ["zh", "en", "loc", "source"]

    def rows(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        with closing(sqlite3.connect(":memory:")) as db:
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            try:
                db.deserialize(content[:18] + b"\1\1" + content[20:])  # the two bytes would ask for the log
                found, at = db.execute(query), 1
                while got := found.fetchmany(batch):
                    f = pd.DataFrame(got, columns=names, dtype=object)
                    yield f.assign(path=path, row_id=range(at, at + len(got)), problem=None)
                    at += len(got)
            except sqlite3.Error:
                yield pd.DataFrame([dict.fromkeys(names)], dtype=object).assign(path=path, row_id=None, problem="unreadable")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                for part in rows(name, content):
                    yield part.astype({"row_id": "Int64"})

    schema = "path string, row_id long, zh string, en string, loc string, source string, problem string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(batches, schema)
