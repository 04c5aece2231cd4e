"""Writers: ordered text, reports, JSON lines, and a manifest that switches several tables at once."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_texts(docs: DataFrame, path: str, text: str = "text") -> None:
    """(doc_id, text) rows as JSON lines, committed as a whole; a file for each document would make many small files."""
    docs.select("doc_id", text).write.mode("overwrite").json(path)


def write_checked(rows: DataFrame, path: str, problem: str = "problem") -> None:
    """Artefacts as JSON lines, if none has a problem; else nothing is written and the first problems are raised."""
    bad = rows.where(F.col(problem).isNotNull()).limit(5).collect()
    if bad:
        raise ValueError("; ".join(str(r[problem]) for r in bad))
    rows.drop(problem).write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Rows of ``text`` in total order, as text files whose names sort in that order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.mode("overwrite").text(path)


def report_json(checks: DataFrame, report: DataFrame) -> DataFrame:
    """doc_id, json: overall status, names by status, and details by check (null fields kept)."""
    details = checks.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("check", F.struct("status", "issues"))))).alias("details"))
    return report.join(details, "doc_id").select("doc_id", F.to_json(F.struct("overall", "passed", "warned", "skipped", "failed", "details"), {"ignoreNullFields": "false"}).alias("json"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def commit_together(spark: SparkSession, base: str, tables: dict[str, DataFrame]) -> str:
    """Write each table to a new version below ``base``, then switch the manifest by one rename.

    Readers (:func:`read_current`) see all tables of a version or none. A failure before the rename
    leaves the old version in place.
    """
    version = f"v{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{base}/{version}/{name}")
    fs, new = _fs(spark, f"{base}/manifest-{version}.tmp")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps({"version": version, "tables": sorted(tables)}).encode()))
    out.close()
    # manifests are never overwritten; the last name in order is the current one
    if not fs.rename(new, _fs(spark, f"{base}/manifest-{version}.json")[1]):
        raise OSError(f"cannot switch {base} to {version}")
    return version


def read_current(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    fs, p = _fs(spark, base)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
    if not names:
        return {}
    manifest = json.loads(spark.read.text(f"{base}/{names[-1]}", wholetext=True).first()[0])
    return {t: spark.read.parquet(f"{base}/{manifest['version']}/{t}") for t in manifest["tables"]}
