"""The corpus pipeline: five stages over the documents table.

Every stage but the last returns the columns of ``documents``; each result is written as Parquet in
the shared folder and read as the next stage's input. Decisions take effect: rejected documents
go, one document of each near-duplicate group stays, contaminated documents go, secrets are
masked in the text, and what is left is packed into sequences.

Nulls, empty and very long texts, ties and empty tables are treated as the operators state. Of rows with
one doc_id and one text one stays after the near-duplicate stage; a doc_id with unlike texts keeps each
that is no near duplicate. An extra column with the name of an operator's
result holds that result from its stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bitloom.llm.common import discard, materialize
from bitloom.llm.decontamination import decontaminate
from bitloom.llm.packing import pack_documents
from bitloom.llm.quality_rules import apply_rules, fit_rules
from bitloom.llm.secret_scan import scan_secrets
from bitloom.llm.simhash import representatives


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the base checks and the learned decision list don't reject."""
    rules = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(docs, rules).where("kept").select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked fingerprints: that with the least doc_id, null ids last.

    A document is known by its doc_id and the hash of its text, so rows with one doc_id, or none, are told apart. Texts are
    shuffled once: the removal of repeated rows and the semi-join share the partitioning by those keys. Repeated rows become
    one in each map task already, so however many there are, a task reads few; of those that differ in other columns
    that with the least hash stays.
    """
    key = {"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__text": F.xxhash64(F.col("text").cast("string"))}
    keep = representatives(docs).select(F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("text_hash").alias("__text"))
    keep = materialize(keep, "kept-ids")
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = docs.withColumns(key).groupBy(*key).agg(F.min_by(whole, F.xxhash64(*(F.col(f"`{c}`") for c in hashed))).alias("__row"))
    return once.join(keep, [*key], "left_semi").select("__row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("not contaminated").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the text; n_chars, where there is such a column, follows the new text."""
    masked = scan_secrets(docs, redact_text=True)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the ids of what is left into sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: The stages learn from data, follow links and pack greedily, which SQL can't state; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
