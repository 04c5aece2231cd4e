"""Batches of work that is kept as it is done, so that a run which ends early goes on where it stopped.

A table of results is partitioned by project and batch, and each partition holds the last attempt at its batch: a write
replaces the partitions it has rows for and no others. A result counts for the inputs and settings it was made from, so
changed ones are done again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

KEYS = ("project", "batch")
FIELDS = "input_sha256 string, settings_sha256 string, attempt int, output string, problem string, project string, batch int"


def plan(lines: DataFrame, settings: dict[str, str], size: int = 4, context: int = 1) -> DataFrame:
    """project, batch, items, input_sha256, settings_sha256: the lines (project, line_no, text) in batches, with what they and the settings hash to."""
    from .cleanup import batches

    dealt = batches(lines.select("project", "line_no"), size, context, key="project")
    rows = dealt.join(lines, ["project", "line_no"]).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("line_no", "role", "text"))).alias("items"))
    said = F.to_json(F.array(*(F.lit(f"{k}={settings[k]}") for k in sorted(settings))))
    return rows.select(F.col("project").cast("string").alias("project"), F.col("batch").cast("int").alias("batch"), "items", F.sha2(F.to_json("items"), 256).alias("input_sha256"), F.sha2(said, 256).alias("settings_sha256"))


def saved(spark: SparkSession, path: str) -> DataFrame:
    """The last attempt at each batch; no rows where nothing was written yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(FIELDS).parquet(path) if there else spark.createDataFrame([], FIELDS)


def pending(planned: DataFrame, done: DataFrame, max_attempts: int = 3) -> DataFrame:
    """``planned`` batches without a result for their inputs and settings and with attempts left, with ``attempt``, the number of the next one."""
    names = (*KEYS, "input_sha256", "settings_sha256")
    d = planned.join(done.select(*names, F.col("attempt").alias("made"), "problem"), list(names), "left")
    left = F.col("made").isNull() | (F.col("problem").isNotNull() & (F.col("made") < max_attempts))
    return d.where(left).withColumn("attempt", (F.coalesce("made", F.lit(0)) + 1).cast("int")).drop("made", "problem")


def run(planned: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], max_attempts: int = 3, waves: int = 1) -> DataFrame:
    """Work through what is pending and return the results, one row for each planned batch.

    ``work`` turns batches into rows (project, batch, output, problem); a problem is tried again, up to ``max_attempts`` in all.
    Each of ``waves`` parts of the batches is written when it is done, so an error or a lost driver loses one part at most.
    """
    spark = planned.sparkSession
    for _ in range(max_attempts):
        for wave in range(waves):
            todo = pending(planned, saved(spark, path), max_attempts).where(F.pmod(F.xxhash64(*KEYS), F.lit(waves)) == wave)
            if todo.isEmpty():
                continue
            # results are written to the table that tells what is pending, so the list is fixed first
            todo = todo.checkpoint()
            made = todo.drop("items").join(work(todo).select(*KEYS, "output", "problem"), list(KEYS))
            out = made.select(*(f.split()[0] for f in FIELDS.split(", ")))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)
    return results(planned, path)


def results(planned: DataFrame, path: str) -> DataFrame:
    """project, batch, attempt, output, problem of each planned batch; nulls for one without a result for its inputs and settings."""
    names = (*KEYS, "input_sha256", "settings_sha256")
    done = saved(planned.sparkSession, path)
    return planned.select(*names).join(done, list(names), "left").select(*KEYS, "attempt", "output", "problem")
