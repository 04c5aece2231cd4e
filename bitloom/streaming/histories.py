"""Streaming forms: rates over sliding windows, and append-only merges with one row per id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def sliding_rates(requests: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Requests and tokens per key and sliding window; requests later than ``late`` are not counted."""
    w = requests.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "key")
    return w.agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens")).select("key", F.col("window.start").alias("start"), "requests", "tokens")


def first_of_each(findings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Findings of a stream with one row per finding_id within the watermark."""
    return findings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["finding_id"])


def append_new(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append findings with unseen ids to the table at ``path``, batch by batch.

    A batch is written to a folder named by its number, replacing what a failed attempt left, so a
    restarted query writes each batch once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        new = batch.dropDuplicates(["finding_id"])
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        own = f"batch={number}"
        old = [str(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=") and s.getPath().getName() != own] if fs.exists(p) else []
        if old:
            new = new.join(spark.read.parquet(*old).select("finding_id"), "finding_id", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/{own}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
