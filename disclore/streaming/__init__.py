"""Streams of report files and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.records import by_issuer
from ..sources.writers import BUCKETS, created, merged_into


def report_files(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Records of report files as they are dropped into a folder."""
    df = spark.readStream.schema(schemas.DAILY).option("multiLine", "true").option("maxFilesPerTrigger", per_trigger).json(path)
    return df.select(F.explode("mayaReports.result").alias("r")).select("r.*")


def upsert_stream(reports: DataFrame, path: str, checkpoint: str, key: tuple[str, str] = ("issuerName", "publicationDate"), buckets: int = BUCKETS):
    """Issuer rows upserted into a bucketed Parquet table: a batch writes the buckets of its keys again, no others.

    A batch that is replayed merges the same rows again, which changes nothing, so the result is exactly once.
    """
    def step(batch: DataFrame, n: int) -> None:
        rows = by_issuer(batch).withColumn("events", F.to_json("events"))
        if n == 0:
            created(rows.limit(0), path, list(key), buckets) if not exists(batch.sparkSession, path) else None
        merged_into(path, rows, list(key), "reportId", buckets)

    return reports.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and values by window and type, with late events kept for a while."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    g = w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total_value"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total_value")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users by a gap in time."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    g = w.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n_events"))
    return g.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")
