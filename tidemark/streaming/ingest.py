"""Streaming ingest of landed observation events, late rows included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ingest import insert_if_absent
from tidemark.schemas import OBSERVATION_EVENT
from tidemark.session import exists

KEYS = ["full_name", "source", "captured_at"]
DAILY = "day timestamp, full_name string, source string, captured_at timestamp, event_id string, events bigint"


def read_events(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    """A stream of JSON event files; events without a valid name or instant are left out."""
    rows = spark.readStream.schema(OBSERVATION_EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)
    rows = rows.withColumn("captured_at", F.to_timestamp("captured_at"))
    return rows.where(F.col("full_name").rlike("^[^/]+/[^/]+$") & F.col("captured_at").isNotNull() & F.col("source").isNotNull())


def ingest(events: DataFrame, table: str, checkpoint: str) -> None:
    """Insert what a folder's events hold and the table lacks, however late, then stop. Replays of a batch insert nothing twice."""
    spark = events.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.select("event_id", *KEYS).withColumn("batch", F.lit(number))
        old = spark.read.schema(rows.schema).parquet(table) if exists(spark, table) else rows.limit(0)  # the first batch makes the table
        others = old.where(F.col("batch") != number)
        new = insert_if_absent(others, rows, KEYS, order="event_id").where(F.col("batch") == number)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    q = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def daily_latest(events: DataFrame, table: str, checkpoint: str) -> None:
    """Add what a folder's events say of each name, source and day, however late, then stop; latest_days reads it.

    The table holds each batch's last event and count in a partition of its own, which a replay of the batch overwrites.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("day", F.window("captured_at", "1 day")["start"]).groupBy("day", "full_name", "source")
        last = rows.agg(F.max("captured_at").alias("captured_at"), _last(), F.count("*").alias("events")).withColumn("batch", F.lit(number))
        last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    q = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_days(spark: SparkSession, table: str) -> DataFrame:
    """(day, full_name, source, event_id, events): the batches of daily_latest merged, days that are still open included."""
    rows = spark.read.schema(DAILY).parquet(table).groupBy("day", "full_name", "source")
    return rows.agg(_last(), F.sum("events").alias("events"))


def _last() -> Column:
    return F.max_by("event_id", F.struct("captured_at", "event_id")).alias("event_id")
