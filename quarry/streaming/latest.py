"""Streams: the latest qualifying event per key, and idempotent merges of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_qualifying(events: DataFrame, key: str = "user_id", excluded: str = "error") -> DataFrame:
    """Per key, the type of the last event that is not excluded; for complete or update output."""
    return events.where(F.col("event_type") != excluded).groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


def merge_answers(batch: DataFrame, path: str) -> None:
    """For foreachBatch: keep the first answer of each hash, by the batch's `ord` where it has one and then by name; running
    a batch again changes nothing, and nothing is written if nothing is new."""
    from quarry.sources.tables import exists

    spark = batch.sparkSession
    order = F.struct(*[c for c in ("ord", "name") if c in batch.columns])
    new = batch.groupBy("hash").agg(F.min_by("name", order).alias("name"))
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select("hash"), "hash", "left_anti")
    if not new.isEmpty():
        new.orderBy("hash").write.mode("append").parquet(path)
