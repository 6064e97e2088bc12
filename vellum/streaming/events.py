"""Event logs as a stream: an extra form of the batch report, over appended JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import EVENT


def stream_events(spark: SparkSession, path: str, schema: str = EVENT, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("mode", "DROPMALFORMED").json(path)


def counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, name, n) of events with an epoch ``ts``; state older than the watermark is dropped."""
    timed = events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "name").agg(F.count(F.lit(1)).alias("n"))
