"""The event log as a stream: redelivered events once, counts by day of arrival.

The operators of the timeline work on tables; these two let the log arrive in pieces. State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of the log as they come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(events: DataFrame, key: str = "event_key", at: str = "ingested_at", late: str = "14 days") -> DataFrame:
    """The first delivery of each event; a redelivery within ``late`` of it is dropped, one after that is not known."""
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key])


def counts_by_day(events: DataFrame, kind: str = "event_kind", at: str = "_at") -> DataFrame:
    """Events per day of arrival and kind, final once the watermark has passed the day."""
    return events.groupBy(F.window(at, "1 day"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), kind, "n")
