"""Streams of events: windowed rates with a watermark. Change state kept for each document is in changes.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgspark.operators.metrics import window_rates


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)


def rates(events: DataFrame, late: str = "1 hour", width: str = "5 minutes") -> DataFrame:
    """window_rates over a stream (ts, kind, value); rows later than `late` are dropped."""
    return window_rates(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width)


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Work through what is there and stop; finished windows are appended to path."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
