"""Streams of assertions: the latest state of each slot, kept by an ordinary streaming aggregation, and windowed counts.

A late fact is never dropped, so the state of open slots has no watermark; windowed counts have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def latest(stream: DataFrame) -> DataFrame:
    """user_id, event_type: last instant and value, by (ts, event_id)."""
    best = F.max(F.struct("ts", "event_id", "value"))
    return stream.groupBy("user_id", "event_type").agg(best.alias("x"), F.count(F.lit(1)).alias("n")).select("user_id", "event_type", "x.ts", "x.event_id", "x.value", "n")


def hourly(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    with_time = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return with_time.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def drain(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a query over all that is there, and return its sink as a table."""
    q = result.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return result.sparkSession.table(name)
