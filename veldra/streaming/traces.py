"""Streams of traces (extensions): windowed latencies, redelivered events dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trace_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Traces as they are appended to a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_latency(traces: DataFrame, at: str = "ts", late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Count, mean and approximate percentiles per window and type; traces later
    than the watermark are left out, which bounds the state."""
    timed = traces.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean_value"),
        F.percentile_approx("value", [0.5, 0.95]).alias("percentiles"),
    )


def drain(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run over what is there and stop; ``handle`` gets each micro-batch."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
    query.awaitTermination()


def first_seen(events: DataFrame, key: str = "user_id", at: str = "ts", late: str = "30 days") -> DataFrame:
    """Events without redelivered ones: of each id and time the first."""
    return events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key, "event_id"])
