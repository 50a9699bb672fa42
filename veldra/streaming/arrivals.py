"""Ingest of arriving files (extension): a stream tells when, the ingest what.

A file stream reports neither deletions nor every edit, so each micro-batch that
holds a file runs the whole comparison, which parses nothing that did not change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, corpus: str) -> DataFrame:
    """Files as they arrive, without their content."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown,txt}")
    return stream.load(corpus).select("path", "modificationTime", "length")


def follow(engine, corpus: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Ingest whenever files have arrived; ``once``: over what is there, then stop."""

    def handle(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.ingest(corpus)

    writer = arrivals(engine.spark, corpus).writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()
