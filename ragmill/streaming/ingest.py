"""Streaming ingest, an extension: chunkers are stateless, so they run on a stream of documents as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.operators.chunk import chunk


def chunk_stream(spark: SparkSession, folder: str, schema: str, function: str, **params) -> DataFrame:
    """Chunks of the documents (doc_id, text) that arrive as Parquet files in ``folder``."""
    return chunk(spark.readStream.schema(schema).parquet(folder), function, **params)


def event_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; what comes later than ``late`` is dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")
