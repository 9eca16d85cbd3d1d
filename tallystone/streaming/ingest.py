"""Incremental ingest: new evidence files as a stream, enriched by the same expressions as a batch.

An extension; batch results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources import evidence as E


def read_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """CSV files with the evidence columns as header, as they arrive, all text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in E.COLUMNS])
    rows = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_at_once).csv(path)
    return rows.withColumn("_ord", F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in E.COLUMNS]))


def append(stream: DataFrame, enrich: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends enriched rows to a table; the checkpoint makes every file count once."""
    w = enrich(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by time window and type; rows later than the watermark are dropped from a stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return w.agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n_rows", "total")
