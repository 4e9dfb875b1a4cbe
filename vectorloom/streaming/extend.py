"""Streams of vectors into indexes: appended deltas, running centroids, micro-batched searches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from vectorloom.operators.blocks import vectors_of


def stream_table(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is that of a static read."""
    reader: DataStreamReader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def append_to(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Every micro-batch (id, vector), passed through transform, becomes Parquet under path, once each: a batch that is repeated overwrites its folder."""

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else vectors_of(batch)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def delta(spark: SparkSession, path: str) -> DataFrame:
    """What append_to() has written so far."""
    return spark.read.parquet(path).drop("batch")


def running_centroids(assigned: DataFrame, dim: int, label: str = "list_id", vector: str = "vector") -> DataFrame:
    """Size and mean of every list as a streaming aggregation (update mode): counts and sums are the state, not means."""
    means = [F.avg(F.get(vector, F.lit(i))).alias(f"m{i}") for i in range(dim)]
    out = assigned.groupBy(label).agg(F.count(F.lit(1)).alias("size"), *means)
    return out.select(label, "size", F.array(*(f"m{i}" for i in range(dim))).alias("center"))


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, dispatch_timeout: str | None = None) -> StreamingQuery:
    """Queries (id, vector) that arrive within the timeout are searched together; results are appended to path.

    Without a timeout everything there is now is searched and the stream ends.
    """
    trigger = {"processingTime": dispatch_timeout} if dispatch_timeout else {"availableNow": True}
    return append_to(queries, path, checkpoint, search, trigger)


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "1 hour", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by key in tumbling event-time windows, with a watermark for late rows."""
    grouped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, size), key)
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")
