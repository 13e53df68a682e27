"""Event-time windows and incremental sinks over streams of frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def timed(stream: DataFrame, time: str) -> DataFrame:
    """Event times as timestamps: files may hold them without a zone, which watermarks don't take."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def windowed(stream: DataFrame, time: str, key: str, value: str, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling (or sliding) windows and key; rows later than the watermark go."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return timed(stream, time).withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, time: str, key: str, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    return timed(stream, time).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def save_every(stream: DataFrame, step: int, row: str, sink: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Hands every step-th row of each micro-batch to a sink, once."""
    kept = stream.where(F.col(row) % step == 0)
    return kept.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: sink(df, epoch)).start()
