"""Windowed counts and resumable ingest (extras; the same code runs on batches and streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def tumbling_counts(df: DataFrame, time: str, key: str, width: str, late: str | None = None) -> DataFrame:
    """Rows per key and window; on a stream ``late`` is how long late rows are waited for."""
    if df.isStreaming and late:
        df = df.withWatermark(time, late)
    return df.groupBy(F.col(key), F.window(F.col(time), width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("window_start"), "n")


def prediction_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """New JSON-lines files of a folder as a stream of rows."""
    return spark.readStream.schema(schema).json(folder)


def append_once(stream: DataFrame, target: str, checkpoint: str, ids: list[str], time: str, late: str = "1 hour") -> None:
    """Append what is new to a Parquet folder, each id once within the lateness, and stop when all is read."""
    unique = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(ids)
    unique.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
