"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import dialog as D
from corpusloom.schema import RECORD


def stream_records(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Canonical records from JSON lines files as they arrive."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).json(path)


def deduplicate(stream: DataFrame, time: str, segments: str = "segments", delay: str = "1 day") -> DataFrame:
    """Drop records whose prompt key was seen within the watermark; state stays bounded by the delay."""
    keyed = stream.withColumn("prompt_hash", D.prompt_key(F.col(segments)))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["prompt_hash"])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts per tumbling window and group, late rows within the delay included."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select("window.start", by, "n")


def run_once(stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Process what has arrived, exactly once, and stop."""
    q = stream.writeStream.format(fmt).option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
