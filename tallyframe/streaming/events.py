"""Streams over event tables: an extension of the batch operators, with watermarks and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import upsert_parquet


def windowed(events: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per tumbling window and type; works on streams and on tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def read_log_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New JSON-line files of a folder; each file is read once."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str):
    """Every micro-batch replaces the rows of its keys (last write wins)."""

    def write(batch: DataFrame, _: int) -> None:
        upsert_parquet(batch.sparkSession, path, batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
