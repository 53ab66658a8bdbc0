"""A running benchmark as a stream: rows are counted once, windows are summarised, progress is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def result_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files below path, in bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(rows: DataFrame, key: Sequence[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys older than late are forgotten, so the state stays bounded."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def windowed(rows: DataFrame, time: str, width: str, by: Sequence[str], value: str, late: str = "1 hour") -> DataFrame:
    """count, mean, least and largest value for each window and group; rows later than late are left out in a stream."""
    watched = rows.withWatermark(time, late) if rows.isStreaming else rows
    grouped = watched.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("records"), F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return grouped.select(F.col("w.start").alias("window_start"), *by, "records", "mean_value", "min_value", "max_value")


def sink(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to Parquet, exactly once, until the input is used up."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_counts(rows: DataFrame, by: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Counts by group of each micro-batch, one folder a batch; a batch that is replayed replaces its folder. ``totals`` adds them up."""

    def save(batch: DataFrame, number: int) -> None:
        batch.groupBy(*by).agg(F.count(F.lit(1)).alias("records")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """Records by group over all batches that batch_counts has written so far."""
    return spark.read.parquet(path).groupBy(*by).agg(F.sum("records").alias("records"))
