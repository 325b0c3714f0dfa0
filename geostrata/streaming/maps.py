"""Maps kept up to date by Structured Streaming: batches of traces arrive, folds and worst values grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, by: list[str], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and key, with a watermark that lets state go."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"), F.max("value").alias("worst")).select(F.col("window.start").alias("start"), *by, "n", "worst")


def running_map(stream: DataFrame, by: list[str], value: str) -> DataFrame:
    return stream.groupBy(*by).agg(F.count("*").alias("fold"), F.max(value).alias(value))


def append_to_map(stream: DataFrame, path: str, checkpoint: str, by: list[str], value: str):
    """Appends each batch's aggregate to a Parquet map; the batch number makes a repeated batch recognisable."""

    def put(batch: DataFrame, number: int) -> None:
        out = batch.groupBy(*by).agg(F.count("*").alias("fold"), F.max(value).alias(value)).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_map(spark, path: str, by: list[str], value: str) -> DataFrame:
    """The map over all batches: folds add up, the worst value stays."""
    return spark.read.parquet(path).groupBy(*by).agg(F.sum("fold").alias("fold"), F.max(value).alias(value))
