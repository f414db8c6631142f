"""Departures as a stream: activity by window, with late data bounded by a watermark. The reference has no streams; this is the batch query kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_departures(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly_activity(departures: DataFrame, by: str, ts: str, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """(by, hour, c): departures of each window; state is dropped once the watermark has passed a window."""
    timed = departures.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    counts = timed.groupBy(by, F.window("__ts", width).alias("w")).agg(F.count(F.lit(1)).alias("c"))
    return counts.select(by, F.col("w.start").alias("hour"), "c")


def keep_table(stream: DataFrame, path: str, checkpoint: str):
    """Append finished windows to a Parquet table, exactly once; stops when the input is used up."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
