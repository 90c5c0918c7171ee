"""Hourly counters over a stream of event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.folders import new_folder


def hourly_counters(spark: SparkSession, path: str, retention: str = "24 hours") -> DataFrame:
    """(hour, metric, n) of all event files in path, read as a stream to its end.

    Event time is cast to TIMESTAMP, which watermarks need; the state of an hour is dropped after retention. The counts of
    each batch are written to the shared folder, and the stream is awaited without a limit; if it fails, so does this.
    """
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path.rsplit("/", 1)[0], pathGlobFilter=path.rsplit("/", 1)[1]).withColumn("at", F.col("ts").cast("timestamp"))
    counts = events.withWatermark("at", retention).groupBy(F.window("at", "1 hour"), F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.col("window.start").cast("string").alias("hour"), "metric", "n")
    path = new_folder(spark, "hourly")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    keep(spark.createDataFrame([], counts.schema), -1)  # a stream without events has no batch
    stream = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/counts").groupBy("hour", "metric").agg(F.max("n").alias("n"))
