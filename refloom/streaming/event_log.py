"""The job event log as a stream: append-only, replayable, one row per progress event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def activity(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and summed values by kind and window; events later than ``late`` are dropped from closed windows."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drain(stream: DataFrame, name: str, checkpoint: str) -> None:
    """Run a stream over all that is there, into the in-memory table ``name``."""
    run = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
