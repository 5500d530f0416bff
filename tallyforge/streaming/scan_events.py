"""The scan's events as a stream: counts that update, first sightings, windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.scratch import scratch_path


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files; new files next to it would be read as they come."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def _timed(stream: DataFrame, late: str) -> DataFrame:
    """The stream with a watermark; a ts without a zone is taken in the session's, as watermarks need one."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type in windows of event time; what is later than the watermark is left out."""
    return _timed(stream, late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def first_seen(stream: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Each key's first row while the watermark remembers it."""
    return _timed(stream, late).dropDuplicatesWithinWatermark(key)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream gives for all that is there now, as a table in the shared folder; its state is kept there too.

    In complete mode each batch holds the whole result, so it is written apart and the last one is read.
    """
    spark, schema = stream.sparkSession, stream.schema
    path = scratch_path(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "complete":
        done: list[str] = []

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
            done.append(f"{path}/batch-{number}")

        writer.foreachBatch(write).start().awaitTermination()
    else:
        writer.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
        done = [f"{path}/rows"]
    return spark.read.schema(schema).parquet(done[-1]) if done else spark.createDataFrame([], schema)


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("event_id").alias("events"))
    return drained(counted, "complete")


def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's types of events, once."""
    return drained(events(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append")
