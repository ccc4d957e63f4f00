"""Streams: files as they arrive, and windowed counts of events with late data."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuplane.session import application_dir


def arriving_files(spark: SparkSession, path: str, schema: str, watermark: str = "1 day") -> DataFrame:
    """Journal rows of stored files, each content once within the watermark."""
    rows = spark.readStream.schema(schema).json(path)
    return rows.withColumn("at", F.to_timestamp("ts")).withWatermark("at", watermark).dropDuplicatesWithinWatermark(["sha256"])


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand all that is there to ``each`` and stop; a restart goes on where this one ended."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, size: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def windowed_counts_of(spark: SparkSession, folder: str, name: str, size: str = "1 day") -> DataFrame:
    """The windows of the event files of a folder, run as a stream to its end."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{application_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    # only windows that changed leave a batch, and closed ones leave the state; the last batch of a window holds it
    query = windowed_counts(stream, size).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{base}/out").groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("w"))
    return last.select("start", "event_type", "w.n", "w.total")
