"""Append-only journals, day partitions, caches and look counters over plain tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_events(events: DataFrame, path: str) -> None:
    """Add events, with the time they were written, to a JSON journal."""
    events.withColumn("ts", F.lit(dt.datetime.now(dt.UTC).isoformat())).write.mode("append").json(path)


def done_keys(spark: SparkSession, path: str, schema: str, key: str, event: str = "notice_done") -> DataFrame:
    return spark.read.schema(schema).json(path).where(F.col("event") == event).select(key).distinct()


def write_days(rows: DataFrame, path: str, day: str = "day") -> None:
    """Rows as one compressed JSON partition a day; only the days at hand are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy(day).json(path)


def read_days(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All days. Raises where a column names a contact: such fields must never be stored."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.json(path)
    bad = [c for c in df.columns if c.startswith(("contact_", "secondary_contact"))]
    if bad:
        raise ValueError(f"columns that name contacts: {bad}")
    return df


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def with_cached(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Requests answered from the cache (its last row of a key counts), and those that are not."""
    answers = cache.groupBy(key).agg(F.max_by("answer", "seq").alias("answer"))
    return requests.join(answers, key), requests.join(answers.select(key), key, "left_anti")


def look_number(leaderboard: DataFrame, split: str) -> int:
    """Which look at a split the next entry is."""
    return leaderboard.where(F.col("split") == split).count() + 1
