"""Version histories of entity attributes from periodic snapshots.

Snapshots are folded to one row for each entity and day (the one recorded last) by a
map-side aggregate, which bounds an entity to as many rows as there are days, however
hot it is. The rows are then co-partitioned by entity and sorted by entity and day:
Spark's external sorter writes sorted runs and merges them k ways with a heap, spilling
as needed. A merge iterator reads that stream, holds the open version only, and emits
it closed as soon as the payload changes or the entity is removed.
"""

from __future__ import annotations

import datetime as dt
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def merge_runs(*runs: Iterable[tuple]) -> Iterator[tuple]:
    """Sorted runs of (entity, day, ...) as one sorted stream; holds one row of each."""
    return heapq.merge(*runs, key=lambda row: row[:2])


def versions_of(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(entity, first day, last day or None, row id) of each version.

    ``rows``: (entity, day as 'YYYY-MM-DD', payload or None if removed, row id), sorted by
    entity and day. The row id is that of the version's first row.
    """
    entity = payload = since = ident = None
    for who, day, what, row in rows:
        if who != entity:
            if payload is not None:
                yield entity, since, None, ident
            entity, payload = who, None
        if what != payload:
            if payload is not None:
                yield entity, since, day, ident
            payload, since, ident = what, day, row
    if payload is not None:
        yield entity, since, None, ident


def _day_before(day: str | None) -> str:
    return OPEN_END if day is None else (dt.date.fromisoformat(day) - dt.timedelta(days=1)).isoformat()


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(map(list, zip(*out)), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["_k", "valid_from", "valid_to", "_id"])

    for who, since, until, ident in versions_of(rows):
        out.append((who, since, _day_before(until), ident))
        if len(out) >= 20_000:
            yield batch()
            out = []
    if out:
        yield batch()


def snapshot_history(snapshots: DataFrame, *, key: Column, day: Column, recorded: Column, row_id: Column, removed: Column, payload: list[Column]) -> DataFrame:
    """``_k, valid_from, valid_to, _id``: every version of every entity.

    ``payload``: expressions over a row whose values make up a version, in the normal
    form in which they are to be compared. Of the rows of an entity and day only the one
    recorded last counts, ties going to the larger id; repeated rows change nothing.
    A removal ends a version, days without a row do not; a return to an earlier state
    is a new version. Rows without an entity, a real day or an id are left out, rows
    without a recording time count as the earliest, ``removed`` null as false. An empty
    table has no versions. Other columns, whatever their names, are not read.
    """
    digest = F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(payload)])), 256)
    rows = snapshots.select(
        key.cast("string").alias("_k"),
        F.date_format(F.try_to_timestamp(day.cast("string"), F.lit("yyyy-MM-dd")), "yyyy-MM-dd").alias("_day"),
        F.coalesce(F.unix_micros(recorded.cast("timestamp")), F.lit(-(2**62))).alias("_rec"),
        row_id.cast("long").alias("_id"),
        F.when(~F.coalesce(removed, F.lit(False)), digest).alias("_p"),
    ).dropna(subset=["_k", "_day", "_id"])
    last = rows.groupBy("_k", "_day").agg(F.max(F.struct("_rec", "_id", "_p")).alias("_b")).select("_k", "_day", F.col("_b._p").alias("_p"), F.col("_b._id").alias("_id"))
    merged = last.repartition("_k").sortWithinPartitions("_k", "_day")
    return merged.mapInArrow(_stream, "_k string, valid_from string, valid_to string, _id long")
