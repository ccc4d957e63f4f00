"""Attributes as they were known at the time of an event.

Every version of an entity has a valid time (the day it speaks of) and a recorded time
(the moment it became known). At a point (valid day, moment) the current version is,
of those valid and recorded by then, the one with the latest day, then the latest
moment. Those points form disjoint rectangles; events are points to be located.

Both planes are cut into a grid of cells of ``cell_days``. A version reaches only the
cells its own entity has events in, and what lies before a cell is folded into one row
by an aggregate before the shuffle, so that a hot entity is spread over its cells and
nothing is ever gathered per entity. Within a cell a plane sweep streams over rows
sorted by recorded time; it holds one slot for each distinct valid day of the cell, at
most ``cell_days`` + 1.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def day_number(c: Column) -> Column:
    return F.unix_date(c)


def _cells(df: DataFrame, valid: str, recorded: str, cell_days: int) -> DataFrame:
    return df.withColumns({"_vc": F.floor(F.col(valid) / cell_days).cast("long"), "_rc": F.floor(F.col(recorded) / (cell_days * DAY_US)).cast("long")})


def _sorted_cells(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("_k", "_vc", "_rc").sortWithinPartitions("_k", "_vc", "_rc", *order)


def _sweep(cell_days: int):
    cell_us = cell_days * DAY_US

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, days, slots, out = None, [], {}, []

        def emit(day: int, end: int) -> None:
            a, rec, ident, since = slots[day]
            if since < end:
                i = bisect_right(days, day)
                out.append((*cell, day, days[i] if i < len(days) else (cell[1] + 1) * cell_days, since, end, ident))

        def close() -> None:
            if cell is not None:
                for day in days:
                    emit(day, (cell[2] + 1) * cell_us)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, vc, rc, a, rec, ident in zip(*columns):
                if cell != (key, vc, rc):
                    close()
                    cell, days, slots = (key, vc, rc), [], {}
                day, now = max(a, vc * cell_days), max(rec, rc * cell_us)
                held = slots.get(day)
                if held is not None:
                    if held[:3] > (a, rec, ident):
                        continue
                    emit(day, now)
                else:
                    i = bisect_right(days, day)
                    if i:  # the slot before gives way from this day on
                        before = days[i - 1]
                        emit(before, now)
                        slots[before] = (*slots[before][:3], max(now, slots[before][3]))
                    insort(days, day)
                slots[day] = (a, rec, ident, now)
            if len(out) > 20_000:
                yield _rows(out, RECTANGLE)
                out.clear()
        close()
        if out:
            yield _rows(out, RECTANGLE)

    return run


RECTANGLE = T.StructType(
    [
        T.StructField("_k", T.StringType()),
        T.StructField("_vc", T.LongType()),
        T.StructField("_rc", T.LongType()),
        T.StructField("valid_lo", T.LongType()),
        T.StructField("valid_hi", T.LongType()),
        T.StructField("recorded_lo", T.LongType()),
        T.StructField("recorded_hi", T.LongType()),
        T.StructField("version_id", T.LongType()),
    ]
)
LOCATED = T.StructType([*RECTANGLE.fields[:1], T.StructField("_v", T.LongType()), T.StructField("_r", T.LongType()), RECTANGLE.fields[-1]])
_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64()}


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), _ARROW[f.dataType]) for x, f in zip(zip(*rows), schema)], names=schema.names)


def current_rectangles(versions: DataFrame, cells: DataFrame, cell_days: int = 182) -> DataFrame:
    """Disjoint rectangles in which one version of an entity is current.

    ``versions``: ``_k`` string, ``_v`` day number, ``_r`` microseconds, ``_id`` long.
    ``cells``: the cells wanted, ``_k, _vc, _rc``. Bounds are half open and cut at the
    cell. Ties in day and moment go to the larger id; repeated rows count once; rows
    with a null in key, day, moment or id are never current.
    """
    v = versions.select("_k", F.col("_v").cast("long").alias("_v"), "_r", F.col("_id").cast("long").alias("_id")).dropna()
    reach = v.join(cells.select("_k", "_vc", "_rc"), "_k").where((F.col("_v") < (F.col("_vc") + 1) * cell_days) & (F.col("_r") < (F.col("_rc") + 1) * cell_days * DAY_US))
    known = F.col("_r") < F.col("_rc") * cell_days * DAY_US
    before = F.col("_v") < F.col("_vc") * cell_days
    # what was known before the cell begins counts once for each day, and once for all days before the cell
    slot_v = F.when(~(known & before), F.col("_v"))
    slot_r = F.when(~known, F.col("_r"))
    folded = (
        reach.groupBy("_k", "_vc", "_rc", slot_v.alias("_sv"), slot_r.alias("_sr"))
        .agg(F.max(F.struct("_v", "_r", "_id")).alias("_b"))
        .select("_k", "_vc", "_rc", "_b.*")
    )
    return _sorted_cells(folded, "_r", "_v", "_id").mapInArrow(_sweep(cell_days), RECTANGLE)


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cell, days, held = None, [], {}
    for batch in batches:
        out = []
        for key, vc, rc, at, kind, lo, hi, end, ident in zip(*[c.to_pylist() for c in batch.columns]):
            if cell != (key, vc, rc):
                cell, days, held = (key, vc, rc), [], {}
            if kind == 0:
                if lo not in held:
                    insort(days, lo)
                held[lo] = (hi, end, ident)
                continue
            i = bisect_right(days, lo)
            if i:
                top, until, found = held[days[i - 1]]
                if lo < top and at < until:
                    out.append((key, lo, at, found))
        if out:
            yield _rows(out, LOCATED)


def locate_points(points: DataFrame, rectangles: DataFrame, cell_days: int = 182) -> DataFrame:
    """``_k, _v, _r, version_id`` of the rectangle that holds each point ``_k, _v, _r``.

    Points in no rectangle, or with a null, give no row; repeated points give one.
    """
    p = _cells(points.select("_k", F.col("_v").cast("long").alias("_v"), "_r").dropna().distinct(), "_v", "_r", cell_days)
    none = F.lit(None).cast("long")
    both = rectangles.select("_k", "_vc", "_rc", F.col("recorded_lo").alias("_at"), F.lit(0).alias("_kind"), F.col("valid_lo").alias("_lo"), F.col("valid_hi").alias("_hi"), F.col("recorded_hi").alias("_end"), "version_id").unionByName(
        p.select("_k", "_vc", "_rc", F.col("_r").alias("_at"), F.lit(1).alias("_kind"), F.col("_v").alias("_lo"), none.alias("_hi"), none.alias("_end"), none.alias("version_id"))
    )
    return _sorted_cells(both, "_at", "_kind", "_lo").mapInArrow(_locate, LOCATED)


def as_known_at(events: DataFrame, versions: DataFrame, *, key: Column, valid_day: Column, moment: Column, version_key: Column, version_day: Column, version_moment: Column, version_id: Column, cell_days: int = 182) -> DataFrame:
    """Each event with the id of the version valid and already recorded at its point.

    ``key``/``valid_day``/``moment`` are expressions over ``events`` (a string, a date
    and a timestamp), the ``version_*`` ones over ``versions``. The result is
    ``events`` with a column ``version_id``, null where nothing was known yet or where
    the event has no key, day or moment. Events keep their number of rows; their other
    columns, whatever their names, pass through untouched (a column of their own called
    ``version_id`` is replaced). Of versions recorded twice at one day and moment the
    larger id holds. Empty tables on either side give null ids.
    """
    kept = [c for c in events.columns if c != "version_id"]
    e = events.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), key.cast("string").alias("_k"), day_number(valid_day).cast("long").alias("_v"), micros(moment).alias("_r"))
    v = versions.select(version_key.cast("string").alias("_k"), day_number(version_day).alias("_v"), micros(version_moment).alias("_r"), version_id.alias("_id"))
    points = e.select("_k", "_v", "_r").dropna().distinct()
    cells = _cells(points, "_v", "_r", cell_days).select("_k", "_vc", "_rc").distinct()
    found = locate_points(points, current_rectangles(v, cells, cell_days), cell_days)
    return e.join(found, ["_k", "_v", "_r"], "left").select("_row.*", "version_id")
