"""The section registry: intervals, status, ranges, order, merges, and currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docuplane.operators.history import OPEN_END


def effective_intervals(records: DataFrame) -> DataFrame:
    """``number, effective_from, effective_to, removed`` from ``number, day, removed``
    records: one interval a day, removed if any record of the day is, ending on the
    day before the next; the last one is open (null)."""
    days = records.groupBy("number", "day").agg(F.coalesce(F.bool_or("removed"), F.lit(False)).alias("removed"))
    following = F.lead("day").over(W.partitionBy("number").orderBy("day"))
    return days.select("number", F.col("day").alias("effective_from"), F.date_format(F.date_sub(F.to_date(following), 1), "yyyy-MM-dd").alias("effective_to"), "removed")


def section_status(snapshots: DataFrame) -> DataFrame:
    """The last row seen of each number with its status: removed, reserved or active;
    the current date only where active. ``number, day, loaded_at, removed, reserved, clause_date, title``."""
    last = snapshots.groupBy("number").agg(F.max_by(F.struct("removed", "reserved", "clause_date", "title"), F.struct("day", "loaded_at", "snap_id")).alias("s"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    status = F.when(F.col("s.removed"), "removed").when(F.col("s.reserved"), "reserved").otherwise("active")
    return last.select("number", status.alias("status"), F.when(status == "active", F.col("s.clause_date")).alias("current_date"), F.col("s.title").alias("title"), "first_seen", "last_seen")


def natural_key(number: Column) -> Column:
    """A sort key under which 52.219-9 comes before 52.219-14 and digits before text."""
    return F.transform(F.split(number, r"[.\-]"), lambda p: F.struct((~p.rlike(r"^\d+$")).cast("int").alias("kind"), F.coalesce(p.try_cast("long"), F.lit(0)).alias("digits"), F.when(p.rlike(r"^\d+$"), "").otherwise(p).alias("text")))


_RANGE = r"^(\d{2,4}\.\d{3})-(\d{1,4})\s*[-–]\s*(\d{2,4}\.\d{3})-(\d{1,4})$"


def expand_ranges(rows: DataFrame, max_span: int = 200) -> DataFrame:
    """Rows filed under a range of one section become a row for each number in it, with
    ``source_range``; ranges over sections or too long stay as they are."""
    g = {i: F.regexp_extract("number", _RANGE, i) for i in range(1, 5)}
    lo, hi = g[2].try_cast("int"), g[4].try_cast("int")
    fits = (g[1] != "") & (g[1] == g[3]) & (hi - lo > 0) & (hi - lo < max_span)
    every = F.when(fits, F.transform(F.sequence(F.coalesce(lo, F.lit(0)), F.greatest(F.coalesce(hi, F.lit(0)), F.coalesce(lo, F.lit(0)))), lambda k: F.concat(g[1], F.lit("-"), k.cast("string")))).otherwise(F.array("number"))
    others = [c for c in rows.columns if c != "number"]
    return rows.select(F.explode(every).alias("_n"), F.when(fits, F.col("number")).alias("source_range"), *others).withColumnRenamed("_n", "number")


_RANKS = (("active", 0), ("reserved", 1), ("removed", 2))


def dedupe_numbers(rows: DataFrame) -> DataFrame:
    """One row a number, the one of best status (active, reserved, removed; of equal ones
    the lowest ``seq``), with the union of all rows' versions by first day, first seen first.

    ``number, status, seq, versions array<struct<effective_from,...>>``."""
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in _RANKS for x in kv]), F.col("status"))
    best = rows.groupBy("number").agg(F.min_by("status", F.struct(rank, "seq")).alias("status"), F.min_by("seq", F.struct(rank, "seq")).alias("seq"))
    each = rows.select("number", "seq", F.posexplode_outer("versions").alias("at", "v"))
    union = each.where("v IS NOT NULL").groupBy("number", "v.effective_from").agg(F.min_by("v", F.struct("seq", "at")).alias("v"))
    union = union.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("effective_from", "v"))).alias("s"))
    return best.join(union, "number", "left").select("number", "status", "seq", F.transform("s", lambda x: x["v"]).alias("versions"))


def merge_overlay(registry: DataFrame, overlay: DataFrame) -> DataFrame:
    """Overlay statuses on the base regulation, and rows for overlay texts that the
    registry lacks. Doing it again changes nothing.

    ``registry``: ``number, regulation, status, title``; ``overlay``: ``number, status,
    title``. Overlay rows count once a number, the first by status and title."""
    base = registry.where("status <> 'overlay_only'")
    o = overlay.where(F.col("number").rlike(r"^52\.\d{3}-\d+$")).groupBy("number").agg(F.min(F.struct(F.col("status").alias("overlay_status"), F.col("title").alias("overlay_title"))).alias("o")).select("number", "o.*")
    marked = base.join(o, "number", "left").select("number", "regulation", "status", "title", F.when(F.col("regulation") == "FAR", F.col("overlay_status")).alias("overlay_status"))
    new = o.where("overlay_status = 'text'").join(base.select("number"), "number", "left_anti")
    return marked.unionByName(new.select("number", F.lit("FAR").alias("regulation"), F.lit("overlay_only").alias("status"), F.col("overlay_title").alias("title"), "overlay_status"))


def latest_or_last_seen(latest: DataFrame, seen: DataFrame, key: str, *columns: str) -> DataFrame:
    """Every key of either side with the latest row's columns, else the last seen one's."""
    a, b = latest.select(key, F.struct(*columns).alias("_a")), seen.select(key, F.struct(*columns).alias("_b"))
    both = a.join(b, key, "full_outer").withColumn("_c", F.coalesce("_a", "_b"))
    return both.select(key, *[F.col(f"_c.{c}").alias(c) for c in columns], F.col("_a").isNotNull().alias("present"))


def version_in_force(events: DataFrame, versions: DataFrame) -> DataFrame:
    """``events`` with the ``clause_date`` in force on ``day``: of the closed intervals
    that hold the day the earliest beginning; null where none does.

    An equality join on the number with a range residue, once for each number and day
    that occur; the events get it by these two, so that no row needs an id."""
    v = versions.select("number", "valid_from", "valid_to", F.col("clause_date").alias("_cd"))
    asked = events.select("number", "day").dropna().distinct()
    hit = asked.join(v, "number").where((F.col("valid_from") <= F.col("day")) & (F.col("day") <= F.coalesce("valid_to", F.lit(OPEN_END))))
    first = hit.groupBy("number", "day").agg(F.min(F.struct("valid_from", "_cd")).alias("_f")).select("number", "day", F.col("_f._cd").alias("clause_date"))
    return events.join(first, ["number", "day"], "left").select(*events.columns, "clause_date")


def seen_on_day(intervals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``intervals`` with ``present``: whether the section is in the snapshot of the day on
    which the interval begins; null where there is no snapshot of that day at all.

    ``intervals``: ``number, effective_from``; ``snapshots``: ``number, day``."""
    seen = snapshots.select("number", F.col("day").alias("effective_from")).distinct().withColumn("_seen", F.lit(True))
    days = snapshots.select(F.col("day").alias("effective_from")).distinct().withColumn("_taken", F.lit(True))
    both = intervals.join(seen, ["number", "effective_from"], "left").join(days, "effective_from", "left")
    return both.select(*intervals.columns, F.when(F.col("_taken"), F.coalesce("_seen", F.lit(False))).alias("present"))


def currency(known: Column, cited: Column, in_force: Column) -> Column:
    """How a cited month compares with the one in force; months compare as text."""
    return F.when(~known, "not_in_registry").when(cited.isNull(), "no_date_cited").when(in_force.isNull(), "no_version_data").when(cited == in_force, "matches").when(cited < in_force, "older").otherwise("newer")


def service_currency(day: Column, has_registry: Column, cited: Column, in_force: Column, overlay_day: str = "2025-10-28") -> Column:
    """The service's order of tests: no day, overlay era, no date, no version, comparison."""
    return F.when(day.isNull() | ~has_registry, "unknown_posted_date").when(day >= overlay_day, "overlay_era_not_judged").otherwise(currency(F.lit(True), cited, in_force))
