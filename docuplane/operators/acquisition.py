"""Notices and files: latest rows, duplicates, eligibility, caps, balanced selection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Hints in file names.
STRONG_HINTS = ("solicitation", "rfp", "rfq", "ifb", "combined", "synopsis", "1449", "sf33", "sf-33", "sf 33", "sf18", "sf-18", "clauses", "provisions", "section", "terms", "52.2", "252.2", "far", "dfars")
WEAK_HINTS = ("sow", "pws", "statement of work", "performance work", "attachment", "addendum", "instructions")
NEGATIVE_HINTS = ("drawing", "dwg", "map", "photo", "wage", "determination", "price", "pricing", "bid schedule", "q&a", "questions", "past performance", "sign in", "sign-in")
# Departments by the first part of an agency path, and components of one of them.
DEPARTMENTS = {
    "DEPT OF DEFENSE": "DOD_OTHER", "VETERANS AFFAIRS, DEPARTMENT OF": "VA", "GENERAL SERVICES ADMINISTRATION": "GSA", "HOMELAND SECURITY, DEPARTMENT OF": "DHS", "HEALTH AND HUMAN SERVICES, DEPARTMENT OF": "HHS",
    "ENERGY, DEPARTMENT OF": "DOE", "NATIONAL AERONAUTICS AND SPACE ADMINISTRATION": "NASA", "AGRICULTURE, DEPARTMENT OF": "USDA", "INTERIOR, DEPARTMENT OF THE": "DOI", "JUSTICE, DEPARTMENT OF": "DOJ", "TRANSPORTATION, DEPARTMENT OF": "DOT",
}
COMPONENTS = {"DEPT OF THE ARMY": "DOD_ARMY", "DEPT OF THE NAVY": "DOD_NAVY", "DEPT OF THE AIR FORCE": "DOD_AIR_FORCE", "DEFENSE LOGISTICS AGENCY (DLA)": "DOD_DLA", "DEFENSE LOGISTICS AGENCY": "DOD_DLA"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def department(agency: Column) -> Column:
    """The top department of a dotted agency path; OTHER where unknown or null."""
    parts = F.transform(F.split(F.upper(agency), r"\."), lambda p: F.trim(p))
    top, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(top.isin("DEPT OF DEFENSE", "DEPARTMENT OF DEFENSE") & second.isNotNull(), F.coalesce(_lookup(COMPONENTS, second), F.lit("DOD_OTHER"))).otherwise(F.coalesce(_lookup(DEPARTMENTS, top), F.lit("OTHER")))


def hint_score(filename: Column) -> Column:
    """How likely a file name is that of a main document: 3 a strong hint, 1 a weak one, -2 a negative one."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    parts = [F.when(name.contains(h), w).otherwise(0) for hints, w in ((STRONG_HINTS, 3), (WEAK_HINTS, 1), (NEGATIVE_HINTS, -2)) for h in hints]
    return sum(parts[1:], parts[0])


def extension(filename: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(filename, F.lit(""))), r"[^/.](\.[^/.]+)$", 1)


def ineligible(filename: Column, size: Column, url: Column, kept: tuple[str, ...], max_bytes: int) -> Column:
    """Why a file is not fetched, in order: extension, too_large, empty, no_url; null if it is."""
    ext = extension(filename)
    return F.when((ext != "") & ~ext.isin(*kept), "extension").when(size > max_bytes, "too_large").when(size == 0, "empty").when(F.coalesce(url, F.lit("")) == "", "no_url")


def latest_notice(notices: DataFrame) -> DataFrame:
    """The latest notice of each solicitation (day, then id), and how many there are.

    The lineage itself stays a column of ordered ranks in ``notice_lineage``."""
    order = F.struct("posted_date", "notice_id")
    return notices.where(F.col("solicitation_number").isNotNull()).groupBy("solicitation_number").agg(F.max_by("notice_id", order).alias("notice_id"), F.max("posted_date").alias("posted_date"), F.countDistinct("notice_id").alias("n_notices"))


def notice_lineage(notices: DataFrame) -> DataFrame:
    """``solicitation_number, step, notice_id``: a solicitation's notices in order."""
    distinct = notices.where(F.col("solicitation_number").isNotNull()).groupBy("solicitation_number", "notice_id").agg(F.min("posted_date").alias("posted_date"))
    return distinct.select("solicitation_number", F.row_number().over(W.partitionBy("solicitation_number").orderBy(F.col("posted_date").asc_nulls_first(), "notice_id")).alias("step"), "notice_id", "posted_date")


def first_stored(files: DataFrame, key: str, *order: str) -> DataFrame:
    """Files with ``seen_before``: whether an earlier row has the same key.

    The first row is an aggregate, so a hot key is folded before the shuffle."""
    first = files.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return files.join(first, key).withColumn("seen_before", F.struct(*order) != F.col("_first")).drop("_first")


def _greedy(max_files: int, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken, total = None, 0, 0
        for b in batches:
            verdicts = []
            for g, size in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if g != group:
                    group, taken, total = g, 0, 0
                if taken >= max_files:
                    verdicts.append("over_file_cap")
                elif total + (size or 0) > max_bytes:
                    verdicts.append("over_notice_bytes")
                else:
                    verdicts.append(None)
                    taken, total = taken + 1, total + (size or 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(verdicts, pa.string())], names=["grp", "file", "bytes", "reason"])

    return run


def capped_files(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """``grp, file, bytes, reason``: files of each group taken from the best score down
    until ``max_files``; one that does not fit the byte budget is passed over.

    What is passed over adds nothing, so this is no running sum: sorted rows are
    streamed with a count and a total for the open group. Ties: larger, then by name."""
    rows = files.select(F.col("grp"), F.col("file"), F.col("bytes").cast("long").alias("bytes"), hint_score(F.col("file")).alias("_s"))
    ordered = rows.repartition("grp").sortWithinPartitions("grp", F.col("_s").desc(), F.coalesce("bytes", F.lit(0)).desc(), "file")
    return ordered.select("grp", "file", "bytes").mapInArrow(_greedy(max_files, max_bytes), f"grp {files.schema['grp'].dataType.simpleString()}, file string, bytes long, reason string")


def _round_robin(target: int, cap: int):
    """Rounds over the months, one notice a month and round; a notice whose department is
    full is passed over for the month's next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        months: dict[str, list] = {}
        for b in batches:
            for ident, month, dept in zip(*(b.column(i).to_pylist() for i in range(3))):
                months.setdefault(month, []).append((ident, dept))
        queues = [iter(months[m]) for m in sorted(months)]
        taken: dict = {}
        chosen: list = []
        while queues and len(chosen) < target:
            left = []
            for q in queues:
                found = next((x for x in q if taken.get(x[1], 0) < cap), None)
                if found is None:
                    continue
                left.append(q)
                if len(chosen) < target:
                    taken[found[1]] = taken.get(found[1], 0) + 1
                    chosen.append(found[0])
            queues = left
        yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.string()), pa.array(range(len(chosen)), pa.int32())], names=["notice_id", "rank"])

    return run


def balanced_selection(notices: DataFrame, target: int, max_share: float, seed: int = 0) -> DataFrame:
    """``notice_id, month, department, rank, selected``: round-robin over months with a cap
    on each department of ``max_share * target``.

    A round takes one notice of each month in the order of a seeded hash; one whose
    department is full is passed over. The rounds follow one another, so one task runs
    them, over no more than the first ``max_share * target`` notices of each month and
    department, which is all that rounds can take: its input is bounded by the target,
    not by the notices."""
    cap = int(max_share * target)
    key = F.xxhash64("notice_id", F.lit(seed))
    rows = notices.select(F.col("notice_id").cast("string").alias("notice_id"), "month", "department").distinct()
    near = rows.withColumn("_k", F.row_number().over(W.partitionBy("month", "department").orderBy(key, "notice_id"))).where(F.col("_k") <= cap)
    ordered = near.withColumn("_h", key).repartition(1).sortWithinPartitions("month", "_h", "notice_id")
    chosen = ordered.select("notice_id", "month", "department").mapInArrow(_round_robin(target, cap), "notice_id string, rank int")
    return rows.join(chosen, "notice_id", "left").withColumn("selected", F.col("rank").isNotNull())


def last_wins(journal: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key of an append-only journal."""
    others = [c for c in journal.columns if c != key]
    return journal.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_l")).select(key, "_l.*")
