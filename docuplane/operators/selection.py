"""Joins that must match, lookups with a default, ordered picks and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def must_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join on ``key``; a left row without a match fails the query when it runs."""
    marked = right.withColumn("_met", F.lit(True))
    joined = left.join(marked, key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no match for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.where(F.when(F.col("_met"), F.lit(True)).otherwise(missing.cast("boolean"))).drop("_met")


def with_default(rows: DataFrame, lookup: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """``rows`` with the looked-up value, ``default`` where the key or its value is missing.

    A key given several times counts with its smallest value."""
    one = lookup.groupBy(key).agg(F.min(value).alias(value))
    return rows.join(one, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def in_months(rows: DataFrame, day: str, first: str, last: str, links: str | None = None) -> DataFrame:
    """Rows of the months ``first`` to ``last`` (``YYYY-MM``, compared as text), with links if a count of them is named."""
    month = F.substring(day, 1, 7)
    return rows.where(month.between(first, last) & (F.col(links) > 0 if links else F.lit(True)))


def safe_view(attributes: Column, kept: tuple[str, ...]) -> Column:
    """A map with the named keys only."""
    return F.map_filter(attributes, lambda k, v: k.isin(*kept))


def evenly_spaced(rows: DataFrame, k: int, by: str, *order: str) -> DataFrame:
    """At most ``k`` rows of each group, evenly spaced over its order, first and last among them."""
    over = W.partitionBy(by)
    placed = rows.withColumns({"_i": F.row_number().over(over.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(over)})
    # the step that ends at row i passes a multiple of (n - 1) / (k - 1)
    near = F.ceil(F.col("_i") * (k - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    picked = F.floor(near * (F.col("_n") - 1) / (k - 1)) == F.col("_i")
    return placed.where((F.col("_n") <= k) | picked).drop("_i", "_n")


def top_list(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties by value: a top-k report."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def capped_by_group(rows: DataFrame, per_stratum: int, per_department: int, seed: int = 0) -> DataFrame:
    """``doc_id, stratum, department``: a pick of at most so many rows of each stratum, of
    which at most so many are of one department, in the order of a hash.

    Ranks are windows by stratum and department and by stratum; a department's surplus
    is out before the stratum is counted, so no row waits for another one's turn."""
    draw = F.xxhash64("doc_id", F.lit(seed))
    own = F.row_number().over(W.partitionBy("stratum", "department").orderBy(draw, "doc_id"))
    kept = rows.withColumn("_k", own).where(F.col("_k") <= per_department)
    place = F.row_number().over(W.partitionBy("stratum").orderBy(draw, "doc_id"))
    return kept.withColumn("_p", place).where(F.col("_p") <= per_stratum).select("doc_id", "stratum", "department")
