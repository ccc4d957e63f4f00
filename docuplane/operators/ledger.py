"""From mentions to a ledger: which numbers a document binds, how surely, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("doc_id", "number", "alternate")


def excluded_numbers(mentions: DataFrame, excluded: Column) -> DataFrame:
    """Numbers of a document with an excluding mention; they veto all its alternates."""
    return mentions.where(excluded).select("doc_id", "number").distinct()


def binding_ledger(mentions: DataFrame, binding: Column, excluded: Column) -> DataFrame:
    """Entries by (document, number, alternate): mentions, roles, least confidence, pages.

    ``mentions``: ``role, confidence, page, from_range``. Range copies make no entry.
    """
    kept = mentions.where(binding & ~F.coalesce("from_range", F.lit(False))).join(excluded_numbers(mentions, excluded), ["doc_id", "number"], "left_anti")
    return kept.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("role")).alias("roles"), F.min("confidence").alias("confidence"), F.array_sort(F.collect_set("page")).alias("pages"))


def ledger_probabilities(mentions: DataFrame, mode: str = "noisy_or") -> DataFrame:
    """``q`` of each entry: the chance that a mention binds, times the chance that no
    mention of the number, under whatever alternate, excludes it.

    ``mentions``: the key, ``b`` and ``e``. ``mode``: 'noisy_or' takes mentions as
    independent, 'max' the surest one. One shuffle: entries are folded by map-side
    aggregates, and the number's product is a window over its few alternates.
    """
    if mode not in ("noisy_or", "max"):
        raise ValueError(mode)
    entries = mentions.groupBy(*KEY).agg(F.product(1 - F.col("b")).alias("_none"), F.max("b").alias("_max"), F.product(1 - F.coalesce("e", F.lit(0.0))).alias("_kept"))
    number = W.partitionBy("doc_id", "number")
    kept = F.aggregate(F.collect_list("_kept").over(number), F.lit(1.0), lambda a, x: a * x)
    base = 1 - F.col("_none") if mode == "noisy_or" else F.col("_max")
    return entries.select(*KEY, (base * kept).alias("q"))


def tier(q: Column, high: float = 0.7, low: float = 0.3) -> Column:
    return F.when(q >= high, "BINDING").when(q <= low, "NOT_BINDING").otherwise("UNDETERMINED")


def verdict(q: Column, t: float) -> Column:
    """True from t on, false up to 1 - t, null between."""
    if t < 0.5:
        raise ValueError("t must be at least 0.5")
    return F.when(q >= t, F.lit(True)).when(q <= 1 - t, F.lit(False))


def number_features(mentions: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """One row a document and number: both probabilities, counts by source, means and the largest score of each role."""
    entries = mentions.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("source") == "model").alias("n_model"),
        F.count_if(F.col("source") != "model").alias("n_rule"),
        F.sum("b").alias("_sum"),
        F.count("b").alias("_with"),
        F.min("b").alias("bp_min"),
        F.max("b").alias("_max"),
        F.product(1 - F.col("b")).alias("_none"),
        F.product(1 - F.coalesce("e", F.lit(0.0))).alias("_kept"),
        *[F.max(F.when(F.col("role") == r, F.col("b"))).alias(f"max_{r.lower()}") for r in roles],
    )
    # what excludes a number is the same for all its alternates, so it comes out of the maximum
    kept = F.product("_kept")
    return entries.groupBy("doc_id", "number").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_model", "n_rule")],
        F.try_divide(F.sum("_sum"), F.sum("_with")).alias("bp_mean"),
        F.min("bp_min").alias("bp_min"),
        *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in (f"max_{r.lower()}" for r in roles)],
        (F.max("_max") * kept).alias("qmax"),
        (F.max(1 - F.col("_none")) * kept).alias("qnor"),
    )


def decided_by(mentions: DataFrame) -> DataFrame:
    """'model' where any mention of the entry is the model's, else its first mention's source."""
    return mentions.groupBy(*KEY).agg(F.when(F.bool_or(F.col("source") == "model"), "model").otherwise(F.min_by("source", "ordinal")).alias("decided_by"))


def evidence(mentions: DataFrame, k: int = 5, width: int = 200) -> DataFrame:
    """The first k mentions of each entry, in order, with their text cut to ``width``: a top-k report.

    Ranks first, so that an entry's mentions are never gathered."""
    rank = F.row_number().over(W.partitionBy(*KEY).orderBy("ordinal"))
    first = mentions.withColumn("k", rank).where(F.col("k") <= k)
    return first.select(*KEY, "k", F.round("b", 4).alias("p"), "source", F.substring("line_text", 1, width).alias("text"))


def most_cited(mentions: DataFrame, value: str = "cited_date") -> DataFrame:
    """The value cited most for each document and number; of equally frequent ones the smallest."""
    counts = mentions.where(F.col(value).isNotNull()).groupBy("doc_id", "number", value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("doc_id", "number").agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value))).alias(value))


def preceding_headings(lines: DataFrame, k: int = 3) -> DataFrame:
    """For each line the last k headings strictly before it in its document, oldest first.

    ``lines``: ``doc_id, page, line_no, heading`` (null where a line is none)."""
    before = W.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(W.unboundedPreceding, -1)
    # a heading's own chain is itself and the chain before it, one longer in each of k windows over one sort
    chained = lines.select("doc_id", "page", "line_no", "heading").withColumn("_c", F.array().cast("array<string>"))
    for _ in range(k):
        own = F.when(F.col("heading").isNotNull(), F.concat("_c", F.array("heading")))
        chained = chained.withColumn("_h", own).withColumn("_c", F.coalesce(F.last("_h", ignorenulls=True).over(before), F.array().cast("array<string>")))
    n = F.size("_c")
    return chained.select("doc_id", "page", "line_no", F.when(n > k, F.slice("_c", n - k + 1, F.lit(k))).otherwise(F.col("_c")).alias("breadcrumb"))


def context_window(lines: DataFrame, before: int = 5, after: int = 2, partition: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Each line with its non-blank neighbours, joined by ' | '."""
    order = W.partitionBy(*partition).orderBy("line_no")
    parts = [F.lag("line", i).over(order) for i in range(before, 0, -1)] + [F.col("line")] + [F.lead("line", i).over(order) for i in range(1, after + 1)]
    return lines.withColumn("context", F.array_join(F.filter(F.array(*parts), lambda x: F.trim(x) != ""), " | "))


def first_on_line(mentions: DataFrame) -> DataFrame:
    """The first mention of each line; ties of range copies go to the lower ordinal."""
    rank = F.row_number().over(W.partitionBy("doc_id", "page", "line_no").orderBy("char_start", "ordinal"))
    return mentions.withColumn("_r", rank).where("_r = 1").drop("_r")
