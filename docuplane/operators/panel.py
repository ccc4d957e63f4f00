"""Panels of judges against each other and against systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuplane.operators.evaluation import ratio

KEY = ("doc_id", "number")


def labelled_universe(mentions: DataFrame) -> DataFrame:
    """The numbers that have a mention the model decided."""
    return mentions.where(F.col("source") == "model").select(*KEY).distinct()


def gold_with_system(gold: DataFrame, system: DataFrame, universe: DataFrame) -> DataFrame:
    """Gold items of the universe with the system's ``q``, 0 where it has no entry.

    ``gold``: key and ``label``; ``system``: key and ``q``, unique by key."""
    return gold.join(universe, [*KEY], "left_semi").join(system.select(*KEY, "q"), [*KEY], "left").withColumn("q", F.coalesce("q", F.lit(0.0)))


def judge_agreement(pairs: DataFrame, a: Column, b: Column, undecided: str = "U") -> DataFrame:
    """One row: items, items on which either is undecided, agreement and Cohen's kappa of the
    labels where both decide, and the binary kappa of the label B against all others.

    Kappa is 1 where chance agreement is, and null where nothing is decided."""
    p = pairs.select(a.alias("a"), b.alias("b"))
    open_ = (F.col("a") == undecided) | (F.col("b") == undecided)
    cells = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))  # as many as pairs of labels
    both = cells.where(~open_)
    total = F.sum("n")
    by_a = both.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    by_b = both.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = by_a.join(by_b, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("pe_n"))
    is_a, is_b = F.col("a") == "B", F.col("b") == "B"
    sums = cells.agg(
        F.coalesce(total, F.lit(0)).alias("n_items"),
        F.coalesce(F.sum(F.when(open_, F.col("n"))), F.lit(0)).alias("n_open"),
        F.coalesce(F.sum(F.when(~open_, F.col("n"))), F.lit(0)).alias("n_decided"),
        F.coalesce(F.sum(F.when(~open_ & (F.col("a") == F.col("b")), F.col("n"))), F.lit(0)).alias("n_same"),
        F.coalesce(F.sum(F.when(~open_ & (is_a == is_b), F.col("n"))), F.lit(0)).alias("n_same2"),
        F.coalesce(F.sum(F.when(~open_ & is_a, F.col("n"))), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum(F.when(~open_ & is_b, F.col("n"))), F.lit(0)).alias("n_b"),
    )
    one = sums.join(F.broadcast(chance))
    n = F.col("n_decided").cast("double")
    po, pe = F.col("n_same") / n, F.col("pe_n") / (n * n)
    po2, pe2 = F.col("n_same2") / n, (F.col("n_a") * F.col("n_b") + (n - F.col("n_a")) * (n - F.col("n_b"))) / (n * n)

    def kappa(o: Column, e: Column) -> Column:
        return F.when(n > 0, F.when(e == 1, F.lit(1.0)).otherwise((o - e) / (1 - e)))

    return one.select("n_items", "n_open", "n_decided", F.when(n > 0, F.round(po, 6)).alias("agreement"), F.round(kappa(po, pe), 6).alias("kappa"), F.round(kappa(po2, pe2), 6).alias("kappa_binding"))


def accuracy_ceiling(votes: DataFrame) -> DataFrame:
    """``voter, n, accuracy``: how often a voter agrees with what two others agree on.

    ``votes``: ``item, voter, label``, one a voter and item. Items are folded to counts of
    their labels, so that no item's votes are gathered."""
    counts = votes.groupBy("item", "label").agg(F.count(F.lit(1)).alias("k"))
    mine = votes.join(counts, ["item", "label"])
    # without the voter's own vote
    best = votes.select("item", "voter", F.col("label").alias("own")).join(counts, "item").withColumn("k", F.col("k") - (F.col("own") == F.col("label")).cast("int")).where("k >= 2")
    reference = best.groupBy("item", "voter").agg(F.max_by("label", F.struct("k", "label")).alias("reference"), F.count(F.lit(1)).alias("sides")).where("sides = 1")
    judged = mine.join(reference, ["item", "voter"])
    return judged.groupBy("voter").agg(F.count(F.lit(1)).alias("n"), F.round(ratio(F.count_if(F.col("label") == F.col("reference")), F.count(F.lit(1))), 6).alias("accuracy"))


def errors(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Rows on which a system and the panel differ, with the kind of error."""
    kind = F.when(predicted & ~actual, "false_positive").when(~predicted & actual, "false_negative")
    return rows.withColumn("error", kind).where(F.col("error").isNotNull())
