"""Consensus labels from several annotators by iteratively reweighted voting.

Each round alternates a weighted consensus of every item with a leave-one-out
estimate of every annotator's accuracy: a vote is held against the consensus of the
item's other votes only, and what that consensus' own doubt takes from the agreement is
given back. Accuracies are smoothed towards the mean of all annotators and turned into
log-odds weights. A round is one window over the item and one
aggregate over the annotator, both distributed; an annotator's or an item's votes are
never gathered, and only one number, the largest change, reaches the driver.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docuplane.session import stage_table


@dataclass(frozen=True)
class Consensus:
    """``items``: ``item, label, agreement, chance_corrected, n_votes, n_labels``;
    ``annotators``: ``annotator, reliability, weight, n_votes``;
    ``votes``: ``item, annotator, label``, as counted."""

    items: DataFrame
    annotators: DataFrame
    votes: DataFrame


def latest_votes(rows: DataFrame, *, item: Column, annotator: Column, label: Column, at: Column) -> DataFrame:
    """``item, annotator, label``: the label given last; of labels given at one moment
    the last by name. Rows without an item or an annotator are left out, a null moment
    counts as the earliest, and an item whose last label is null has no such vote."""
    r = rows.select(item.alias("item"), annotator.alias("annotator"), F.struct(F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(-(2**62))).alias("at"), label.alias("label")).alias("v"))
    last = r.where(F.col("annotator").isNotNull() & F.col("item").isNotNull()).groupBy("item", "annotator").agg(F.max("v").alias("v"))
    return last.select("item", "annotator", F.col("v.label").alias("label")).where(F.col("label").isNotNull())


def _scores(votes: DataFrame, weights: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    item = W.partitionBy("item")
    own = votes.join(weights.select("annotator", "weight"), "annotator")
    return own.select("*", *[F.sum(F.when(F.col("label") == x, F.col("weight")).otherwise(0.0)).over(item).alias(f"_s{k}") for k, x in enumerate(labels)])


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    powers = [F.exp(s - top) for s in scores]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def weighted_consensus(votes: DataFrame, labels: tuple[str, ...], *, smoothing: float = 10.0, start: float = 0.7, tolerance: float = 1e-4, max_rounds: int = 15) -> Consensus:
    """Consensus, agreement and reliability from ``item, annotator, label`` votes.

    Votes outside ``labels`` are no votes; repeated votes count once. An item with one
    vote takes it as its label; its agreement is null. Equal scores go to the label
    first in ``labels``. ``reliability`` is the smoothed leave-one-out accuracy;
    ``chance_corrected`` of an item is its pairwise agreement above the agreement
    expected by chance over all pairable votes (nominal alpha, which takes missing
    ratings), null where it has one vote. No votes give two empty tables. A warning tells
    if reliabilities had not settled within ``max_rounds``.
    """
    k = len(labels)
    n = F.count(F.lit(1)).over(W.partitionBy("item"))
    votes = stage_table(votes.where(F.col("label").isin(*labels)).select("item", "annotator", "label").distinct().withColumn("n", n), "votes")
    prior_row = votes.agg(*[F.sum(F.when(F.col("label") == x, 1).otherwise(0)).alias(f"c{i}") for i, x in enumerate(labels)]).first()
    counts = [(c or 0) + 1.0 for c in prior_row]
    prior = [F.log(F.lit(c / sum(counts))) for c in counts]

    def weight(accuracy: Column) -> Column:
        a = F.least(F.greatest(accuracy, F.lit(0.02)), F.lit(0.98))
        return F.log(F.lit(float(k - 1)) * a / (F.lit(1.0) - a))

    counted = votes.groupBy("annotator").agg(F.count(F.lit(1)).alias("n_votes"))
    people = stage_table(counted.select("annotator", F.lit(start).alias("reliability"), weight(F.lit(start)).alias("weight"), "n_votes"), "annotators")
    for _ in range(max_rounds):
        scored = _scores(votes.where("n > 1"), people, labels)
        others = _softmax([F.col(f"_s{i}") - F.when(F.col("label") == x, F.col("weight")).otherwise(0.0) + prior[i] for i, x in enumerate(labels)])
        met = F.coalesce(*[F.when(F.col("label") == x, others[i]) for i, x in enumerate(labels)])
        sure = sum((p * p for p in others[1:]), others[0] * others[0])
        by_chance = (1 - sure) / F.lit(float(k - 1))
        # what a vote adds above the chance to meet a doubtful consensus, and what a perfect annotator's would
        held = stage_table(scored.groupBy("annotator").agg(F.sum(met - by_chance).alias("_c"), F.sum(sure - by_chance).alias("_n")), "held")
        totals = held.agg(F.sum("_c").alias("c"), F.sum("_n").alias("n")).first()
        mean_value = totals["c"] / totals["n"] if totals["n"] else start
        updated = (
            people.join(held, "annotator", "left")
            .select(
                "annotator",
                F.col("reliability").alias("_before"),
                F.least(F.greatest((F.coalesce("_c", F.lit(0.0)) + smoothing * mean_value) / (F.coalesce("_n", F.lit(0.0)) + smoothing), F.lit(0.0)), F.lit(1.0)).alias("reliability"),
                "n_votes",
            )
            .withColumn("weight", weight(F.col("reliability")))
        )
        people = stage_table(updated, "annotators")
        change = people.agg(F.max(F.abs(F.col("reliability") - F.col("_before"))).alias("m")).first()["m"]
        people = people.drop("_before")
        if change is None or change < tolerance:
            break
    else:
        warnings.warn(f"reliabilities still changed by {change:.2g} after {max_rounds} rounds", RuntimeWarning, stacklevel=2)
    whole = _scores(votes, people, labels)
    item_votes = whole.groupBy("item").agg(
        *[F.first(f"_s{i}").alias(f"_s{i}") for i in range(k)],
        *[F.sum(F.when(F.col("label") == x, 1).otherwise(0)).alias(f"_c{i}") for i, x in enumerate(labels)],
        F.count(F.lit(1)).alias("n_votes"),
    )
    scores = [F.col(f"_s{i}") + prior[i] for i in range(k)]
    cells = [F.col(f"_c{i}") for i in range(k)]
    same = sum((c * (c - 1) for c in cells[1:]), cells[0] * (cells[0] - 1))
    agreement = F.when(F.col("n_votes") > 1, same / (F.col("n_votes") * (F.col("n_votes") - 1)))
    paired = votes.where("n > 1").agg(*[F.sum(F.when(F.col("label") == x, 1).otherwise(0)).alias(f"c{i}") for i, x in enumerate(labels)]).first()
    pairable = [float(c or 0) for c in paired]
    total = sum(pairable)
    expected = sum(c * (c - 1) for c in pairable) / (total * (total - 1)) if total > 1 else 1.0
    items = item_votes.select(
        "item",
        F.coalesce(*[F.when(s == F.greatest(*scores), F.lit(x)) for s, x in zip(scores, labels)]).alias("label"),
        agreement.alias("agreement"),
        (F.when(F.lit(expected < 1.0), (agreement - expected) / (1.0 - min(expected, 0.999999)))).alias("chance_corrected"),
        "n_votes",
        sum((F.when(c > 0, 1).otherwise(0) for c in cells[1:]), F.when(cells[0] > 0, 1).otherwise(0)).alias("n_labels"),
    )
    return Consensus(items, people, votes)
