"""Problem 3: consensus, agreement and reliability over gold_labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuplane.functions.normal import UNSEEN, number_key
from docuplane.llm.consensus import Consensus, latest_votes, weighted_consensus
from docuplane.session import read_table

LABELS = ("B", "N", "R")


def gold_votes(gold: DataFrame) -> DataFrame:
    """Votes on (doc_id, number); files derived from other annotators' are left out."""
    name = F.lower(F.regexp_replace("annotator", f"^(?:{UNSEEN})+|(?:{UNSEEN})+$", ""))
    own = gold.where(F.coalesce(~name.startswith("majority of"), F.lit(False)))
    letter = F.upper(F.substring(F.regexp_replace("label", UNSEEN, ""), 1, 1))
    whole = own.where(F.col("doc_id").isNotNull() & F.col("number").isNotNull())
    votes = latest_votes(whole, item=F.struct("doc_id", number_key(F.col("number")).alias("number")), annotator=F.when(name != "", name), label=letter, at=F.col("labelled_at"))
    return votes.where(F.col("label").isin(*LABELS))


def gold_consensus(spark: SparkSession, d: str) -> Consensus:
    return weighted_consensus(gold_votes(read_table(spark, d, "gold_labels")), LABELS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return gold_consensus(spark, d).items.where("n_votes >= 3 AND n_labels > 1").select("item.doc_id", "item.number", "label")


def p3_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item labelled by several annotators, with its agreement."""
    return gold_consensus(spark, d).items.where("n_votes > 1").select("item.doc_id", "item.number", "label", F.round("agreement", 6).alias("agreement"), F.round("chance_corrected", 6).alias("chance_corrected"), "n_votes")


def p3_annotators(spark: SparkSession, d: str) -> DataFrame:
    return gold_consensus(spark, d).annotators.select("annotator", F.round("reliability", 6).alias("reliability"), "n_votes")


QUERIES = {"p3_found": p3_found, "p3_items": p3_items, "p3_annotators": p3_annotators}
SQL: dict = {}
