"""The ledger of documents, from pages to ordered entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docuplane.operators import ledger as L
from docuplane.operators import registry as R
from docuplane.operators import roles as B
from docuplane.operators.citations import mentions
from docuplane.operators.sections import section_labels

# Fixed value: what is said of a document that was scanned.
SCANNED = "scanned document: no text to read"


def readable(pages: DataFrame) -> DataFrame:
    """``doc_id, warning``: every document, with a warning where all its pages are scans.

    A page whose flag is null is no scan."""
    scanned = F.bool_and(F.coalesce("scanned", F.lit(False)))
    return pages.groupBy("doc_id").agg(F.when(scanned, F.lit(SCANNED)).alias("warning"))


def scored(classified: DataFrame) -> DataFrame:
    """Mentions with ``b``, ``e`` and ``source`` from the rules' role and confidence: a role that
    binds has its confidence, one that excludes excludes with it, others bind with what is left."""
    binds = F.col("role").isin(*B.BINDING)
    excludes = F.col("role") == "EXPLICITLY_EXCLUDED"
    b = F.when(binds, F.col("confidence")).when(excludes, 0.0).otherwise(F.round(1 - F.col("confidence"), 6))
    return classified.withColumns({"b": b, "e": F.when(excludes, F.col("confidence")).otherwise(0.0), "source": F.lit("rules")})


def document_ledger(pages: DataFrame, registry: DataFrame, versions: DataFrame, posted: DataFrame) -> DataFrame:
    """Ordered ledger entries of every document, and one row with a warning for each scan.

    ``doc_id, place, number, alternate, q, tier, status, cited_date, currency, n_mentions,
    pages, warning``: entries are ordered by number and alternate; ``currency`` compares
    the month cited most with the version in force on the posting day. A scanned document
    has its warning and no entries. ``registry``: ``number, status``; ``versions``: ``number,
    valid_from, valid_to, clause_date``; ``posted``: ``doc_id, day``, one row a document.
    A document without mentions has no row. Null and empty pages are read as empty.
    """
    state = readable(pages)
    text = pages.join(state.where("warning IS NULL").select("doc_id"), "doc_id", "left_semi")
    named = B.classified(mentions(text, registry), section_labels(text))
    own = scored(named).where(~F.col("from_range"))
    q = L.ledger_probabilities(own, "max")
    facts = own.groupBy(*L.KEY).agg(F.count(F.lit(1)).alias("n_mentions"), F.array_sort(F.collect_set("page")).alias("pages"), F.first("registry_status").alias("status"))
    entries = q.withColumn("alternate", F.coalesce("alternate", F.lit(""))).join(facts.withColumn("alternate", F.coalesce("alternate", F.lit(""))), [*L.KEY])
    dated = entries.join(L.most_cited(own), ["doc_id", "number"], "left").join(posted.select("doc_id", "day"), "doc_id", "left")
    judged = R.version_in_force(dated, versions).withColumn("currency", R.service_currency(F.col("day"), F.lit(True), F.col("cited_date"), F.col("clause_date")))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("number", "alternate"))
    out = judged.select("doc_id", place.alias("place"), "number", "alternate", F.round("q", 6).alias("q"), L.tier(F.col("q")).alias("tier"), "status", "cited_date", "currency", "n_mentions", "pages", F.lit(None).cast("string").alias("warning"))
    none = {c: F.lit(None).cast(out.schema[c].dataType) for c in out.columns if c not in ("doc_id", "warning")}
    return out.unionByName(state.where("warning IS NOT NULL").withColumns(none).select(*out.columns))
