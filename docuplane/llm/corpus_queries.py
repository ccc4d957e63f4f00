"""Problems 7, 8 and 9 over documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuplane.functions.normal import label_name
from docuplane.llm.leakage import leaked_passages
from docuplane.llm.mixture import mixed_copies
from docuplane.llm.truncation import truncated_texts
from docuplane.session import read_table

#: Where the public tokenizers' files are.
TOKENIZERS = os.environ.get("DOCUPLANE_TOKENIZERS", "/opt/tokenizers")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document with passages of items, exact phrases and near ones."""
    return leaked_passages(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"), proximity=False).select("doc_id", "item_id")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixed_copies(
        read_table(spark, d, "documents"),
        read_table(spark, d, "mix_targets"),
        doc_id="doc_id",
        text="text",
        source=label_name(F.col("source")),
        target_source=label_name(F.col("source")),
        tokenizer=f"{TOKENIZERS}/byte_bpe_50k.tiktoken",
    )


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: a row for each copy of a document."""
    mix, _ = _mix(spark, d)
    return mix.select(F.col("id").alias("doc_id"), "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, d)[1]


def p9_states(spark: SparkSession, d: str) -> DataFrame:
    return truncated_texts(read_table(spark, d, "documents"), source=label_name(F.col("source")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_states(spark, d).where("truncated").select(F.col("id").alias("doc_id")).distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return p9_states(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("truncated").alias("n_truncated"), F.round(F.avg(F.col("truncated").cast("double")), 6).alias("rate"))


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_rates": p9_rates}
_WINDOWS = r"(SELECT {0} AS id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) AS g FROM (SELECT {0}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {1} WHERE text IS NOT NULL) WHERE len(w) >= 12)"
SQL = {"p7_found": f"SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM {_WINDOWS.format('doc_id', 'documents')} d JOIN {_WINDOWS.format('item_id', 'eval_items')} i ON d.g = i.g"}
