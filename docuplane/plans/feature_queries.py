"""Queries of the feature and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuplane.operators import citations as T
from docuplane.operators import features as X
from docuplane.session import read_table, ship_package
from docuplane.streaming.ingest import windowed_counts_of


def mention_features(spark: SparkSession, d: str) -> DataFrame:
    """Sums of each feature over all mentions of the pages."""
    pages = read_table(spark, d, "page_texts")
    f = X.mention_features(T.mentions(pages), T.page_lines(pages))
    return f.select(F.explode("features").alias("feature", "value")).groupBy("feature").agg(F.round(F.sum("value"), 6).alias("total"), F.count_if(F.col("value") > 0).alias("n"))


def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """How many titles have each run of characters, and how often it occurs."""
    t = read_table(spark, d, "registry_snapshots").select("snap_id", "title").distinct()
    g = t.select("snap_id", F.explode(X.char_ngrams(F.col("title"))).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("snap_id").alias("n_titles"))


def ngram_weights(spark: SparkSession, d: str) -> DataFrame:
    """Length and largest weight of each distinct title's vector."""
    t = read_table(spark, d, "registry_snapshots").select("title").distinct()
    v = X.tfidf(t, "title", X.char_ngrams(F.col("title")))
    return v.groupBy(F.col("id").alias("title")).agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"), F.round(F.max("weight"), 6).alias("top"))


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    w = windowed_counts_of(spark, d, "events.parquet")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


_GRAMS = """
t AS (SELECT DISTINCT snap_id, title FROM registry_snapshots),
w AS (SELECT snap_id, ' ' || unnest(list_filter(string_split_regex(lower(title), '[\\s\\p{Z}]+'), lambda x: x <> '')) || ' ' AS word FROM t),
g AS (SELECT snap_id, substring(word, i, n) AS gram FROM (SELECT *, unnest(range(1, length(word) - n + 2)) AS i FROM (SELECT *, unnest([2, 3, 4]) AS n FROM w) WHERE length(word) >= n))
"""
QUERIES = {"mention_features": mention_features, "char_ngrams": char_ngrams, "ngram_weights": ngram_weights, "stream_event_windows": stream_event_windows}
SQL = {
    "char_ngrams": f"WITH {_GRAMS} SELECT gram, count(*) AS n, count(DISTINCT snap_id) AS n_titles FROM g GROUP BY ALL",
    "ngram_weights": f"WITH {_GRAMS.replace('SELECT DISTINCT snap_id, title FROM', 'SELECT DISTINCT title AS snap_id, title FROM')}, f AS (SELECT snap_id, gram, 1 + ln(count(*)) AS tf FROM g GROUP BY ALL), i AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM t)) / (1.0 + count(*))) + 1 AS idf FROM f GROUP BY ALL HAVING count(*) >= 3), v AS (SELECT snap_id, tf * idf AS x FROM f JOIN i USING (gram)) SELECT snap_id AS title, count(*) AS n_terms, 1.0::DOUBLE AS norm, round(max(x) / sqrt(sum(x * x)), 6) AS top FROM v GROUP BY ALL",
    "stream_event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
