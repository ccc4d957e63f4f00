"""Problems 4, 5 and 6 over page_texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuplane.functions.normal import label_name
from docuplane.llm.neardup import NearDuplicates, Signature, all_pairs, group_ids, near_duplicates
from docuplane.llm.overlap import cross_split_overlap, member_pairs
from docuplane.llm.pagenoise import page_defects, repaired_pages
from docuplane.llm.shingles import exact_jaccard
from docuplane.session import read_table, shuffles_dropped, stage_table

#: Three-word runs and 0.6, as the problem states them.
PAGE_SHAPE = Signature(width=3, min_words=30)
PAGE_THRESHOLD = 0.6


def duplicate_pages(spark: SparkSession, d: str) -> NearDuplicates:
    return near_duplicates(read_table(spark, d, "page_texts"), id_col="page_id", text_col="text_plain", threshold=PAGE_THRESHOLD, shape=PAGE_SHAPE)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return all_pairs(duplicate_pages(spark, d)).select(F.col("id_a").alias("page_id_a"), F.col("id_b").alias("page_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every page with its group and the number of classes it is linked to."""
    found = duplicate_pages(spark, d)
    ends = found.links.select(F.col("id_a").alias("rep")).unionAll(found.links.select(F.col("id_b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    members = found.members.join(group_ids(found.links), "rep", "left").join(ends, "rep", "left")
    return members.select(F.col("id").alias("page_id"), F.coalesce("grp", "rep").alias("group_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def split_pages(pages: DataFrame, splits: DataFrame) -> DataFrame:
    """``page_id, doc_id, split, side``: side a is train, b is evaluation."""
    frozen = splits.select("doc_id", label_name(F.col("split")).alias("split")).dropna().distinct()
    frozen = frozen.withColumn("side", F.when(F.col("split") == "train", "a").when(F.col("split").isin("dev", "test", "holdout"), "b")).where(F.col("side").isNotNull())
    return pages.select("page_id", "doc_id").join(frozen, "doc_id")


def leaked_pages(spark: SparkSession, d: str) -> DataFrame:
    """``id_a`` of a train page, ``id_b`` of an evaluation page, nearly the same, with the
    fractions of each that lie in chunks of both."""
    pages = read_table(spark, d, "page_texts")
    sides = split_pages(pages, read_table(spark, d, "doc_splits")).select(F.col("page_id").alias("id"), "side")
    found = cross_split_overlap(pages, sides, id_col="page_id", text_col="text_plain", min_overlap=0.2, min_words=PAGE_SHAPE.min_words, signature=PAGE_SHAPE, threshold=PAGE_THRESHOLD)
    with shuffles_dropped(spark):
        pairs = stage_table(found.pairs, "overlaps")
    differ = pairs.where("rep_a <> rep_b").select(F.col("rep_a").alias("id_a"), F.col("rep_b").alias("id_b"))
    close = exact_jaccard(differ, pages.select(F.col("page_id").alias("id"), F.col("text_plain").alias("text")), PAGE_SHAPE.width).where(F.col("jaccard") >= PAGE_THRESHOLD)
    near = pairs.join(close.select(F.col("id_a").alias("rep_a"), F.col("id_b").alias("rep_b")), ["rep_a", "rep_b"], "left_semi")
    return member_pairs(found, near.unionByName(pairs.where("rep_a = rep_b")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_pages(spark, d).select(F.least("id_a", "id_b").alias("page_id_a"), F.greatest("id_a", "id_b").alias("page_id_b")).distinct()


def _evaluation_pages(spark: SparkSession, d: str) -> DataFrame:
    placed = split_pages(read_table(spark, d, "page_texts"), read_table(spark, d, "doc_splits")).where("side = 'b'").select("page_id", "doc_id", "split")
    agency = read_table(spark, d, "filings").where(~F.coalesce("duplicate", F.lit(False))).groupBy("doc_id").agg(F.min("agency").alias("agency"))
    return placed.join(agency, "doc_id", "left")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation pages found in train, and all evaluation pages, by split and agency."""
    leaked = leaked_pages(spark, d).select(F.col("id_b").alias("page_id")).distinct().withColumn("leaked", F.lit(1))
    return _evaluation_pages(spark, d).join(leaked, "page_id", "left").groupBy("split", "agency").agg(F.count(F.lit(1)).alias("n_pages"), F.count("leaked").alias("n_leaked"))


def p5_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation page found in train, its split and agency, its largest fraction
    in chunks of one train page, and how many train pages it is in."""
    best = leaked_pages(spark, d).groupBy(F.col("id_b").alias("page_id")).agg(F.round(F.max("overlap_b"), 6).alias("overlap"), F.countDistinct("id_a").alias("n_train_pages"))
    return _evaluation_pages(spark, d).join(best, "page_id").select("page_id", "split", "agency", "overlap", "n_train_pages")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return page_defects(read_table(spark, d, "page_texts"))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every page as continuous paragraphs, in both views."""
    return repaired_pages(read_table(spark, d, "page_texts"))


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_report": p5_report, "p5_overlaps": p5_overlaps, "p6_found": p6_found, "p6_repaired": p6_repaired}
_RUNS = r"""
w AS (SELECT page_id, doc_id, regexp_extract_all(lower(text_plain), '[\p{L}\p{N}]+') AS w FROM page_texts WHERE text_plain IS NOT NULL),
s AS (SELECT DISTINCT page_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 30),
n AS (SELECT page_id, count(*) AS n FROM s GROUP BY ALL),
k AS (SELECT a.page_id AS page_id_a, b.page_id AS page_id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.page_id < b.page_id GROUP BY ALL),
j AS (SELECT page_id_a, page_id_b FROM k JOIN n a ON a.page_id = page_id_a JOIN n b ON b.page_id = page_id_b WHERE k >= 0.6 * (a.n + b.n - k))
"""
SQL = {
    "p4_found": f"WITH {_RUNS} SELECT * FROM j",
    "p5_found": f"WITH {_RUNS}, t AS (SELECT DISTINCT page_id, lower(trim(split)) = 'train' AS train FROM page_texts JOIN doc_splits USING (doc_id) WHERE lower(trim(split)) IN ('train', 'dev', 'test', 'holdout')) SELECT DISTINCT j.* FROM j JOIN t a ON a.page_id = page_id_a JOIN t b ON b.page_id = page_id_b WHERE a.train <> b.train",
    "p5_report": f"""WITH {_RUNS}, t AS (SELECT DISTINCT page_id, doc_id, lower(trim(split)) AS split FROM page_texts JOIN doc_splits USING (doc_id) WHERE lower(trim(split)) IN ('train', 'dev', 'test', 'holdout')),
l AS (SELECT DISTINCT e.page_id FROM (SELECT page_id_a AS x, page_id_b AS y FROM j UNION ALL SELECT page_id_b, page_id_a FROM j) JOIN t e ON e.page_id = x AND e.split <> 'train' JOIN t r ON r.page_id = y AND r.split = 'train'),
a AS (SELECT doc_id, min(agency) AS agency FROM filings WHERE NOT coalesce(duplicate, false) GROUP BY ALL)
SELECT t.split, a.agency, count(*) AS n_pages, count(l.page_id) AS n_leaked FROM t LEFT JOIN a USING (doc_id) LEFT JOIN l ON l.page_id = t.page_id WHERE t.split <> 'train' GROUP BY ALL""",
    "p4_groups": f"""WITH RECURSIVE {_RUNS}, e AS (SELECT page_id_a, page_id_b FROM k JOIN n a ON a.page_id = page_id_a JOIN n b ON b.page_id = page_id_b WHERE k = a.n AND k = b.n),
c AS (SELECT n.page_id, coalesce(min(e.page_id_a), n.page_id) AS rep FROM n LEFT JOIN e ON e.page_id_b = n.page_id GROUP BY n.page_id),
l AS (SELECT page_id_a AS x, page_id_b AS y FROM j JOIN c a ON a.page_id = page_id_a AND a.rep = page_id_a JOIN c b ON b.page_id = page_id_b AND b.rep = page_id_b),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r AS (SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y),
g AS (SELECT x AS rep, min(y) AS group_id FROM r GROUP BY ALL), d AS (SELECT x AS rep, count(*) AS n FROM b GROUP BY ALL)
SELECT c.page_id, g.group_id, c.rep AS class_id, coalesce(d.n, 0) AS n_links FROM c JOIN g USING (rep) LEFT JOIN d USING (rep)""",
}
