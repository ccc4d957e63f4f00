"""Queries over the registry: what governed a citation, and section histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuplane.functions.normal import loose_text, month_key, number_key
from docuplane.operators.bitemporal import as_known_at
from docuplane.operators.history import snapshot_history
from docuplane.session import read_table


def posting_moments(filings: DataFrame) -> DataFrame:
    """``doc_id, posted_at`` of the first storing of each document."""
    return filings.where(~F.coalesce("duplicate", F.lit(False)) & F.col("posted_at").isNotNull()).groupBy("doc_id").agg(F.min("posted_at").alias("posted_at"))


def governed_candidates(candidates: DataFrame, filings: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each distinct candidate with the registry row that governed it when its document was posted.

    ``cand_id, doc_id, number, cited_month, snap_id, clause_date, removed``; the last
    three are null where nothing was known. Repeated candidate rows give one row.
    """
    cands = candidates.select("cand_id", "doc_id", number_key(F.col("number")).alias("number"), month_key(F.col("cited_date")).alias("cited_month")).distinct()
    posted = cands.join(posting_moments(filings), "doc_id", "left")
    known = as_known_at(
        posted,
        snapshots,
        key=F.col("number"),
        valid_day=F.to_date("posted_at"),
        moment=F.col("posted_at"),
        version_key=number_key(F.col("number")),
        version_day=F.to_date(F.try_to_timestamp("as_of_date", F.lit("yyyy-MM-dd"))),
        version_moment=F.col("loaded_at"),
        version_id=F.col("snap_id"),
    )
    rows = snapshots.groupBy("snap_id").agg(F.min(F.struct(month_key(F.col("clause_date")).alias("clause_date"), "removed")).alias("_s")).select(F.col("snap_id").alias("version_id"), "_s.*")
    return known.join(rows, "version_id", "left").select("cand_id", "doc_id", "number", "cited_month", F.col("version_id").alias("snap_id"), "clause_date", "removed")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    g = governed_candidates(read_table(spark, d, "candidates"), read_table(spark, d, "filings"), read_table(spark, d, "registry_snapshots"))
    return g.where(~F.coalesce("removed", F.lit(False)) & (F.col("clause_date") != F.col("cited_month"))).select("cand_id", "snap_id").distinct()


def p1_governing(spark: SparkSession, d: str) -> DataFrame:
    """For every candidate the clause date in force and known on the posting day."""
    g = governed_candidates(read_table(spark, d, "candidates"), read_table(spark, d, "filings"), read_table(spark, d, "registry_snapshots"))
    return g.select("cand_id", "doc_id", "number", "cited_month", F.when(~F.coalesce("removed", F.lit(False)), F.col("clause_date")).alias("governing_date"))


def section_versions(snapshots: DataFrame) -> DataFrame:
    """Versions of each section by clause date, title and set of alternates."""
    alternates = F.array_sort(F.array_distinct(F.transform(F.coalesce("alternates", F.expr("array()").cast(snapshots.schema["alternates"].dataType)), lambda a: F.concat_ws("|", loose_text(a["name"]), loose_text(a["date"])))))
    return snapshot_history(
        snapshots,
        key=number_key(F.col("number")),
        day=F.col("as_of_date"),
        recorded=F.col("loaded_at"),
        row_id=F.col("snap_id"),
        removed=F.col("removed"),
        payload=[loose_text(F.col("clause_date")), loose_text(F.col("title")), alternates],
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return section_versions(read_table(spark, d, "registry_snapshots")).select(F.col("_k").alias("number"), "valid_from", "valid_to")


def p2_history(spark: SparkSession, d: str) -> DataFrame:
    """The versions with the attributes they hold."""
    snapshots = read_table(spark, d, "registry_snapshots")
    rows = snapshots.groupBy(F.col("snap_id").alias("_id")).agg(F.min(F.struct("clause_date", "title", F.to_json("alternates").alias("alternates"))).alias("_s"))
    return section_versions(snapshots).join(rows, "_id").select(F.col("_k").alias("number"), "valid_from", "valid_to", "_s.*")


_NUMBER = "regexp_replace(translate({0}, '‐‑‒–—―−﹘﹣－', '----------'), '[\\s\\x{{85}}\\p{{Z}}\\p{{Cf}}\\p{{Cc}}]', '', 'g')"
_LOOSE = "coalesce(regexp_replace(lower(" + _NUMBER + "), '\\.+$', ''), '')"


P1_SQL = f"""
WITH c AS (SELECT DISTINCT cand_id, doc_id, {_NUMBER.format("number")} AS number, lower(trim(cited_date)) AS s FROM candidates),
y AS (SELECT *, CASE WHEN regexp_matches(s, '^\\d{{4}}[-/.]\\d{{1,2}}([-/.]\\d{{1,2}})?$') THEN left(s, 4)
                     WHEN regexp_matches(s, '^(\\d{{1,2}}/|[a-z]+\\.? )\\d{{4}}$') THEN right(s, 4) END AS year,
                CASE WHEN regexp_matches(s, '^\\d{{4}}') THEN TRY_CAST(regexp_extract(s, '^\\d{{4}}[-/.](\\d{{1,2}})', 1) AS INT)
                     WHEN regexp_matches(s, '^\\d{{1,2}}/') THEN TRY_CAST(split_part(s, '/', 1) AS INT)
                     ELSE list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], left(s, 3)) END AS month FROM c),
m AS (SELECT cand_id, doc_id, number, CASE WHEN month BETWEEN 1 AND 12 THEN year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') END AS cited FROM y),
f AS (SELECT doc_id, min(posted_at) AS posted_at FROM filings WHERE NOT duplicate AND posted_at IS NOT NULL GROUP BY doc_id),
r AS (SELECT DISTINCT snap_id, {_NUMBER.format("number")} AS number, CAST(as_of_date AS DATE) AS d, loaded_at, clause_date, removed FROM registry_snapshots),
g AS (SELECT m.cand_id, m.cited, r.snap_id, r.clause_date, r.removed,
             row_number() OVER (PARTITION BY m.cand_id, m.number, m.cited ORDER BY r.d DESC, r.loaded_at DESC, r.snap_id DESC) AS k
      FROM m JOIN f USING (doc_id) JOIN r ON r.number = m.number AND r.d <= CAST(f.posted_at AS DATE) AND r.loaded_at <= f.posted_at)
SELECT DISTINCT cand_id, snap_id FROM g WHERE k = 1 AND NOT removed AND clause_date <> cited
"""
P2_SQL = f"""
WITH r AS (SELECT {_NUMBER.format("number")} AS number, as_of_date, loaded_at, snap_id, removed,
                  {_LOOSE.format("clause_date")} || '#' || {_LOOSE.format("title")} || '#' ||
                  coalesce(array_to_string(list_sort(list_distinct(list_transform(alternates, lambda a: {_LOOSE.format("a.name")} || '|' || {_LOOSE.format("a.date")}))), ','), '') AS p
           FROM registry_snapshots),
l AS (SELECT number, as_of_date, CASE WHEN NOT removed THEN p END AS p,
             row_number() OVER (PARTITION BY number, as_of_date ORDER BY loaded_at DESC, snap_id DESC) AS k FROM r),
c AS (SELECT number, as_of_date, p, lag(p) OVER w AS before, row_number() OVER w AS n FROM l WHERE k = 1 WINDOW w AS (PARTITION BY number ORDER BY as_of_date)),
e AS (SELECT number, as_of_date, p, lead(as_of_date) OVER (PARTITION BY number ORDER BY as_of_date) AS next_day FROM c WHERE (n = 1 OR p IS DISTINCT FROM before))
SELECT number, as_of_date AS valid_from, coalesce(strftime(CAST(next_day AS DATE) - 1, '%Y-%m-%d'), '9999-12-31') AS valid_to FROM e WHERE p IS NOT NULL
"""
_CITED = P1_SQL[: P1_SQL.index("f AS (SELECT doc_id")].strip().rstrip(",")
P1_ALL_SQL = (
    P1_SQL[: P1_SQL.index("SELECT DISTINCT cand_id, snap_id")].rstrip()
    + " SELECT DISTINCT m.cand_id, m.doc_id, m.number, m.cited AS cited_month, CASE WHEN NOT coalesce(g.removed, false) THEN g.clause_date END AS governing_date FROM m LEFT JOIN (SELECT * FROM g WHERE k = 1) g ON g.cand_id = m.cand_id AND g.number = m.number AND g.cited IS NOT DISTINCT FROM m.cited"
).replace("row_number() OVER (PARTITION BY m.cand_id, m.number, m.cited", "m.number, row_number() OVER (PARTITION BY m.cand_id, m.number, m.cited")
_ALTERNATE_JSON = """'[' || array_to_string(list_transform(alternates, lambda a: '{' || concat_ws(',', '"name":"' || a.name || '"', '"date":"' || a.date || '"') || '}'), ',') || ']'"""
P2_ALL_SQL = (
    P2_SQL.strip()[: P2_SQL.strip().rindex("SELECT number")].rstrip()
    + f""", a AS (SELECT {_NUMBER.format("number")} AS number, as_of_date, clause_date, title, {_ALTERNATE_JSON} AS alternates, row_number() OVER (PARTITION BY {_NUMBER.format("number")}, as_of_date ORDER BY loaded_at DESC, snap_id DESC) AS k FROM registry_snapshots)
SELECT e.number, e.as_of_date AS valid_from, coalesce(strftime(CAST(e.next_day AS DATE) - 1, '%Y-%m-%d'), '9999-12-31') AS valid_to, a.clause_date, a.title, a.alternates FROM e JOIN a ON a.k = 1 AND a.number = e.number AND a.as_of_date = e.as_of_date WHERE e.p IS NOT NULL"""
)
QUERIES = {"p1_found": p1_found, "p1_governing": p1_governing, "p2_found": p2_found, "p2_history": p2_history}
SQL = {"p1_found": P1_SQL, "p1_governing": P1_ALL_SQL, "p2_found": P2_SQL, "p2_history": P2_ALL_SQL}
