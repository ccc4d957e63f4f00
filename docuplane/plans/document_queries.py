"""Queries over pages, documents, filings and the registry, for the operators of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docuplane.functions import cleaning as C
from docuplane.functions.normal import month_key, number_key
from docuplane.operators import acquisition as A
from docuplane.operators import citations as T
from docuplane.operators import labelling as N
from docuplane.operators import ledger as L
from docuplane.operators import registry as R
from docuplane.operators import roles as B
from docuplane.operators import sections as S
from docuplane.plans.registry_queries import _CITED, _NUMBER, P2_SQL, section_versions
from docuplane.session import read_table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "page_texts")


# ---- text: lines, plain numbers, mentions

_LINES = "l AS (SELECT page_id, doc_id, page, unnest(string_split(text_layout, chr(10))) AS line, generate_subscripts(string_split(text_layout, chr(10)), 1) - 1 AS line_no FROM page_texts WHERE text_layout IS NOT NULL)"


@query(f"WITH {_LINES}, o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l) SELECT page_id, count(*) AS n_lines, count(*) FILTER (trim(line) = '') AS n_blank, CAST(max(s) AS BIGINT) AS last_start, CAST(sum(s * (line_no + 1)) AS BIGINT) AS checksum FROM o GROUP BY ALL")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    o = T.line_offsets(pages(spark, d))
    return o.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.trim("line") == "").alias("n_blank"), F.max("line_start").alias("last_start"), F.sum(F.col("line_start") * (F.col("line_no") + 1)).alias("checksum"))


_PARTS = "1852|3052|2452|5152|5352|5252|7052|252|552|652|752|952|852|352|452|52"
_PLAIN = rf"b0 AS (SELECT DISTINCT doc_id, number FROM (SELECT doc_id, unnest(regexp_extract_all(text_plain, '(?:^|[^0-9])((?:{_PARTS})\.[0-9]{{3}}(?:-[0-9]{{1,4}})?)', 1)) AS number FROM page_texts))"
_REG = f"r AS (SELECT DISTINCT {_NUMBER.format('number')} AS number FROM registry_snapshots)"


def _plain(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("doc_id", F.explode(T.plain_numbers(F.col("text_plain"))).alias("number")).distinct()


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "registry_snapshots").select(number_key(F.col("number")).alias("number")).distinct()


@query(f"WITH {_PLAIN} SELECT * FROM b0")
def plain_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _plain(spark, d)


@query(f"WITH {_PLAIN}, {_REG} SELECT * FROM b0 SEMI JOIN r USING (number)")
def b0_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _plain(spark, d).join(_registry(spark, d), "number", "left_semi")


@query(f"WITH {_PLAIN}, {_REG}, k AS (SELECT doc_id, count(*) AS n FROM b0 SEMI JOIN r USING (number) GROUP BY ALL), f AS (SELECT DISTINCT doc_id FROM filings) SELECT f.doc_id, coalesce(n, 0) AS size FROM f LEFT JOIN k USING (doc_id)")
def b0_size_by_doc(spark: SparkSession, d: str) -> DataFrame:
    """Ledger sizes of all filed documents, zero where nothing is found."""
    n = b0_ledger(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return read_table(spark, d, "filings").select("doc_id").distinct().join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("size"))


@query("SELECT DISTINCT cand_id, doc_id, page, line_no, char_start, prefix, alternate, from_range, line_text, '⟦' || box_marker || '⟧' AS box_marker FROM candidates")
def mention_extract(spark: SparkSession, d: str) -> DataFrame:
    """Mentions found in the pages, against those of the candidates table."""
    return T.mentions(pages(spark, d)).select("cand_id", "doc_id", "page", "line_no", "char_start", "prefix", "alternate", "from_range", "line_text", "box_marker")


@query(
    f"WITH {_LINES}, s AS (SELECT *, unnest(regexp_extract_all(line, '⟦[X ?]⟧')) AS marker FROM l) SELECT marker, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM s GROUP BY ALL"
)
def box_marker_counts(spark: SparkSession, d: str) -> DataFrame:
    marks = T.page_lines(pages(spark, d)).select("page_id", F.explode(F.regexp_extract_all("line", F.lit("(⟦[X ?]⟧)"), F.lit(1))).alias("marker"))
    return marks.groupBy("marker").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("n_pages"))


_CANDS = f"c AS (SELECT DISTINCT cand_id, doc_id, page, line_no, char_start, {_NUMBER.format('number')} AS number, alternate, box_marker, from_range, CAST(regexp_extract(cand_id, '(\\d+)$', 1) AS INT) AS ordinal FROM candidates)"


def cands(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "candidates").select("cand_id", "doc_id", "page", "line_no", "char_start", number_key(F.col("number")).alias("number"), "alternate", "box_marker", "from_range").distinct()
    return c.withColumn("ordinal", F.regexp_extract("cand_id", r"(\d+)$", 1).cast("int"))


@query(f"WITH {_CANDS} SELECT cand_id, number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY char_start, ordinal) AS k FROM c) WHERE k = 1")
def first_on_line(spark: SparkSession, d: str) -> DataFrame:
    return L.first_on_line(cands(spark, d)).select("cand_id", "number")


# ---- sections, lists and carried boxes


def _matches(pattern: str) -> str:
    return f"regexp_matches(t, '{pattern}')"


_STRIP = "regexp_replace({0}, '^[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g')"
_LETTER_STATES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LETTERS.items())
#: The labels as the last event of each kind at or before a line, step by step.
_LABELS = f"""{_LINES}, a AS (SELECT page_id, doc_id, page, line_no, {_STRIP.format("line")} AS t FROM l),
b AS (SELECT *, {_STRIP.format(f"regexp_extract(t, '{S.SECTION}', 2)")} AS rest FROM a WHERE t <> ''),
c AS (SELECT *, {_matches(S.SECTION)} AND (rest = '' OR regexp_matches(rest, '^[-–—:.]') OR (upper(rest) = rest AND length(rest) <= 90)) AND length(t) <= 120 AS sec, nullif(regexp_extract(t, '{S.CLAUSE_HEAD}', 1), '') AS ch FROM b),
d AS (SELECT *, {_matches(S.TOC_HEAD)} AS th, {_matches(S.LEADER)} OR ({_matches(S.TRAILING_PAGE)} AND (sec OR ch IS NOT NULL)) AS tl, length(t) < 3 AS sh, {_matches(S.LIST_ITEM)} AS li, {_matches(S.END_OF)} AS eo, {_matches(S.MARKED_NUMBER)} AS mk,
  CASE WHEN sec THEN CASE upper(regexp_extract(t, '{S.SECTION}', 1)) {_LETTER_STATES} ELSE 'OTHER' END WHEN {_matches(S.BY_REFERENCE)} THEN 'CLAUSE_LIST_IBR' WHEN {_matches(S.IN_FULL)} THEN 'FULL_TEXT_CLAUSE' WHEN {_matches(S.INSTRUCTIONS)} THEN 'INSTRUCTIONS' WHEN {_matches(S.EVALUATION)} THEN 'EVALUATION' WHEN {_matches(S.WORK)} THEN 'SOW' END AS mj0,
  row_number() OVER (PARTITION BY doc_id ORDER BY page, page_id, line_no) AS i FROM c),
e AS (SELECT *, th OR tl OR (sh AND coalesce(last_value(CASE WHEN th THEN i END IGNORE NULLS) OVER p > coalesce(last_value(CASE WHEN NOT th AND NOT tl AND NOT sh THEN i END IGNORE NULLS) OVER p, 0), false)) AS toc FROM d WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CASE WHEN NOT toc THEN mj0 END AS mj FROM e),
g AS (SELECT *, coalesce(last_value(mj IGNORE NULLS) OVER u, 'OTHER') AS base, coalesce(last_value(CASE WHEN mj IS NOT NULL THEN i END IGNORE NULLS) OVER u, 0) AS base_i FROM f WINDOW u AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT *, NOT toc AND mj IS NULL AND ch IS NOT NULL AND NOT li AND base IN ('FULL_TEXT_CLAUSE', 'OTHER') AS opens FROM g),
k AS (SELECT *, CASE WHEN base = 'OTHER' AND coalesce(last_value(CASE WHEN opens THEN i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), 0) > base_i THEN 'FULL_TEXT_CLAUSE' ELSE base END AS state, CASE WHEN mj IS NOT NULL THEN '-' WHEN opens THEN ch WHEN eo AND NOT toc THEN '-' END AS event FROM h),
n AS (SELECT *, nullif(last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-') AS was, nullif(last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), '-') AS scope FROM k),
o AS (SELECT *, CASE WHEN toc THEN 'TOC' WHEN mj IS NOT NULL THEN base WHEN opens THEN 'FULL_TEXT_CLAUSE' WHEN eo THEN CASE WHEN was IS NOT NULL THEN 'FULL_TEXT_CLAUSE' ELSE state END WHEN (was IN {S.CHECKLISTS} AND li) OR mk THEN 'CHECKLIST' ELSE state END AS label, th OR mj IS NOT NULL OR opens AS heading FROM n)"""


@query(f"WITH {_LABELS} SELECT page_id, doc_id, page, line_no, label, heading, CASE WHEN label IN ('FULL_TEXT_CLAUSE', 'CHECKLIST') THEN scope END AS clause FROM o")
def section_labels(spark: SparkSession, d: str) -> DataFrame:
    return S.section_labels(pages(spark, d)).drop("text")


@query(f"WITH {_LABELS} SELECT label, heading, count(*) AS n_lines, count(DISTINCT doc_id) AS n_documents FROM o GROUP BY ALL")
def section_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.section_labels(pages(spark, d)).groupBy("label", "heading").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("doc_id").alias("n_documents"))


@query(
    f"WITH {_LINES}, h AS (SELECT page_id, line_no FROM l WHERE regexp_matches(line, '^\\s*(?:⟦[X ?]⟧\\s*)?(?:FAR\\s+|DFARS\\s+)?\\d{{2,4}}\\.\\d{{3}}-\\d{{1,4}}\\b') AND NOT regexp_matches(line, '\\.{{4,}}\\s*[\\divxlc]*\\s*$|(?:\\.\\s){{5,}}')), "
    "i AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY page_id ORDER BY line_no)), r AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY line_no) AS run FROM i), "
    "k AS (SELECT *, count(*) OVER (PARTITION BY page_id, run) AS n FROM r), t AS (SELECT page_id, line_no FROM l WHERE regexp_matches(line, '(?i)^\\s*(?:TABLE\\s+OF\\s+CONTENTS|CONTENTS)\\s*$')), "
    "b AS (SELECT DISTINCT k.page_id, k.run FROM k JOIN t ON t.page_id = k.page_id AND k.new = 1 AND k.line_no - t.line_no BETWEEN 1 AND 4) SELECT page_id, line_no, CAST(run AS BIGINT) AS run FROM k ANTI JOIN b USING (page_id, run) WHERE n >= 4"
)
def bare_list_runs(spark: SparkSession, d: str) -> DataFrame:
    return S.bare_lists(pages(spark, d))


@query()
def carried_boxes(spark: SparkSession, d: str) -> DataFrame:
    return S.carried_boxes(pages(spark, d))


@query(
    f"WITH {_LINES}, s AS (SELECT doc_id, page, page_id, line_no, CASE WHEN regexp_matches(line, '^[A-M]\\.\\d+ [A-Z]') THEN line END AS heading FROM l), n AS (SELECT *, coalesce(sum(CASE WHEN heading IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM s), "
    "h AS (SELECT doc_id, k + 1 AS k, heading FROM n WHERE heading IS NOT NULL) SELECT n.doc_id, n.page, n.line_no, coalesce(string_agg(h.heading, ' > ' ORDER BY h.k), '') AS breadcrumb FROM n LEFT JOIN h ON h.doc_id = n.doc_id AND h.k BETWEEN n.k - 2 AND n.k GROUP BY ALL"
)
def breadcrumb_top3(spark: SparkSession, d: str) -> DataFrame:
    lines = T.page_lines(pages(spark, d)).withColumn("heading", F.when(F.col("line").rlike(r"^[A-M]\.\d+ [A-Z]"), F.col("line")))
    return L.preceding_headings(lines).select("doc_id", "page", "line_no", F.array_join("breadcrumb", " > ").alias("breadcrumb"))


@query(f"WITH {_LINES}, w AS (SELECT page_id, line_no, [lag(line, 2) OVER o, lag(line, 1) OVER o, line, lead(line, 1) OVER o] AS x FROM l WINDOW o AS (PARTITION BY page_id ORDER BY line_no)) SELECT page_id, line_no, array_to_string(list_filter(x, lambda s: trim(s) <> ''), ' | ') AS context FROM w")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    return L.context_window(T.page_lines(pages(spark, d)), 2, 1).select("page_id", "line_no", "context")


def _classified(spark: SparkSession, d: str) -> DataFrame:
    status = R.section_status(snapshots(spark, d)).select("number", "status")
    return B.classified(T.mentions(pages(spark, d), status), S.section_labels(pages(spark, d)))


@query()
def b1_roles(spark: SparkSession, d: str) -> DataFrame:
    """The role of each mention with its reason."""
    return _classified(spark, d).select("cand_id", "number", "alternate", "section", "role", "confidence", "reason")


@query()
def b1_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What each document binds by the rules."""
    return L.binding_ledger(_classified(spark, d), F.col("role").isin(*B.BINDING), F.col("role") == "EXPLICITLY_EXCLUDED")


@query("SELECT count(*) FILTER (label = 'T') AS typed_selected, count(*) FILTER (label = 'F') AS typed_blank FROM (SELECT CASE WHEN regexp_matches(line_text, '^\\s*(?:_*X{1,4}_*|\\[X\\])\\s*(?:\\(\\d{1,3}\\)|\\([A-Za-z]{1,4}\\)|FAR\\b)') THEN 'T' WHEN regexp_matches(line_text, '^\\s*(?:_{2,}|\\[\\s*\\])\\s*(?:\\(\\d{1,3}\\)|\\([a-z]{1,4}\\)|\\([ivx]+\\))') THEN 'F' END AS label FROM candidates)")
def typed_boxes(spark: SparkSession, d: str) -> DataFrame:
    state = B.typed_box(F.col("line_text"))
    return read_table(spark, d, "candidates").agg(F.count_if(state == "CHECKLIST_SELECTED").alias("typed_selected"), F.count_if(state == "CHECKLIST_NOT_SELECTED").alias("typed_blank"))


# ---- cleaning


@query(r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS text FROM documents")
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", C.redacted(F.col("text")).alias("text"))


@query()
def marking_counts(spark: SparkSession, d: str) -> DataFrame:
    """Markings mentioned, and shown as banners, by document and page."""
    p = pages(spark, d).where(C.mentions_marking(F.col("text_plain")))
    said = p.select("doc_id", "page_id", F.explode(C.markings(F.col("text_plain"))).alias("marking"), F.lit("mention").alias("kind"))
    shown = T.page_lines(p, "text_plain").select("doc_id", "page_id", F.explode(C.banner_markings(F.col("line"))).alias("marking"), F.lit("banner").alias("kind"))
    return said.unionByName(shown).groupBy("marking", "kind").agg(F.countDistinct("page_id").alias("n_pages"), F.countDistinct("doc_id").alias("n_documents"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\\s\\p{Z}]', '', 'g') <> ''), chr(10)) AS text_layout FROM documents")
def text_file_pages(spark: SparkSession, d: str) -> DataFrame:
    """The layout view of plain text files."""
    return read_table(spark, d, "documents").select("doc_id", C.text_layout(F.col("text")).alias("text_layout"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def repeated_texts(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("sha256"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


# ---- filings


@query("WITH f AS (SELECT DISTINCT * FROM filings WHERE solicitation_number IS NOT NULL) SELECT solicitation_number, arg_max(notice_id, (coalesce(posted_date, ''), notice_id)) AS notice_id, max(posted_date) AS posted_date, count(DISTINCT notice_id) AS n_notices FROM f GROUP BY ALL")
def latest_notice(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_notice(read_table(spark, d, "filings").distinct())


@query("WITH f AS (SELECT solicitation_number, notice_id, min(posted_date) AS posted_date FROM filings WHERE solicitation_number IS NOT NULL GROUP BY ALL) SELECT solicitation_number, row_number() OVER (PARTITION BY solicitation_number ORDER BY posted_date NULLS FIRST, notice_id) AS step, notice_id, posted_date FROM f")
def notice_lineage(spark: SparkSession, d: str) -> DataFrame:
    return A.notice_lineage(read_table(spark, d, "filings"))


@query("WITH f AS (SELECT DISTINCT doc_id, notice_id, sha256, download_ts FROM filings) SELECT doc_id, notice_id, (download_ts, notice_id) <> min((download_ts, notice_id)) OVER (PARTITION BY sha256) AS seen_before FROM f")
def stored_before(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "filings").select("doc_id", "notice_id", "sha256", "download_ts").distinct()
    return A.first_stored(f, "sha256", "download_ts", "notice_id").select("doc_id", "notice_id", "seen_before")


@query("WITH f AS (SELECT DISTINCT * FROM filings) SELECT agency, left(posted_date, 7) AS month, count(*) AS n_files, count(DISTINCT doc_id) AS n_documents, CAST(sum(size_bytes) AS BIGINT) AS n_bytes, median(size_bytes) AS median_bytes, count(*) FILTER (duplicate) AS n_duplicates FROM f GROUP BY ALL")
def acquisition_stats(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "filings").distinct()
    return f.groupBy("agency", F.substring("posted_date", 1, 7).alias("month")).agg(
        F.count(F.lit(1)).alias("n_files"), F.countDistinct("doc_id").alias("n_documents"), F.sum("size_bytes").alias("n_bytes"), F.expr("percentile(size_bytes, 0.5)").alias("median_bytes"), F.count_if("duplicate").alias("n_duplicates")
    )


@query("WITH f AS (SELECT DISTINCT filename, size_bytes FROM filings) SELECT filename, size_bytes, CASE WHEN regexp_extract(lower(filename), '[^/.](\\.[^/.]+)$', 1) NOT IN ('', '.pdf', '.docx') THEN 'extension' WHEN size_bytes > 1000000 THEN 'too_large' WHEN size_bytes = 0 THEN 'empty' END AS reason FROM f")
def file_eligibility(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "filings").select("filename", "size_bytes").distinct()
    return f.withColumn("reason", A.ineligible(F.col("filename"), F.col("size_bytes"), F.lit("x"), (".pdf", ".docx"), 1_000_000))


@query()
def capped_files(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "filings").select(F.col("agency").alias("grp"), F.col("filename").alias("file"), F.col("size_bytes").alias("bytes")).distinct()
    return A.capped_files(f, 20, 20_000_000)


@query()
def balanced_selection(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "filings").select("notice_id", F.substring("posted_date", 1, 7).alias("month"), F.col("agency").alias("department")).where("month IS NOT NULL")
    return A.balanced_selection(f, 100, 0.25)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY ALL")
def journal_last_wins(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return A.last_wins(e, "user_id", F.struct("ts", "event_id")).select("user_id", "event_type", "ts")


@query("SELECT DISTINCT doc_id FROM filings ANTI JOIN doc_splits USING (doc_id)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "filings").select("doc_id").distinct().join(read_table(spark, d, "doc_splits").select("doc_id").distinct(), "doc_id", "left_anti")


@query("WITH k AS (SELECT key, CAST(sum(value) AS BIGINT) AS n FROM (SELECT unnest(map_entries(box_signals.counts), recursive := true) FROM page_texts) GROUP BY ALL) SELECT key, n FROM k")
def box_signal_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counter maps of the pages, summed by key."""
    return pages(spark, d).select(F.explode("box_signals.counts").alias("key", "value")).groupBy("key").agg(F.sum("value").alias("n"))


@query("SELECT p.doc_id, count(*) AS n_pages, count(*) FILTER (scanned) AS n_scanned, avg(coalesce(scanned, false)::INT) >= 0.8 AS scanned_most, bool_and(coalesce(scanned, false)) AS scanned_all FROM page_texts p GROUP BY ALL")
def scanned_documents(spark: SparkSession, d: str) -> DataFrame:
    s = F.coalesce("scanned", F.lit(False))
    return pages(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(s).alias("n_scanned"), (F.avg(s.cast("int")) >= 0.8).alias("scanned_most"), F.bool_and(s).alias("scanned_all"))


@query(f"WITH {_CANDS}, n AS (SELECT doc_id, count(DISTINCT number) AS n, count(DISTINCT number) FILTER (box_marker IS NOT NULL) AS boxed FROM c GROUP BY ALL) SELECT doc_id, n, boxed, CASE WHEN n NOT BETWEEN 8 AND 150 THEN NULL WHEN n <= 40 THEN 'S' WHEN boxed < 10 THEN NULL WHEN n <= 80 THEN 'M' ELSE 'L' END AS stratum FROM n")
def frame_strata(spark: SparkSession, d: str) -> DataFrame:
    """Documents by number of distinct numbers, in strata for a sampling frame."""
    n = cands(spark, d).groupBy("doc_id").agg(F.countDistinct("number").alias("n"), F.countDistinct(F.when(F.col("box_marker").isNotNull(), F.col("number"))).alias("boxed"))
    k = F.col("n")
    return n.withColumn("stratum", F.when(~k.between(8, 150), None).when(k <= 40, "S").when(F.col("boxed") < 10, None).when(k <= 80, "M").otherwise("L"))


# ---- registry


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "registry_snapshots")
    return s.select(number_key(F.col("number")).alias("number"), F.col("as_of_date").alias("day"), "loaded_at", "snap_id", "regulation", "removed", "reserved", "clause_date", "title").distinct()


_SNAPS = f"s AS (SELECT DISTINCT {_NUMBER.format('number')} AS number, as_of_date AS day, loaded_at, snap_id, regulation, removed, reserved, clause_date, title FROM registry_snapshots)"


@query(f"WITH {_SNAPS}, d AS (SELECT number, day, bool_or(removed) AS removed FROM s GROUP BY ALL) SELECT number, day AS effective_from, strftime(CAST(lead(day) OVER (PARTITION BY number ORDER BY day) AS DATE) - 1, '%Y-%m-%d') AS effective_to, removed FROM d")
def registry_intervals(spark: SparkSession, d: str) -> DataFrame:
    return R.effective_intervals(snapshots(spark, d))


_STATUS = f"{_SNAPS}, z AS (SELECT number, arg_max(removed, (day, loaded_at, snap_id)) AS removed, arg_max(reserved, (day, loaded_at, snap_id)) AS reserved, max((day, loaded_at, snap_id)) AS top, min(day) AS first_seen, max(day) AS last_seen FROM s GROUP BY ALL), st AS (SELECT z.number, CASE WHEN z.removed THEN 'removed' WHEN z.reserved THEN 'reserved' ELSE 'active' END AS status, s.clause_date, s.title, first_seen, last_seen FROM z JOIN s ON s.number = z.number AND s.snap_id = top.snap_id AND s.loaded_at = top.loaded_at)"
_STATUS = _STATUS.replace("max((day, loaded_at, snap_id)) AS top", "max({'day': day, 'loaded_at': loaded_at, 'snap_id': snap_id}) AS top")


@query(f"WITH {_STATUS} SELECT DISTINCT number, status, CASE WHEN status = 'active' THEN clause_date END AS current_date, title, first_seen, last_seen FROM st")
def registry_status(spark: SparkSession, d: str) -> DataFrame:
    return R.section_status(snapshots(spark, d))


@query(f"WITH {_STATUS} SELECT status, count(*) AS n, min(first_seen) AS first_seen FROM (SELECT DISTINCT number, status, first_seen FROM st) GROUP BY ALL")
def registry_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.section_status(snapshots(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("first_seen").alias("first_seen"))


@query(f"WITH {_SNAPS}, n AS (SELECT DISTINCT number FROM s) SELECT number, row_number() OVER (ORDER BY CAST(split_part(number, '.', 1) AS INT), CAST(split_part(split_part(number, '.', 2), '-', 1) AS INT), CAST(split_part(number, '-', 2) AS INT)) AS place FROM n")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """The numbers' places in natural order: a global rank over the registry's numbers."""
    n = snapshots(spark, d).select("number").distinct()
    return n.select("number", F.row_number().over(W.orderBy(R.natural_key(F.col("number")))).alias("place"))


_PARTS_SQL = "p AS (SELECT '52.2' || lpad(CAST(p_partkey % 50 AS VARCHAR), 2, '0') AS base, p_size % 30 + 1 AS lo, p_size % 30 + 1 + p_partkey % 6 AS hi FROM part)"


@query(f"WITH {_PARTS_SQL} SELECT number, source_range, count(*) AS n FROM (SELECT base || '-' || CAST(unnest(generate_series(lo, hi)) AS VARCHAR) AS number, base || '-' || lo || ' - ' || base || '-' || hi AS source_range FROM p WHERE hi > lo UNION ALL SELECT base || '-' || lo || ' - ' || base || '-' || hi, NULL FROM p WHERE hi <= lo) GROUP BY ALL")
def range_expand(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part").selectExpr("concat('52.2', lpad(cast(p_partkey % 50 AS string), 2, '0')) AS base", "p_size % 30 + 1 AS lo", "p_size % 30 + 1 + p_partkey % 6 AS hi")
    ranges = p.selectExpr("concat(base, '-', lo, ' - ', base, '-', hi) AS number")
    return R.expand_ranges(ranges).groupBy("number", "source_range").agg(F.count(F.lit(1)).alias("n"))


_OVERLAY = "o AS (SELECT number, min((status, title)) AS m FROM (SELECT concat('52.2', lpad(CAST(l_partkey % 50 AS VARCHAR), 2, '0'), '-', l_partkey % 60 + 1) AS number, CASE WHEN l_suppkey % 2 = 0 THEN 'text' ELSE 'reserved' END AS status, 'overlay ' || l_partkey % 60 AS title FROM lineitem) GROUP BY ALL)".replace("min((status, title))", "min({'status': status, 'title': title})")


@query(
    f"WITH {_OVERLAY}, g AS (SELECT DISTINCT concat('52.2', lpad(CAST(p_partkey % 50 AS VARCHAR), 2, '0'), '-', p_partkey % 40 + 1) AS number FROM part) "
    "SELECT g.number, 'FAR' AS regulation, 'active' AS status, CAST(NULL AS VARCHAR) AS title, m.status AS overlay_status FROM g LEFT JOIN o USING (number) UNION ALL SELECT number, 'FAR', 'overlay_only', m.title, m.status FROM o ANTI JOIN g USING (number) WHERE m.status = 'text'"
)
def overlay_merge(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "lineitem").selectExpr("concat('52.2', lpad(cast(l_partkey % 50 AS string), 2, '0'), '-', l_partkey % 60 + 1) AS number", "CASE WHEN l_suppkey % 2 = 0 THEN 'text' ELSE 'reserved' END AS status", "concat('overlay ', l_partkey % 60) AS title")
    g = read_table(spark, d, "part").selectExpr("concat('52.2', lpad(cast(p_partkey % 50 AS string), 2, '0'), '-', p_partkey % 40 + 1) AS number").distinct().selectExpr("number", "'FAR' AS regulation", "'active' AS status", "cast(null AS string) AS title")
    once = R.merge_overlay(g, o)
    return R.merge_overlay(once.drop("overlay_status"), o)


@query(f"WITH {_SNAPS}, a AS (SELECT number, title FROM s WHERE day = (SELECT max(day) FROM s) QUALIFY row_number() OVER (PARTITION BY number ORDER BY loaded_at DESC, snap_id DESC) = 1), b AS (SELECT number, title FROM s WHERE day < (SELECT max(day) FROM s) QUALIFY row_number() OVER (PARTITION BY number ORDER BY day DESC, loaded_at DESC, snap_id DESC) = 1) SELECT coalesce(a.number, b.number) AS number, CASE WHEN a.number IS NOT NULL THEN a.title ELSE b.title END AS title, a.number IS NOT NULL AS present FROM a FULL JOIN b ON a.number = b.number")
def latest_or_last_seen(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    top = s.agg(F.max("day").alias("top"))
    s = s.join(top, s["day"] == top["top"], "left")
    pick = F.max_by("title", F.struct("day", "loaded_at", "snap_id")).alias("title")
    return R.latest_or_last_seen(s.where("top IS NOT NULL").groupBy("number").agg(pick), s.where("top IS NULL").groupBy("number").agg(pick), "number", "title")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "registry_snapshots")
    dates = s.groupBy(F.col("snap_id").alias("_id")).agg(F.min("clause_date").alias("clause_date"))
    return section_versions(s).join(dates, "_id").select(F.col("_k").alias("number"), "valid_from", "valid_to", "clause_date")


def _cited(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "candidates").select("cand_id", "doc_id", number_key(F.col("number")).alias("number"), month_key(F.col("cited_date")).alias("cited")).distinct()
    f = read_table(spark, d, "filings").where(~F.col("duplicate")).groupBy("doc_id").agg(F.min("posted_date").alias("day"))
    return c.join(f, "doc_id", "left")


_IN_FORCE = f"""
{P2_SQL.strip()[: P2_SQL.strip().rindex("SELECT number")]},
h AS (SELECT e.number, e.as_of_date AS valid_from, coalesce(strftime(CAST(next_day AS DATE) - 1, '%Y-%m-%d'), '9999-12-31') AS valid_to, k.clause_date
      FROM e JOIN (SELECT number, as_of_date, arg_max(clause_date, (loaded_at, snap_id)) AS clause_date FROM (SELECT {_NUMBER.format("number")} AS number, as_of_date, loaded_at, snap_id, coalesce(clause_date, '') AS clause_date FROM registry_snapshots) GROUP BY ALL) k
      ON k.number = e.number AND k.as_of_date = e.as_of_date WHERE e.p IS NOT NULL),
q AS (SELECT DISTINCT cand_id, doc_id, {_NUMBER.format("number")} AS number FROM candidates),
f AS (SELECT doc_id, min(posted_date) AS day FROM filings WHERE NOT duplicate GROUP BY ALL)
"""


@query(_IN_FORCE + "SELECT q.cand_id, q.number, day, nullif(h.clause_date, '') AS clause_date FROM q LEFT JOIN f USING (doc_id) LEFT JOIN h ON h.number = q.number AND day BETWEEN valid_from AND valid_to")
def version_in_force(spark: SparkSession, d: str) -> DataFrame:
    """The clause date in force for each candidate, after all corrections."""
    return R.version_in_force(_cited(spark, d).drop("cited").distinct(), _versions(spark, d)).select("cand_id", "number", "day", "clause_date")


@query(
    _IN_FORCE + f", w AS ({_CITED} SELECT DISTINCT cand_id, doc_id, number, cited FROM m), {_REG.replace('r AS', 'kn AS', 1)}, j AS (SELECT w.doc_id, left(day, 4) AS era, kn.number IS NOT NULL AS known, w.cited, nullif(h.clause_date, '') AS now FROM w LEFT JOIN f USING (doc_id) LEFT JOIN h ON h.number = w.number AND day BETWEEN valid_from AND valid_to LEFT JOIN kn ON kn.number = w.number) "
    "SELECT era, CASE WHEN NOT known THEN 'not_in_registry' WHEN cited IS NULL THEN 'no_date_cited' WHEN now IS NULL THEN 'no_version_data' WHEN cited = now THEN 'matches' WHEN cited < now THEN 'older' ELSE 'newer' END AS category, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM j GROUP BY ALL"
)
def currency_by_era(spark: SparkSession, d: str) -> DataFrame:
    known = _registry(spark, d).withColumn("known", F.lit(True))
    c = R.version_in_force(_cited(spark, d), _versions(spark, d)).join(known, "number", "left")
    judged = c.select("doc_id", F.substring("day", 1, 4).alias("era"), R.currency(F.coalesce("known", F.lit(False)), F.col("cited"), F.col("clause_date")).alias("category"))
    return judged.groupBy("era", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_documents"))


# ---- items for annotators


@query()
def neutral_contexts(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return N.neutral_contexts(T.mentions(p).select("cand_id", "page_id", "line_no", "number"), T.page_lines(p))


@query(f"WITH {_CANDS} SELECT doc_id, number, cand_id, k AS shown FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY page, line_no, char_start, cand_id) AS k FROM c) WHERE k <= 3")
def evidence_sheet(spark: SparkSession, d: str) -> DataFrame:
    return N.evidence_sheet(cands(spark, d)).select("doc_id", "number", "cand_id", "shown")


@query()
def sampled_numbers(spark: SparkSession, d: str) -> DataFrame:
    return N.sampled_numbers(cands(spark, d), 5)


@query()
def request_batches(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "candidates").select("doc_id", "cand_id", F.col("line_text").alias("context")).distinct()
    return N.request_batches(c)


@query(f"WITH a AS (SELECT DISTINCT doc_id, {_NUMBER.format('number')} AS number FROM candidates), b AS (SELECT DISTINCT doc_id, {_NUMBER.format('number')} AS number FROM gold_labels) SELECT doc_id, number, 'missing' AS problem FROM a ANTI JOIN b USING (doc_id, number) UNION ALL SELECT doc_id, number, 'extra' FROM b ANTI JOIN a USING (doc_id, number)")
def intake_differences(spark: SparkSession, d: str) -> DataFrame:
    g = read_table(spark, d, "gold_labels").select("doc_id", number_key(F.col("number")).alias("number"))
    return N.intake_differences(cands(spark, d), g, "doc_id", "number")
