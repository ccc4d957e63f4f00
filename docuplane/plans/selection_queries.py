"""Queries of the joins, picks, panels and geometry, and the ledger of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuplane.functions import cleaning as C
from docuplane.operators import features as M
from docuplane.operators import geometry as G
from docuplane.operators import panel as P
from docuplane.operators import registry as R
from docuplane.operators import roles as B
from docuplane.operators import selection as S
from docuplane.operators.service import document_ledger
from docuplane.plans import document_queries as D
from docuplane.plans.derived import MENTIONS, derived_mentions
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


# ---- joins


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def matched_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """A join in which every row must find its match."""
    n = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return S.must_match(read_table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("key")), n, "key").select("s_suppkey", "n_name")


@query("WITH a AS (SELECT doc_id, min(agency) AS agency FROM filings GROUP BY ALL) SELECT p.page_id, coalesce(a.agency, 'UNKNOWN') AS agency FROM page_texts p LEFT JOIN a USING (doc_id)")
def page_agencies(spark: SparkSession, d: str) -> DataFrame:
    return S.with_default(D.pages(spark, d).select("page_id", "doc_id"), read_table(spark, d, "filings").select("doc_id", "agency"), "doc_id", "agency", "UNKNOWN").select("page_id", "agency")


@query("WITH s AS (SELECT doc_id, count(*) AS n_pages, CAST(sum(length(coalesce(text_plain, ''))) AS BIGINT) AS n_chars FROM page_texts GROUP BY ALL), f AS (SELECT doc_id, min(filename) AS filename, min(posted_date) AS posted_date FROM filings GROUP BY ALL) SELECT * FROM s JOIN f USING (doc_id)")
def extraction_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What was read of each document, beside what is known of its file."""
    s = D.pages(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length(F.coalesce("text_plain", F.lit("")))).alias("n_chars"))
    f = read_table(spark, d, "filings").groupBy("doc_id").agg(F.min("filename").alias("filename"), F.min("posted_date").alias("posted_date"))
    return s.join(f, "doc_id")


@query(f"WITH {D._SNAPS}, i AS (SELECT number, min(day) AS effective_from FROM s GROUP BY ALL UNION SELECT number, strftime(CAST(max(day) AS DATE) + 1, '%Y-%m-%d') FROM s GROUP BY ALL UNION SELECT DISTINCT a.number, b.day FROM s a JOIN (SELECT max(day) AS day FROM s) b ON true) SELECT i.number, i.effective_from, CASE WHEN i.effective_from IN (SELECT day FROM s) THEN EXISTS (SELECT 1 FROM s WHERE s.number = i.number AND s.day = i.effective_from) END AS present FROM i")
def seen_on_day(spark: SparkSession, d: str) -> DataFrame:
    """Whether a section stands in the snapshot of a day: its first, the one after its last, and the last of all."""
    s = D.snapshots(spark, d)
    ends = s.groupBy("number").agg(F.min("day").alias("a"), F.date_format(F.date_add(F.to_date(F.max("day")), 1), "yyyy-MM-dd").alias("b"))
    top = s.agg(F.max("day").alias("c"))
    days = ends.join(F.broadcast(top)).select("number", F.explode(F.array("a", "b", "c")).alias("effective_from")).distinct()
    return R.seen_on_day(days, s)


# ---- filters and picks


@query("SELECT DISTINCT doc_id, posted_date FROM filings WHERE left(posted_date, 7) BETWEEN '2023-01' AND '2024-06' AND length(solicitation_number) > 0")
def filings_of_months(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "filings").withColumn("links", F.length("solicitation_number"))
    return S.in_months(f, "posted_date", "2023-01", "2024-06", "links").select("doc_id", "posted_date").distinct()


@query("SELECT o_orderkey, 'priority=' || o_orderpriority || ',status=' || o_orderstatus AS plan FROM orders")
def safe_view(spark: SparkSession, d: str) -> DataFrame:
    """Maps of attributes cut down to the keys that may be shown."""
    m = F.create_map(F.lit("status"), "o_orderstatus", F.lit("clerk"), F.lit("hidden"), F.lit("priority"), "o_orderpriority")
    kept = F.array_sort(F.map_entries(S.safe_view(m, ("status", "priority"))))
    return read_table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("plan"))


@query("WITH n AS (SELECT doc_id, page, page_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, page_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM page_texts), w AS (SELECT DISTINCT doc_id, CAST(floor(k * (n - 1) / 4) AS BIGINT) AS i FROM n, range(5) t(k) WHERE n > 5) SELECT doc_id, page_id FROM n WHERE n <= 5 UNION ALL SELECT n.doc_id, n.page_id FROM n JOIN w USING (doc_id, i)")
def spaced_pages(spark: SparkSession, d: str) -> DataFrame:
    """Five pages of each document, evenly spaced."""
    return S.evenly_spaced(D.pages(spark, d).select("doc_id", "page", "page_id"), 5, "doc_id", "page", "page_id").select("doc_id", "page_id")


@query(f"WITH {D._CANDS} SELECT number, count(*) AS n FROM c GROUP BY ALL ORDER BY n DESC, number LIMIT 15")
def top_numbers(spark: SparkSession, d: str) -> DataFrame:
    return S.top_list(D.cands(spark, d), "number", 15)


@query(f"WITH {MENTIONS}, e AS (SELECT DISTINCT doc_id, number, coalesce(alternate, '') AS alternate FROM m) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY number, alternate) AS place FROM e")
def ledger_order(spark: SparkSession, d: str) -> DataFrame:
    """The places of entries in their document's ledger."""
    from pyspark.sql import Window as W

    e = derived_mentions(spark, d).select("doc_id", "number", F.coalesce("alternate", F.lit("")).alias("alternate")).distinct()
    return e.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("number", "alternate")))


@query()
def stratified_pick(spark: SparkSession, d: str) -> DataFrame:
    frame = D.frame_strata(spark, d).where("stratum IS NOT NULL").select("doc_id", "stratum")
    return S.capped_by_group(S.with_default(frame, read_table(spark, d, "filings").select("doc_id", "agency"), "doc_id", "agency", "UNKNOWN").withColumnRenamed("agency", "department"), 30, 5)


# ---- text and nested columns


@query("SELECT cand_id, doc_id, page, line_no, number, box_marker, from_range, in_registry, left(line_text, 300) AS context FROM (SELECT DISTINCT cand_id, doc_id, page, line_no, number, box_marker, from_range, in_registry, line_text FROM candidates)")
def release_table(spark: SparkSession, d: str) -> DataFrame:
    """The columns of mentions that may be given away, with contexts redacted and cut."""
    c = read_table(spark, d, "candidates").select("cand_id", "doc_id", "page", "line_no", "number", "box_marker", "from_range", "in_registry", "line_text").distinct()
    return c.select("cand_id", "doc_id", "page", "line_no", "number", "box_marker", "from_range", "in_registry", F.substring(C.redacted(F.col("line_text")), 1, 300).alias("context"))


@query("SELECT page_id, len(string_split(text_layout, chr(10))) AS n_spans, length(text_layout) AS last_end, CAST(list_sum(list_transform(string_split(text_layout, chr(10)), lambda x: length(x))) AS BIGINT) AS n_inside FROM page_texts WHERE text_layout IS NOT NULL")
def offset_spans(spark: SparkSession, d: str) -> DataFrame:
    s = D.pages(spark, d).where("text_layout IS NOT NULL").select("page_id", G.line_spans(F.col("text_layout")).alias("s"))
    return s.select("page_id", F.size("s").alias("n_spans"), F.element_at("s", -1)["end"].alias("last_end"), F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"]).alias("n_inside"))


@query("WITH k AS (SELECT page_id, unnest(map_entries(box_signals.counts), recursive := true) FROM page_texts) SELECT page_id, key, CAST(value AS INT) AS n FROM k")
def signals_from_json(spark: SparkSession, d: str) -> DataFrame:
    """Counter maps kept as JSON text, read back as maps."""
    text = D.pages(spark, d).select("page_id", F.to_json("box_signals.counts").alias("j"))
    return text.select("page_id", F.explode(F.from_json("j", "map<string,int>")).alias("key", "n"))


# ---- texts made of rows, so that each rule for text meets its cases

_CONTACT = "concat('write to ', lower(replace(c_name, '#', '.')), '@mail', c_custkey % 9, '.example.com or call ', CASE WHEN c_custkey % 2 = 0 THEN '(' ELSE '' END, 200 + c_custkey % 700, CASE WHEN c_custkey % 2 = 0 THEN ') ' ELSE '-' END, 200 + c_custkey % 790, '-', 1000 + c_custkey % 9000, CASE WHEN c_custkey % 3 = 0 THEN ' ext. 12' ELSE '' END, ' on 252.204-7012 and ', c_custkey)"


@query("SELECT c_custkey, 'write to [EMAIL] or call [PHONE] on 252.204-7012 and ' || c_custkey AS text FROM customer")
def redacted_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Addresses and phone numbers go, section numbers and other numbers stay."""
    return read_table(spark, d, "customer").select("c_custkey", C.redacted(F.expr(_CONTACT)).alias("text"))


_WORDING = "CASE o_orderkey % 7 WHEN 0 THEN 'this is Controlled Unclassified Information' WHEN 1 THEN 'FOR OFFICIAL USE ONLY' WHEN 2 THEN 'DISTRIBUTION STATEMENT C applies' WHEN 3 THEN 'Proprietary and Source Selection Information' WHEN 4 THEN 'subject to ITAR and EAR99' WHEN 5 THEN 'distribution statement a' ELSE 'no marking' END"


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'CUI' WHEN 1 THEN 'FOUO' WHEN 2 THEN 'distribution_statement' WHEN 3 THEN 'proprietary,source_selection' WHEN 4 THEN 'export_control' ELSE '' END AS said, CASE o_orderkey % 7 WHEN 1 THEN 'FOUO' WHEN 2 THEN 'distribution_statement' ELSE '' END AS shown FROM orders")
def markings_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Markings that a line mentions, and those it shows as a banner."""
    t = F.expr(_WORDING)
    return read_table(spark, d, "orders").select("o_orderkey", F.array_join(C.markings(t), ",").alias("said"), F.array_join(C.banner_markings(t), ",").alias("shown"))


_ITEMS = {
    "☒ (1) 52.203-6 Restrictions": ("⟦X⟧ (1) 52.203-6 Restrictions", None),
    "☐ (2) 52.203-13 Code": ("⟦ ⟧ (2) 52.203-13 Code", None),
    "✓ 52.209-6 Protecting": ("⟦X⟧ 52.209-6 Protecting", None),
    "■ 52.219-6 Notice": ("⟦X⟧ 52.219-6 Notice", None),
    "[X] (44) Option": ("⟦X⟧ (44) Option", "CHECKLIST_SELECTED"),
    "__ (43) 52.222-3": ("__ (43) 52.222-3", "CHECKLIST_NOT_SELECTED"),
    "( ) none": ("⟦ ⟧ none", None),
    "a ■ in text": ("a ■ in text", None),
}
_ITEM_SQL = "CASE l_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_ITEMS)) + " END"


@query(f"SELECT t AS line, CASE t {' '.join(f"WHEN '{x}' THEN '{m}'" for x, (m, _) in _ITEMS.items())} END AS marked, CASE t {' '.join(f"WHEN '{x}' THEN '{s}'" for x, (_, s) in _ITEMS.items() if s)} END AS typed, count(*) AS n FROM (SELECT {_ITEM_SQL} AS t FROM lineitem) GROUP BY ALL")
def boxes_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of text lines as markers, and the state of boxes typed as text."""
    lines = read_table(spark, d, "lineitem").selectExpr(f"{_ITEM_SQL} AS line")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).select("line", C.marked_line(F.col("line")).alias("marked"), B.typed_box(F.col("line")).alias("typed"), "n")


_BLOCK = ("text", "text", "⟦X⟧ other", "__X__ (3)", "⟦?⟧ (i) item", "text")


@query("SELECT o_orderkey AS page_id, k AS line_no, CASE WHEN k = 5 OR o_orderkey % 2 = 0 THEN 'SELECTED' ELSE 'NOT_SELECTED' END AS state FROM orders, (SELECT unnest([0, 1, 2, 5]) AS k)")
def carried_block_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that the lines of a block, and items without a box of their own, take over."""
    first = F.when(F.col("o_orderkey") % 2 == 0, "⟦X⟧ 27a. Clauses").otherwise("⟦ ⟧ 27b. Terms")
    text = F.concat_ws("\n", first, *[F.lit(x) for x in _BLOCK])
    pages = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), text.alias("text_layout"))
    return D.S.carried_boxes(pages)


@query("WITH o AS (SELECT DISTINCT concat('52.2', lpad(CAST(l_partkey % 50 AS VARCHAR), 2, '0'), '-', l_partkey % 60 + 100) AS number FROM lineitem) SELECT number, 'FAR' AS regulation, 'overlay_only' AS status, 'new' AS title, 'text' AS overlay_status FROM o UNION ALL SELECT '52.101-1', 'FAR', 'active', NULL, NULL")
def overlay_rows(spark: SparkSession, d: str) -> DataFrame:
    """Texts of an overlay that the registry lacks become rows of it, once."""
    o = read_table(spark, d, "lineitem").selectExpr("concat('52.2', lpad(cast(l_partkey % 50 AS string), 2, '0'), '-', l_partkey % 60 + 100) AS number", "'text' AS status", "'new' AS title")
    g = spark.range(1).selectExpr("'52.101-1' AS number", "'FAR' AS regulation", "'active' AS status", "cast(null AS string) AS title")
    once = R.merge_overlay(g, o)
    return R.merge_overlay(once.drop("overlay_status"), o)


# ---- geometry: order lines as drawings

_BOXES = "b AS (SELECT l_orderkey AS page_id, l_linenumber AS k, CAST(l_partkey % 60 AS DOUBLE) AS x, CAST(l_suppkey % 40 AS DOUBLE) AS y, CAST(l_quantity % 18 AS DOUBLE) AS w FROM lineitem), t AS (SELECT page_id, k AS line_no, x + 10 AS lx0, y AS ly0, y + 12 AS ly1 FROM b WHERE k % 2 = 0), f AS (SELECT page_id, k AS field, x + w AS x1, y AS y0, y + w AS y1 FROM b WHERE k % 2 = 1)"


def _drawings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = read_table(spark, d, "lineitem").selectExpr("l_orderkey AS page_id", "l_linenumber AS k", "cast(l_partkey % 60 AS double) AS x", "cast(l_suppkey % 40 AS double) AS y", "cast(l_quantity % 18 AS double) AS w")
    lines = b.where("k % 2 = 0").selectExpr("page_id", "k AS line_no", "x + 10 AS lx0", "y AS ly0", "y + 12 AS ly1")
    return b.where("k % 2 = 1").selectExpr("page_id", "k AS field", "x + w AS x1", "y AS y0", "y + w AS y1", "w"), lines


@query(f"WITH {_BOXES} SELECT page_id, field, arg_min(line_no, (lx0 - x1, line_no)) AS line_no FROM f JOIN t USING (page_id) WHERE (y0 + y1) / 2 BETWEEN ly0 AND ly1 AND lx0 - x1 BETWEEN -4 AND 80 GROUP BY ALL")
def field_lines(spark: SparkSession, d: str) -> DataFrame:
    fields, lines = _drawings(spark, d)
    return G.fields_to_lines(fields, lines)


@query(f"WITH {_BOXES} SELECT page_id, field AS square, min(line_no) AS line_no FROM f JOIN t USING (page_id) WHERE ly0 - y0 BETWEEN -2 AND 14 GROUP BY ALL")
def square_lines(spark: SparkSession, d: str) -> DataFrame:
    fields, lines = _drawings(spark, d)
    return G.squares_to_lines(fields.withColumnRenamed("field", "square"), lines)


@query("SELECT CASE WHEN w BETWEEN 5 AND 14 AND h BETWEEN 5 AND 14 AND abs(w - h) <= 2 THEN CASE WHEN l_returnflag IN ('R', 'A') THEN 'X' ELSE ' ' END END AS state, count(*) AS n FROM (SELECT CAST(l_quantity % 18 AS DOUBLE) AS w, CAST(l_partkey % 18 AS DOUBLE) AS h, l_returnflag FROM lineitem) GROUP BY ALL")
def square_states(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    state = G.square_state(F.col("l_quantity").cast("double") % 18, (F.col("l_partkey") % 18).cast("double"), flag == "R", flag == "A", F.lit(False), flag == "N")
    return read_table(spark, d, "lineitem").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


# ---- panels and models

_LETTER = "upper(left(regexp_replace(label, '\\s', '', 'g'), 1))"
_PAIR = f"g AS (SELECT doc_id, {D._NUMBER.format('number')} AS number, lower(trim(annotator)) AS annotator, arg_max({_LETTER}, ({_LETTER}, labelled_at)) AS label FROM gold_labels WHERE label IS NOT NULL AND annotator IS NOT NULL AND lower(trim(annotator)) NOT LIKE 'majority of%' GROUP BY ALL), v AS (SELECT min(annotator) AS a, max(annotator) AS b FROM g), p AS (SELECT x.label AS a, y.label AS b FROM v JOIN g x ON x.annotator = v.a JOIN g y ON y.annotator = v.b AND x.doc_id = y.doc_id AND x.number = y.number)"
_PAIR = _PAIR.replace(f"arg_max({_LETTER}, ({_LETTER}, labelled_at))", f"max({_LETTER})")


def _votes(spark: SparkSession, d: str) -> DataFrame:
    """The largest label each annotator gave an item: a stand-in that any engine breaks ties of alike."""
    name, letter = F.lower(F.trim("annotator")), F.upper(F.substring(F.regexp_replace("label", r"\s", ""), 1, 1))
    g = read_table(spark, d, "gold_labels").where(F.col("label").isNotNull() & F.col("annotator").isNotNull() & ~name.like("majority of%"))
    return g.groupBy("doc_id", D.number_key(F.col("number")).alias("number"), name.alias("annotator")).agg(F.max(letter).alias("label"))


@query(
    f"WITH {_PAIR}, d AS (SELECT * FROM p WHERE a <> 'U' AND b <> 'U'), s AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS same, count(*) FILTER ((a = 'B') = (b = 'B')) AS same2, count(*) FILTER (a = 'B') AS na, count(*) FILTER (b = 'B') AS nb FROM d), "
    "e AS (SELECT coalesce(sum(x.n * y.n), 0) AS pe FROM (SELECT a AS l, count(*) AS n FROM d GROUP BY ALL) x JOIN (SELECT b AS l, count(*) AS n FROM d GROUP BY ALL) y USING (l)), "
    "r AS (SELECT s.*, same / n AS po, pe / (n * n) AS pc, same2 / n AS po2, (na * nb + (n - na) * (n - nb)) / (n * n) AS pc2 FROM s, e) "
    "SELECT (SELECT count(*) FROM p) AS n_items, (SELECT count(*) FROM p WHERE a = 'U' OR b = 'U') AS n_open, n AS n_decided, round(po, 6) AS agreement, round(CASE WHEN pc = 1 THEN 1 ELSE (po - pc) / (1 - pc) END, 6) AS kappa, round(CASE WHEN pc2 = 1 THEN 1 ELSE (po2 - pc2) / (1 - pc2) END, 6) AS kappa_binding FROM r"
)
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The first annotator by name against the last."""
    g = _votes(spark, d)
    ends = g.agg(F.min("annotator").alias("first"), F.max("annotator").alias("last"))
    x, y = (g.join(F.broadcast(ends), F.col("annotator") == F.col(c)).select("doc_id", "number", F.col("label").alias(a)) for c, a in (("first", "a"), ("last", "b")))
    return P.judge_agreement(x.join(y, ["doc_id", "number"]), F.col("a"), F.col("b"))


@query(
    f"WITH {_PAIR.split(', v AS')[0]}, k AS (SELECT x.doc_id, x.number, x.annotator, x.label AS own, y.label, count(*) AS k FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.number = y.number AND x.annotator <> y.annotator GROUP BY ALL HAVING count(*) >= 2), "
    "r AS (SELECT doc_id, number, annotator, min(own) AS own, min(label) AS reference FROM k GROUP BY ALL HAVING count(*) = 1) SELECT annotator AS voter, count(*) AS n, round(avg((own = reference)::INT), 6) AS accuracy FROM r GROUP BY ALL"
)
def accuracy_ceiling(spark: SparkSession, d: str) -> DataFrame:
    v = _votes(spark, d).select(F.struct("doc_id", "number").alias("item"), F.col("annotator").alias("voter"), "label")
    return P.accuracy_ceiling(v)


_SYSTEM = f"{MENTIONS}, u AS (SELECT DISTINCT doc_id, number FROM m WHERE source = 'model'), s AS (SELECT doc_id, number, max(b) AS q FROM m WHERE e = 0 GROUP BY ALL), g AS (SELECT doc_id, number, bool_or(y) AS gold FROM m GROUP BY ALL), j AS (SELECT g.*, coalesce(s.q, 0) AS q FROM g SEMI JOIN u USING (doc_id, number) LEFT JOIN s USING (doc_id, number))"


def _gold_system(spark: SparkSession, d: str) -> DataFrame:
    m = derived_mentions(spark, d)
    gold = m.groupBy("doc_id", "number").agg(F.bool_or("y").alias("gold"))
    system = m.where("e = 0").groupBy("doc_id", "number").agg(F.max("b").alias("q"))
    return P.gold_with_system(gold, system, P.labelled_universe(m))


@query(f"WITH {_SYSTEM} SELECT doc_id, number, gold, q FROM j")
def gold_with_system(spark: SparkSession, d: str) -> DataFrame:
    return _gold_system(spark, d)


@query(f"WITH {_SYSTEM} SELECT doc_id, number, CASE WHEN gold THEN 'false_negative' ELSE 'false_positive' END AS error FROM j WHERE gold <> (q >= 0.5)")
def evaluation_errors(spark: SparkSession, d: str) -> DataFrame:
    return P.errors(_gold_system(spark, d), F.col("q") >= 0.5, F.col("gold")).select("doc_id", "number", "error")


@query("SELECT l_orderkey, l_linenumber, round((l_partkey % 10 + l_suppkey % 10) / 30.0, 6) AS binding_prob, round((l_partkey % 7) / 30.0, 6) AS exclusion_prob FROM lineitem")
def role_masses(spark: SparkSession, d: str) -> DataFrame:
    """Binding and exclusion probability from a map of role probabilities."""
    p = F.create_map(F.lit("FULL_TEXT"), F.expr("(l_partkey % 10) / 30.0D"), F.lit("CHECKLIST_SELECTED"), F.expr("(l_suppkey % 10) / 30.0D"), F.lit("EXPLICITLY_EXCLUDED"), F.expr("(l_partkey % 7) / 30.0D"), F.lit("UNCLEAR"), F.lit(0.1))
    b, e = M.role_masses(p)
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(b, 6).alias("binding_prob"), F.round(e, 6).alias("exclusion_prob"))


@query(f"WITH {MENTIONS}, n AS (SELECT doc_id, number, max(b) AS q, count(*) AS n, count(*) FILTER (source = 'model') AS n_model FROM m GROUP BY ALL) SELECT doc_id, number, round(CASE WHEN n_model > 0 THEN 1 / (1 + exp(-(-1 + 2.5 * q + 0.125 * n))) ELSE q END, 6) AS q, n_model > 0 AS stacked FROM n")
def stacked_numbers(spark: SparkSession, d: str) -> DataFrame:
    """A second model over number features takes over where the first one decided a mention."""
    n = derived_mentions(spark, d).groupBy("doc_id", "number").agg(F.max("b").alias("q"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "model").alias("n_model"))
    return M.stacked(n, {"q": 2.5, "n": 0.125}, -1.0).select("doc_id", "number", F.round("stacked_q", 6).alias("q"), "stacked")


# ---- the service


@query()
def documents_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of every document of the collection."""
    status = R.section_status(D.snapshots(spark, d)).select("number", "status")
    posted = read_table(spark, d, "filings").where(~F.col("duplicate")).groupBy("doc_id").agg(F.min("posted_date").alias("day"))
    return document_ledger(D.pages(spark, d), status, D._versions(spark, d), posted)
