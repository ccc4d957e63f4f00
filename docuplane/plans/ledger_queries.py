"""Ledger, evaluation and agreement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuplane.functions.normal import UNSEEN, number_key
from docuplane.operators import evaluation as E
from docuplane.operators import ledger as L
from docuplane.plans.derived import MENTIONS, REGISTRY, derived_mentions, derived_registry
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


_NOISY = "n AS (SELECT doc_id, number, alternate, (1 - product(1 - b)) AS base FROM m GROUP BY ALL), k AS (SELECT doc_id, number, product(1 - e) AS kept FROM m GROUP BY ALL), q AS (SELECT n.*, base * kept AS q FROM n JOIN k USING (doc_id, number))"
_MAX = _NOISY.replace("(1 - product(1 - b))", "max(b)")


@query(f"WITH {MENTIONS}, {_NOISY} SELECT doc_id, number, alternate, round(q, 6) AS q FROM q")
def ledger_noisy_or(spark: SparkSession, d: str) -> DataFrame:
    return L.ledger_probabilities(derived_mentions(spark, d)).withColumn("q", F.round("q", 6))


@query(f"WITH {MENTIONS}, {_MAX} SELECT doc_id, number, alternate, round(q, 6) AS q FROM q")
def ledger_max(spark: SparkSession, d: str) -> DataFrame:
    return L.ledger_probabilities(derived_mentions(spark, d), "max").withColumn("q", F.round("q", 6))


@query(f"WITH {MENTIONS}, {_MAX} SELECT CASE WHEN q >= 0.7 THEN 'BINDING' WHEN q <= 0.3 THEN 'NOT_BINDING' ELSE 'UNDETERMINED' END AS tier, CASE WHEN q >= 0.8 THEN true WHEN q <= 0.19999999999999996 THEN false END AS verdict, count(*) AS n FROM (SELECT round(q, 6) AS q FROM q) GROUP BY ALL")
def tiers(spark: SparkSession, d: str) -> DataFrame:
    q = F.round("q", 6)
    return L.ledger_probabilities(derived_mentions(spark, d), "max").groupBy(L.tier(q).alias("tier"), L.verdict(q, 0.8).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


_ROLES = ("SELECTED", "NOT_SELECTED", "BY_REFERENCE")
_FEATURES = ", ".join(f"coalesce(max(CASE WHEN role = '{r}' THEN b END), 0) AS max_{r.lower()}" for r in _ROLES)


@query(
    f"WITH {MENTIONS}, {_NOISY}, {_MAX.replace('n AS', 'n2 AS').replace('k AS', 'k2 AS').replace('q AS', 'q2 AS').replace('n.*', 'n2.*').replace('FROM n JOIN k ', 'FROM n2 JOIN k2 ')}, "
    f"s AS (SELECT doc_id, number, count(*) AS n, count(*) FILTER (source = 'model') AS n_model, count(*) FILTER (source <> 'model') AS n_rule, round(avg(b), 6) AS bp_mean, min(b) AS bp_min, {_FEATURES} FROM m GROUP BY ALL) "
    "SELECT s.*, round(qmax, 6) AS qmax, round(qnor, 6) AS qnor FROM s JOIN (SELECT doc_id, number, max(q) AS qnor FROM q GROUP BY ALL) USING (doc_id, number) JOIN (SELECT doc_id, number, max(q) AS qmax FROM q2 GROUP BY ALL) USING (doc_id, number)"
)
def number_features(spark: SparkSession, d: str) -> DataFrame:
    f = L.number_features(derived_mentions(spark, d), _ROLES)
    return f.withColumns({c: F.round(c, 6) for c in ("qmax", "qnor", "bp_mean")})


@query(f"WITH {MENTIONS} SELECT doc_id, number, alternate, k, round(b, 4) AS p, source, substring(line_text, 1, 200) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, number, alternate ORDER BY ordinal) AS k FROM m) WHERE k <= 5")
def evidence_top5(spark: SparkSession, d: str) -> DataFrame:
    return L.evidence(derived_mentions(spark, d))


@query(f"WITH {MENTIONS} SELECT doc_id, number, alternate, CASE WHEN bool_or(source = 'model') THEN 'model' ELSE arg_min(source, ordinal) END AS decided_by FROM m GROUP BY ALL")
def decided_by(spark: SparkSession, d: str) -> DataFrame:
    return L.decided_by(derived_mentions(spark, d))


@query(
    f"WITH {MENTIONS}, x AS (SELECT DISTINCT doc_id, number FROM m WHERE e > 0) SELECT doc_id, number, alternate, count(*) AS n, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, min(b) AS confidence, len(list_distinct(list(page))) AS n_pages FROM m ANTI JOIN x USING (doc_id, number) WHERE role <> 'NOT_SELECTED' GROUP BY ALL"
)
def binding_ledger(spark: SparkSession, d: str) -> DataFrame:
    m = derived_mentions(spark, d).withColumns({"confidence": F.col("b"), "from_range": F.lit(False)})
    out = L.binding_ledger(m, F.col("role") != "NOT_SELECTED", F.col("e") > 0)
    return out.select("doc_id", "number", "alternate", "n", F.array_join("roles", ",").alias("roles"), "confidence", F.size("pages").cast("long").alias("n_pages"))


@query(f"WITH {MENTIONS} SELECT doc_id, number, arg_min(cited_date, (-n, cited_date)) AS cited_date FROM (SELECT doc_id, number, cited_date, count(*) AS n FROM m GROUP BY ALL) GROUP BY ALL")
def most_cited_date(spark: SparkSession, d: str) -> DataFrame:
    return L.most_cited(derived_mentions(spark, d))


@query(f"WITH {MENTIONS}, {REGISTRY} SELECT DISTINCT doc_id, number FROM m SEMI JOIN r USING (number)")
def status_quo_ledger(spark: SparkSession, d: str) -> DataFrame:
    return derived_mentions(spark, d).select("doc_id", "number").distinct().join(derived_registry(spark, d), "number", "left_semi")


@query(
    f"WITH {MENTIONS}, {REGISTRY}, b0 AS (SELECT doc_id, number, bool_and(source = 'box_rule' AND role = 'NOT_SELECTED') AS empty_box FROM m SEMI JOIN r USING (number) GROUP BY ALL), p AS (SELECT doc_id, count(*) FILTER (empty_box) AS k, count(*) AS n FROM b0 GROUP BY ALL) "
    "SELECT CAST(sum(k) AS BIGINT) AS n_empty_box, CAST(sum(n) AS BIGINT) AS n_total, round(sum(k) / sum(n), 6) AS share, count(*) FILTER (k > 0) AS n_documents, median(k) FILTER (k > 0) AS median_per_document FROM p"
)
def empty_box_overcount(spark: SparkSession, d: str) -> DataFrame:
    """How many numbers the status quo counts although every mention is an empty box."""
    m = derived_mentions(spark, d).join(derived_registry(spark, d), "number", "left_semi")
    b0 = m.groupBy("doc_id", "number").agg(F.bool_and((F.col("source") == "box_rule") & (F.col("role") == "NOT_SELECTED")).alias("empty_box"))
    p = b0.groupBy("doc_id").agg(F.count_if("empty_box").alias("k"), F.count(F.lit(1)).alias("n"))
    return p.agg(F.sum("k").alias("n_empty_box"), F.sum("n").alias("n_total"), F.round(F.sum("k") / F.sum("n"), 6).alias("share"), F.count_if(F.col("k") > 0).alias("n_documents"), F.expr("percentile(k, 0.5) FILTER (WHERE k > 0)").alias("median_per_document"))


@query(
    f"WITH {MENTIONS}, {REGISTRY}, {_MAX}, b0 AS (SELECT doc_id, count(DISTINCT number) AS n0 FROM m SEMI JOIN r USING (number) GROUP BY ALL), b1 AS (SELECT doc_id, count(DISTINCT number) AS n1 FROM q WHERE q >= 0.5 GROUP BY ALL), "
    "j AS (SELECT year(o_orderdate) AS era, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1 FROM orders LEFT JOIN b0 ON doc_id = o_orderkey LEFT JOIN b1 ON b1.doc_id = o_orderkey) SELECT CAST(era AS INT) AS era, count(*) AS n_documents, CAST(sum(n0) AS BIGINT) AS size_status_quo, CAST(sum(n1) AS BIGINT) AS size_model, round(sum(n1) / nullif(sum(n0), 0), 6) AS ratio, median(n1 - n0) AS median_difference FROM j GROUP BY ALL"
)
def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Ledger sizes of two methods by era; documents without mentions count with zeros."""
    m = derived_mentions(spark, d)
    b0 = m.join(derived_registry(spark, d), "number", "left_semi").groupBy("doc_id").agg(F.countDistinct("number").alias("n0"))
    b1 = L.ledger_probabilities(m, "max").where("q >= 0.5").groupBy("doc_id").agg(F.countDistinct("number").alias("n1"))
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("era"))
    j = o.join(b0, "doc_id", "left").join(b1, "doc_id", "left").na.fill(0, ["n0", "n1"])
    return j.groupBy("era").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n0").alias("size_status_quo"), F.sum("n1").alias("size_model"), F.round(F.try_divide(F.sum("n1").cast("double"), F.sum("n0").cast("double")), 6).alias("ratio"), F.expr("percentile(n1 - n0, 0.5)").alias("median_difference"))


_CONF = "c AS (SELECT doc_id, count(*) FILTER (b >= 0.5 AND y) AS tp, count(*) FILTER (b >= 0.5 AND NOT y) AS fp, count(*) FILTER (b < 0.5 AND y) AS fn, count(*) FILTER (b < 0.5 AND NOT y) AS tn FROM m GROUP BY ALL)"


def _confusion(spark: SparkSession, d: str, t: float = 0.5) -> DataFrame:
    return E.confusion(derived_mentions(spark, d), F.col("b") >= t, F.col("y"), "doc_id")


@query(f"WITH {MENTIONS}, {_CONF} SELECT * FROM c")
def confusion_by_doc(spark: SparkSession, d: str) -> DataFrame:
    return _confusion(spark, d)


@query(
    f"WITH {MENTIONS}, s AS (SELECT source, count(*) FILTER (b >= 0.5 AND y) AS tp, count(*) FILTER (b >= 0.5 AND NOT y) AS fp, count(*) FILTER (b < 0.5 AND y) AS fn, count(*) FILTER (b < 0.5 AND NOT y) AS tn FROM m GROUP BY ALL) "
    "SELECT source, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f, round(tn / (tn + fp), 6) AS specificity, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM s"
)
def scores_by_system(spark: SparkSession, d: str) -> DataFrame:
    c = E.confusion(derived_mentions(spark, d), F.col("b") >= 0.5, F.col("y"), "source")
    s = E.scores(c, "source")
    return s.select("source", *[F.round(x, 6).alias(x) for x in s.columns[1:]])


_DRAW = "((u + 1) * 48271 + (rep + 1) * 69621 + (u + 1) * (rep + 1) * 16807) % 1000003 / 1000003.0"
_STEPS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
_COUNT = "CASE " + " ".join(f"WHEN x < {v!r} THEN {k}" for k, v in enumerate(_STEPS)) + " ELSE 6 END"


def _boot_sql(f: str, sums: str) -> str:
    return (
        f"WITH {MENTIONS}, {_CONF}, c3 AS (SELECT doc_id, count(*) FILTER (b >= 0.3 AND y) AS tp2, count(*) FILTER (b >= 0.3 AND NOT y) AS fp2, count(*) FILTER (b < 0.3 AND y) AS fn2 FROM m GROUP BY ALL), "
        f"d AS (SELECT *, {_COUNT} AS w FROM (SELECT c.*, tp2, fp2, fn2, rep, {_DRAW.replace('u', 'c.doc_id')} AS x FROM c JOIN c3 USING (doc_id), range(100) t(rep))), "
        f"s AS (SELECT rep, {sums} FROM d GROUP BY rep) SELECT round(quantile_cont(f, 0.025), 6) AS lo, round(quantile_cont(f, 0.975), 6) AS hi, round(avg(CASE WHEN f <= 0 THEN 1.0 ELSE 0 END), 6) AS share_not_better FROM (SELECT {f} AS f FROM s)"
    )


_SUMS = ", ".join(f"sum({c} * w) AS {c}" for c in ("tp", "fp", "fn", "tp2", "fp2", "fn2"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query(_boot_sql("2 * tp / (2 * tp + fp + fn)", _SUMS))
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.bootstrap(_confusion(spark, d).withColumnRenamed("doc_id", "unit"), reps=100))


@query(_boot_sql("2 * tp2 / (2 * tp2 + fp2 + fn2) - 2 * tp / (2 * tp + fp + fn)", _SUMS))
def bootstrap_paired(spark: SparkSession, d: str) -> DataFrame:
    m = derived_mentions(spark, d)
    b, y = F.col("b"), F.col("y")
    both = m.groupBy(F.col("doc_id").alias("unit")).agg(*[F.count_if(c).alias(n) for n, c in (("tp", (b >= 0.5) & y), ("fp", (b >= 0.5) & ~y), ("fn", (b < 0.5) & y), ("tp2", (b >= 0.3) & y), ("fp2", (b >= 0.3) & ~y), ("fn2", (b < 0.3) & y))])
    return _rounded(E.bootstrap(both, reps=100, systems=("half", "third")))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return derived_mentions(spark, d).select(F.col("b").alias("q"), "y")


@query(f"WITH {MENTIONS} SELECT round(avg((b - y::INT) * (b - y::INT)), 6) AS brier, round(avg(-(y::INT * ln(p) + (1 - y::INT) * ln(1 - p))), 6) AS log_loss FROM (SELECT *, least(greatest(b, 1e-12), 1 - 1e-12) AS p FROM m)")
def brier_logloss(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.probability_losses(_judged(spark, d)))


@query(
    f"WITH {MENTIONS}, g AS (SELECT b AS conf, count(*) AS n, count(*) FILTER (y) AS c FROM m GROUP BY b), w AS (SELECT *, sum(n) OVER (ORDER BY conf) AS hi, sum(n) OVER () AS total FROM g), "
    "x AS (SELECT *, greatest(0, least(hi, (bin + 1) * (total // 10) + least(bin + 1, total % 10)) - greatest(hi - n, bin * (total // 10) + least(bin, total % 10))) AS k FROM w, range(10) t(bin)), y AS (SELECT bin, abs(sum(k * conf) - sum(k * c / n)) / any_value(total) AS part FROM x WHERE k > 0 GROUP BY bin) SELECT round(sum(part), 6) AS ece FROM y"
)
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.calibration_error(derived_mentions(spark, d).select(F.col("b").alias("conf"), F.col("y").alias("correct"))))


_RISK = "g AS (SELECT round(greatest(b, 1 - b), 9) AS conf, count(*) AS n, count(*) FILTER ((b >= 0.5) <> y) AS bad FROM m GROUP BY ALL), k AS (SELECT conf, n, sum(n) OVER (ORDER BY conf DESC) / sum(n) OVER () AS coverage, sum(bad) OVER (ORDER BY conf DESC) / sum(n) OVER (ORDER BY conf DESC) AS risk FROM g)"


@query(f"WITH {MENTIONS}, {_RISK} SELECT conf, n, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM k")
def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    return E.risk_coverage(_judged(spark, d)).select("conf", "n", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query(f"WITH {MENTIONS}, {_RISK} SELECT min(conf) AS t, round(arg_min(coverage, conf), 6) AS coverage, round(1 - arg_min(risk, conf), 6) AS accuracy FROM k WHERE 1 - risk >= 0.45")
def coverage_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.coverage_threshold(_judged(spark, d), 0.45))


_CURVE = "g AS (SELECT b AS s, count(*) AS n, count(*) FILTER (y) AS g FROM m GROUP BY b), k AS (SELECT s, n, g, sum(g) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS pos, sum(g) OVER () AS p, sum(n - g) OVER () AS neg, sum(n - g) OVER (ORDER BY s DESC) AS fp FROM g)"


@query(f"WITH {MENTIONS}, {_CURVE} SELECT s AS threshold, round(f1, 6) AS f1 FROM (SELECT s, round(2 * tp / (pos + p), 12) AS f1 FROM k) ORDER BY f1 DESC, s LIMIT 1")
def best_f1(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.best_f1_threshold(_judged(spark, d)))


@query(f"WITH {MENTIONS}, {_CURVE} SELECT round(sum(g * (neg - fp + (n - g) / 2.0)) / (any_value(p) * any_value(neg)), 6) AS auc FROM k")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.roc_auc(_judged(spark, d)))


@query(f"WITH {MENTIONS}, {_CURVE} SELECT round(1 - arg_max(fp / neg, s), 6) AS specificity, max(s) AS threshold FROM k WHERE tp / p >= 0.95")
def specificity_at_recall(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.specificity_at_recall(_judged(spark, d)))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    g = read_table(spark, d, "gold_labels")
    name = F.lower(F.trim("annotator"))
    label = F.upper(F.substring(F.regexp_replace("label", UNSEEN, ""), 1, 1))
    last = g.where(~name.startswith("majority of")).groupBy("doc_id", number_key(F.col("number")).alias("number"), name.alias("voter")).agg(F.max(F.struct("labelled_at", label.alias("label"))).alias("v"))
    return last.select(F.concat_ws("|", "doc_id", "number").alias("item"), "voter", F.col("v.label").alias("label")).where(F.col("label").isin("B", "N", "R"))


_VOTES = (
    "v AS (SELECT doc_id || '|' || number AS item, voter, arg_max(label, labelled_at) AS label FROM (SELECT doc_id, regexp_replace(translate(number, '‐‑‒–—―−', '-------'), '[\\s\\p{Z}\\p{Cf}]', '', 'g') AS number, lower(trim(annotator)) AS voter, labelled_at, "
    "coalesce(upper(left(trim(label), 1)), '') AS label FROM gold_labels) WHERE voter NOT LIKE 'majority of%' GROUP BY ALL HAVING arg_max(label, (labelled_at, label)) IN ('B', 'N', 'R'))"
).replace("arg_max(label, labelled_at)", "arg_max(label, (labelled_at, label))").replace(" GROUP BY ALL", " GROUP BY doc_id, number, voter")


@query(f"WITH {_VOTES}, c AS (SELECT item, label, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT item, arg_max(label, (n, label)) AS top, max(n) AS agree, CAST(sum(n) AS BIGINT) AS voters FROM c GROUP BY ALL), x AS (SELECT *, CASE WHEN agree = voters AND voters > 1 THEN 'unanimous' WHEN agree * 2 > voters THEN 'majority' ELSE 'split' END AS tier FROM t) SELECT item, CASE WHEN tier <> 'split' THEN top ELSE 'UNCLEAR' END AS label, tier, agree, voters FROM x")
def adjudicated_votes(spark: SparkSession, d: str) -> DataFrame:
    return E.adjudicate(_votes(spark, d))


@query(f"WITH {_VOTES}, c AS (SELECT item, count(*) FILTER (label = 'B') AS b, count(*) FILTER (label IN ('N', 'R')) AS n FROM v GROUP BY ALL) SELECT item, CASE WHEN b >= 2 THEN 'B' WHEN n >= 2 THEN 'N' ELSE 'U' END AS label FROM c")
def majority_gold(spark: SparkSession, d: str) -> DataFrame:
    return E.majority_gold(_votes(spark, d))


@query(
    f"WITH {_VOTES}, p AS (SELECT a.voter AS voter_a, b.voter AS voter_b, a.label AS la, b.label AS lb FROM v a JOIN v b ON a.item = b.item AND a.voter < b.voter), t AS (SELECT voter_a, voter_b, count(*) AS n, avg((la = lb)::INT) AS po FROM p GROUP BY ALL), "
    "l AS (SELECT voter_a, voter_b, sum(x * y) AS pe FROM (SELECT voter_a, voter_b, la AS l, count(*) AS x FROM p GROUP BY ALL) JOIN (SELECT voter_a, voter_b, lb AS l, count(*) AS y FROM p GROUP BY ALL) USING (voter_a, voter_b, l) GROUP BY ALL) SELECT voter_a, voter_b, n, round(po, 6) AS agreement, round((po - pe / (n * n)) / (1 - pe / (n * n)), 6) AS kappa FROM t JOIN l USING (voter_a, voter_b)"
)
def kappa_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = E.pairwise_kappa(_votes(spark, d))
    return k.select("voter_a", "voter_b", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))
