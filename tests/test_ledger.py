import pytest
from pyspark.sql import functions as F

from docuplane.operators import evaluation as E
from docuplane.operators import ledger as L

M = "doc_id string, number string, alternate string, b double, e double"


def test_probabilities(spark):
    m = spark.createDataFrame([("d", "1", None, 0.5, 0.0), ("d", "1", None, 0.5, 0.0), ("d", "2", None, 0.8, 0.5), ("d", "2", "A", 0.9, None), ("d", "3", None, 1.0, 0.0)], M)
    got = {(r["number"], r["alternate"]): round(r["q"], 9) for r in L.ledger_probabilities(m).collect()}
    assert got == {("1", None): 0.75, ("2", None): 0.4, ("2", "A"): 0.45, ("3", None): 1.0}
    assert {round(r["q"], 9) for r in L.ledger_probabilities(m, "max").collect()} == {0.5, 0.4, 0.45, 1.0}
    with pytest.raises(ValueError):
        L.ledger_probabilities(m, "sum")
    with pytest.raises(ValueError):
        L.verdict(F.lit(0.5), 0.4)


def test_veto_reaches_all_alternates(spark):
    rows = [("d", "1", None, "SEL", 0.9, 1, False), ("d", "1", "A", "EXC", 0.8, 1, False), ("d", "2", None, "SEL", 0.9, 2, False), ("d", "2", None, "SEL", 0.5, 3, False), ("d", "3", None, "SEL", 0.9, 1, True)]
    m = spark.createDataFrame(rows, "doc_id string, number string, alternate string, role string, confidence double, page int, from_range boolean")
    got = L.binding_ledger(m, F.col("role") == "SEL", F.col("role") == "EXC").collect()
    assert [(r["number"], r["n"], r["confidence"], r["pages"]) for r in got] == [("2", 2, 0.5, [2, 3])]


def test_headings_and_context(spark):
    lines = [("d", 1, i, h) for i, h in enumerate(["A", None, "B", "C", "D", None])]
    df = spark.createDataFrame(lines, "doc_id string, page int, line_no int, heading string")
    got = {r["line_no"]: r["breadcrumb"] for r in L.preceding_headings(df).collect()}
    assert got == {0: [], 1: ["A"], 2: ["A"], 3: ["A", "B"], 4: ["A", "B", "C"], 5: ["B", "C", "D"]}
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", " ", "c", "d"])], "page_id long, line_no int, line string")
    assert [r["context"] for r in L.context_window(df, 1, 2).orderBy("line_no").collect()] == ["a | c", "a | c | d", "c | d", "c | d"]


def test_thresholds_and_auc(spark):
    q, y = [0.1, 0.4, 0.4, 0.8, 0.9], [False, False, True, True, True]
    df = spark.createDataFrame(list(zip(q, y)), "q double, y boolean")
    assert E.best_f1_threshold(df).first()["threshold"] == 0.4
    assert abs(E.roc_auc(df).first()["auc"] - (2 * 2 + 1.5) / 6) < 1e-12
    assert E.coverage_threshold(df, 1.0).first()["t"] == 0.8
    assert E.coverage_threshold(df.where("q < 0"), 0.5).count() == 0


def test_calibration_bins_like_equal_split(spark):
    conf = [i / 23 for i in range(23)]
    ok = [i % 3 > 0 for i in range(23)]
    want, at = 0.0, 0
    for k in range(10):
        n = 23 // 10 + (k < 23 % 10)
        c, o = conf[at : at + n], ok[at : at + n]
        want += n / 23 * abs(sum(c) / n - sum(o) / n)
        at += n
    got = E.calibration_error(spark.createDataFrame(list(zip(conf, ok)), "conf double, correct boolean")).first()["ece"]
    assert abs(got - want) < 1e-9


def test_temperature(spark):
    import numpy as np

    r = np.random.default_rng(1)
    z = r.normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = [int(r.choice(3, p=x)) for x in p]
    df = spark.createDataFrame([([float(v) * 2.5 for v in a], b) for a, b in zip(z, y)], "logits array<double>, label int")
    assert abs(E.fit_temperature(df) - 2.5) < 0.25
    assert abs(sum(df.select(E.softmax(F.col("logits"), 2.0)).first()[0]) - 1) < 1e-9


def test_adjudication_and_kappa(spark):
    v = [("i", "a", "B"), ("i", "b", "B"), ("j", "a", "B"), ("j", "b", "N"), ("k", "a", "N"), ("k", "b", "N"), ("k", "c", "B"), ("l", "a", "R")]
    df = spark.createDataFrame(v, "item string, voter string, label string")
    got = {r["item"]: (r["label"], r["tier"]) for r in E.adjudicate(df).collect()}
    assert got == {"i": ("B", "unanimous"), "j": ("UNCLEAR", "split"), "k": ("N", "majority"), "l": ("R", "majority")}
    k = {(r["voter_a"], r["voter_b"]): r for r in E.pairwise_kappa(df).collect()}
    assert k["a", "b"]["n"] == 3 and abs(k["a", "b"]["kappa"] - (2 / 3 - 4 / 9) / (5 / 9)) < 1e-9
