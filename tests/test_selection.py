"""Joins that must match, picks, panels, geometry and the ledger of documents."""

import random

import pytest
from pyspark.sql import functions as F

from docuplane.operators import acquisition as A
from docuplane.operators import evaluation as E
from docuplane.operators import geometry as G
from docuplane.operators import panel as P
from docuplane.operators import selection as S
from docuplane.operators.service import SCANNED, document_ledger

PAGE = "page_id long, doc_id string, page int, text_layout string, scanned boolean"


def test_must_match(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert sorted(tuple(x) for x in S.must_match(left, right, "k").collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="no match for k 9"):
        S.must_match(left.unionByName(spark.createDataFrame([(9,)], "k int")), right, "k").collect()
    assert S.must_match(left.limit(0), right, "k").count() == 0


def test_defaults_and_spacing(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "i int, k string")
    lookup = spark.createDataFrame([("a", "x"), ("a", "w"), ("b", "y")], "k string, v string")
    assert sorted((x["i"], x["v"]) for x in S.with_default(rows, lookup, "k", "v", "-").collect()) == [(1, "w"), (2, "-"), (3, "-")]
    many = spark.createDataFrame([("g", i) for i in range(11)] + [("h", 1)], "g string, i int")
    got = sorted((x["g"], x["i"]) for x in S.evenly_spaced(many, 3, "g", "i").collect())
    assert got == [("g", 0), ("g", 5), ("g", 10), ("h", 1)]


def test_capped_pick(spark):
    rows = [(f"d{i}", "S" if i % 3 else "M", "big" if i % 2 else f"x{i}") for i in range(90)]
    got = S.capped_by_group(spark.createDataFrame(rows, "doc_id string, stratum string, department string"), 10, 3).collect()
    for s in "SM":
        of = [x["department"] for x in got if x["stratum"] == s]
        assert len(of) == 10 and of.count("big") <= 3


def test_rounds_over_months(spark):
    rows = [(f"n{m}{i}", m, "big" if m == "a" and i < 40 else f"x{m}{i}") for m in "ab" for i in range(50)]
    got = A.balanced_selection(spark.createDataFrame(rows, "notice_id string, month string, department string"), 20, 0.25).where("selected").collect()
    assert [sum(x["month"] == m for x in got) for m in "ab"] == [10, 10] and sum(x["department"] == "big" for x in got) <= 5
    assert sorted(x["rank"] for x in got) == list(range(20))


def test_running_sums(spark):
    r = random.Random(8)
    rows = sorted({r.random() for _ in range(5000)})
    t = spark.createDataFrame([(s, 1 + k % 3) for k, s in enumerate(rows)], "s double, n int").repartition(6)
    total = sum(1 + k % 3 for k in range(len(rows)))
    for down in (False, True):
        got = {x["s"]: x for x in E.running(t, "s", "n", down=down).collect()}
        upto = 0
        for k in range(len(rows))[:: -1 if down else 1]:
            upto += 1 + k % 3
            assert got[rows[k]]["n_upto"] == upto and got[rows[k]]["n_all"] == total
    assert E.running(t.limit(0), "s", "n").count() == 0


def test_judges(spark):
    rows = [("B", "B")] * 6 + [("N", "N")] * 3 + [("B", "N")] + [("U", "B")] * 2
    one = P.judge_agreement(spark.createDataFrame(rows, "a string, b string"), F.col("a"), F.col("b")).first()
    assert (one["n_items"], one["n_open"], one["n_decided"], one["agreement"]) == (12, 2, 10, 0.9)
    assert one["kappa"] == one["kappa_binding"] == round((0.9 - 0.54) / 0.46, 6)
    empty = P.judge_agreement(spark.createDataFrame([], "a string, b string"), F.col("a"), F.col("b")).first()
    assert empty["n_items"] == 0 and empty["kappa"] is None
    votes = spark.createDataFrame([(1, "x", "B"), (1, "y", "B"), (1, "z", "N"), (2, "x", "N"), (2, "y", "N"), (2, "z", "N")], "item int, voter string, label string")
    got = {x["voter"]: (x["n"], x["accuracy"]) for x in P.accuracy_ceiling(votes).collect()}
    assert got == {"x": (1, 1.0), "y": (1, 1.0), "z": (2, 0.5)}


def test_drawings(spark):
    lines = spark.createDataFrame([(1, 0, 30.0, 10.0, 20.0), (1, 1, 50.0, 10.0, 20.0), (1, 2, 30.0, 40.0, 50.0)], "page_id long, line_no int, lx0 double, ly0 double, ly1 double")
    fields = spark.createDataFrame([(1, 7, 28.0, 11.0, 19.0), (1, 8, 200.0, 11.0, 19.0), (2, 9, 1.0, 1.0, 2.0)], "page_id long, field int, x1 double, y0 double, y1 double")
    assert [tuple(x) for x in G.fields_to_lines(fields, lines).collect()] == [(1, 7, 0)]
    squares = spark.createDataFrame([(1, 1, 9.0), (1, 2, 35.0), (1, 3, 90.0)], "page_id long, square int, y0 double")
    assert sorted(tuple(x) for x in G.squares_to_lines(squares, lines).collect()) == [(1, 1, 0), (1, 2, 2)]
    states = spark.createDataFrame([("Off",), ("",), (None,), ("Yes",), ("1",)], "v string").select(G.field_state(F.col("v")).alias("s")).collect()
    assert [x["s"] for x in states] == [" ", " ", " ", "X", "X"]


def test_ledger_of_documents(spark):
    text = "SECTION I CONTRACT CLAUSES\n52.203-6 Restrictions (SEP 2006)\n52.203-7 Anti-Kickback (JUN 2020)\n52.204-9 [Reserved]"
    pages = spark.createDataFrame([(1, "a", 1, text, False), (2, "a", 2, None, None), (3, "s", 1, "52.203-6", True), (4, "e", 1, "", False)], PAGE)
    registry = spark.createDataFrame([("52.203-6", "active"), ("52.203-7", "active"), ("52.204-9", "reserved")], "number string, status string")
    versions = spark.createDataFrame([("52.203-6", "2000-01-01", "9999-12-31", "2006-09"), ("52.203-7", "2000-01-01", None, "2014-05")], "number string, valid_from string, valid_to string, clause_date string")
    posted = spark.createDataFrame([("a", "2021-03-04")], "doc_id string, day string")
    got = {(x["doc_id"], x["number"]): x for x in document_ledger(pages, registry, versions, posted).collect()}
    assert set(got) == {("a", "52.203-6"), ("a", "52.203-7"), ("a", "52.204-9"), ("s", None)}
    first, second, out = (got["a", n] for n in ("52.203-6", "52.203-7", "52.204-9"))
    assert (first["place"], first["tier"], first["currency"]) == (1, "BINDING", "matches")
    assert second["currency"] == "newer" and out["tier"] == "NOT_BINDING" and out["q"] == 0
    assert got["s", None]["warning"] == SCANNED
