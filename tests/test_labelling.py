from pyspark.sql import functions as F

from docuplane.operators import labelling as N


def test_contexts(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["top", " ", "see 52.1-1 and 52.1-1", "x" * 300])], "page_id long, line_no int, line string")
    m = spark.createDataFrame([("c", 1, 2, "52.1-1"), ("d", 1, 0, "none")], "cand_id string, page_id long, line_no int, number string")
    got = {r["cand_id"]: r["context"] for r in N.neutral_contexts(m, lines).collect()}
    assert got["c"] == "top\nsee >>> 52.1-1 <<< and 52.1-1\n" + "x" * 240 and got["d"].startswith("top\nsee 52.1-1")


def test_batches(spark):
    items = spark.createDataFrame([("d", f"c{i:02d}", "x" * n) for i, n in enumerate([10] * 11 + [95, 10, 200, 5])] + [("e", "c", None)], "doc_id string, cand_id string, context string")
    got = {(r["doc_id"], r["cand_id"]): r["batch"] for r in N.request_batches(items, 10, 100).collect()}
    assert [got["d", f"c{i:02d}"] for i in range(15)] == [0] * 10 + [1, 2, 3, 4, 5] and got["e", "c"] == 0


def test_answers_and_intake(spark):
    df = spark.createDataFrame([('Sure: "a-1": "B", **b**: n\nc = U; a-1: R; junk: Z',), ("",)], "s string")
    assert [r["m"] for r in df.select(N.parsed_labels(F.col("s")).alias("m")).collect()] == [{"a-1": "R", "b": "N", "c": "U"}, {}]
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in ("abb", "bc"))
    assert sorted(map(tuple, N.intake_differences(a, b, "k").collect())) == [("a", "missing"), ("c", "extra")]


def test_agreement_and_panel(spark):
    r = N.role_agreement(spark.createDataFrame([("X", "X"), ("X", "Y"), ("Z", "X")], "p string, t string"), "p", "t", ("X", "Y")).first()
    assert abs(r["role"] - 1 / 3) < 1e-9 and abs(r["binding"] - 2 / 3) < 1e-9
    rows = [("d", "1", None, "X"), ("d", "1", "A", "OUT"), ("d", "2", None, "UNCLEAR"), ("d", "3", None, "X"), ("d", "4", None, "Q")]
    got = {(x["number"], x["alternate"]): x["status"] for x in N.panel_ledger(spark.createDataFrame(rows, "doc_id string, number string, alternate string, role string"), ("X",), "OUT").collect()}
    assert got == {("1", None): "excluded", ("1", "A"): "excluded", ("2", None): "uncertain", ("3", None): "binding", ("4", None): "not_binding"}


def test_samples(spark):
    m = spark.createDataFrame([("d", f"n{i}") for i in range(9)] + [("e", "n")], "doc_id string, number string")
    got = N.sampled_numbers(m, 4).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {"d": 4, "e": 1}
