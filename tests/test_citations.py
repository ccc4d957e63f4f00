"""Mentions in lines written for the purpose, and the plain number search."""

import pytest
from pyspark.sql import functions as F

from docuplane.operators.citations import line_offsets, mentions, plain_numbers


def run(spark, *lines, registry=None):
    text = "\n".join(lines)
    pages = spark.createDataFrame([(1, "d", 1, text)], "page_id long, doc_id string, page int, text_layout string")
    reg = spark.createDataFrame(registry, "number string, status string") if registry else None
    return [r.asDict() for r in mentions(pages, reg).orderBy("line_no", "char_start", F.length("cand_id"), "cand_id").collect()], text


def test_checked_item_with_date_and_offsets(spark):
    (m,), text = run(spark, "first", "⟦X⟧ (4) 52.203-6, Restrictions Made Here (JUN 2020)")
    assert (m["number"], m["regulation"], m["box_marker"], m["cited_date"], m["line_no"]) == ("52.203-6", "FAR", "⟦X⟧", "2020-06", 1)
    assert text[m["char_start"] : m["char_end"]] == m["raw"] == "52.203-6"
    assert m["cand_id"] == "d-p1-0" and m["in_registry"] is None


def test_alternates_before_and_after(spark):
    got, _ = run(spark, "Alternate II (MAR 2019) of 52.203-6", "52.204-8 (OCT 2018) Alternate i", "DFARS 252.204-7012(b)(2) Things")
    assert [(m["number"], m["alternate"], m["cited_date"]) for m in got[:2]] == [("52.203-6", "Alternate II", "2019-03"), ("52.204-8", "Alternate I", "2018-10")]
    assert (got[2]["prefix"], got[2]["subpara"], got[2]["raw"]) == ("DFARS", "(b)(2)", "252.204-7012(b)(2)")


@pytest.mark.parametrize("line,numbers", [("52.219‑1 and 52 . 219 – 9", ["52.219-1", "52.219-9"]), ("52.219-1 through 52.219-4", ["52.219-1", "52.219-2", "52.219-3", "52.219-4"]), ("52.219-1 thru -4", ["52.219-1", "52.219-2", "52.219-3", "52.219-4"]), ("52.219-1 through 52.219-99", ["52.219-1", "52.219-99"]), ("nothing here", [])])
def test_forms_and_ranges(spark, line, numbers):
    got, _ = run(spark, line)
    assert sorted(m["number"] for m in got) == sorted(numbers)


def test_wrapped_date_hints_and_deviation(spark):
    got, _ = run(spark, "52.212-4 Terms of this (DEVIATION)", "(NOV 2021)", "$52.100 and 1,252.200 and 52.300%", registry=[("52.212-4", "active")])
    assert (got[0]["cited_date"], got[0]["deviation_marker"], got[0]["in_registry"], got[0]["registry_status"]) == ("2021-11", "(DEVIATION)", True, "active")
    assert [m["nonclause_hints"] for m in got[1:]] == [["money"], ["longer_number"], ["percent"]]
    assert got[1]["in_registry"] is False


def test_null_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, "d", 1, None), (2, "d", 2, ""), (3, None, None, "52.203-6")], "page_id long, doc_id string, page int, text_layout string")
    assert [r["number"] for r in mentions(pages).collect()] == ["52.203-6"]


def test_line_offsets(spark):
    pages = spark.createDataFrame([(1, "d", 1, "ab\n\ncd")], "page_id long, doc_id string, page int, text_layout string")
    assert [(r["line_no"], r["line_start"]) for r in line_offsets(pages).orderBy("line_no").collect()] == [(0, 0), (1, 3), (2, 4)]


def test_plain_numbers(spark):
    s = "FAR 52.203-6 DFARS 252.204-7012 1252.200-1 $52.100 52.219‑1 152.333"
    assert spark.createDataFrame([(s,)], "s string").select(plain_numbers(F.col("s"))).first()[0] == ["252.204-7012", "52.100", "52.203-6", "52.219"]
