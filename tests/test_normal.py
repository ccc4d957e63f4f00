import pytest
from pyspark.sql import functions as F

from docuplane.functions.normal import label_name, loose_text, month_key, number_key

DATES = {
    "2019-03": "2019-03", "2019-04 ": "2019-04", "2022-02-01": "2022-02", "OCT 2017": "2017-10", "October 2016": "2016-10", "Sep. 2017": "2017-09", "Sept 2017": "2017-09",
    "02/2016": "2016-02", "01/15/2020": "2020-01", "15 March 2020": "2020-03", "March 15, 2020": "2020-03", "201903": "2019-03", "(JUN 2020)": "2020-06",
    "DATE": None, "": None, "XXX 2020": None, "2019-13": None, "13/2019": None, "00/2019": None, "2019": None, None: None,
}


def test_month_key(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "s string").select("s", month_key(F.col("s")).alias("m"))
    assert {r["s"]: r["m"] for r in df.collect()} == DATES


@pytest.mark.parametrize("f,given,want", [(number_key, " 252.​645 ‑7028", "252.645-7028"), (loose_text, "Ready–Made  Thing..", "ready-madething"), (loose_text, None, ""), (label_name, " Old Index ", "old_index"), (label_name, "MAIL-intake", "mail_intake"), (label_name, "  ", None)])
def test_normal_forms(spark, f, given, want):
    assert spark.createDataFrame([(given,)], "s string").select(f(F.col("s"))).first()[0] == want
