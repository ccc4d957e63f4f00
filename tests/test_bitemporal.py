"""Attributes as known at event time, against brute force and in the odd cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from docuplane.operators.bitemporal import DAY_US, as_known_at, current_rectangles

EVENTS = "ev int, k string, day date, at timestamp, version_id string, extra string"
VERSIONS = "id long, k string, day date, at timestamp, extra string"


def known(spark, events, versions, cell_days=30):
    e, v = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
    got = as_known_at(e, v, key=F.col("k"), valid_day=F.col("day"), moment=F.col("at"), version_key=F.col("k"), version_day=F.col("day"), version_moment=F.col("at"), version_id=F.col("id"), cell_days=cell_days)
    return got


def brute(events, versions):
    out = {}
    for ev, k, day, at, *_ in events:
        ok = [(d, a, i) for i, vk, d, a, _ in versions if None not in (i, vk, d, a, k, day, at) and vk == k and d <= day and a <= at]
        out[ev] = max(ok)[2] if ok else None
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    start = dt.datetime(2020, 1, 1)

    def moment():
        return start + dt.timedelta(days=r.randrange(400), hours=r.randrange(24))

    def day():
        return (start + dt.timedelta(days=r.randrange(400))).date()

    # one key holds most rows; days and moments tie often
    versions = [(i, r.choice("aaaaab"), day(), moment().replace(hour=0), None) for i in range(300)]
    versions += versions[:40]
    events = [(i, r.choice("aaaab") if i % 9 else "nobody", day(), moment(), "x", "y") for i in range(300)]
    for cell in (7, 100, 5000):
        got = {row["ev"]: row["version_id"] for row in known(spark, events, versions, cell).collect()}
        assert got == brute(events, versions)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    d, t = dt.date(2020, 5, 1), dt.datetime(2020, 5, 2)
    versions = [(1, "a", d, t, "p"), (2, "a", d, t, "q"), (2, "a", d, t, "q"), (3, "a", None, t, ""), (4, "a", d, None, ""), (5, None, d, t, ""), (None, "a", d, t, "")]
    events = [(1, "a", d, t, "mine", "e"), (1, "a", d, t, "mine", "e"), (2, None, d, t, None, None), (3, "a", None, t, None, None), (4, "a", d, None, None, None), (5, "a", d, dt.datetime(2020, 5, 1), None, "")]
    got = known(spark, events, versions)
    assert got.columns.count("version_id") == 1 and "extra" in got.columns
    assert sorted(((r["ev"], r["version_id"]) for r in got.collect()), key=str) == sorted([(1, 2), (1, 2), (2, None), (3, None), (4, None), (5, None)], key=str)


def test_empty_tables(spark):
    d, t = dt.date(2020, 5, 1), dt.datetime(2020, 5, 2)
    assert known(spark, [], [(1, "a", d, t, "")]).count() == 0
    assert [r["version_id"] for r in known(spark, [(1, "a", d, t, "", "")], []).collect()] == [None]


def test_rectangles_are_disjoint(spark):
    r = random.Random(8)
    rows = [("a", r.randrange(60), r.randrange(60) * DAY_US, i) for i in range(80)]
    v = spark.createDataFrame(rows, "_k string, _v long, _r long, _id long")
    cells = spark.createDataFrame([("a", i, j) for i in range(3) for j in range(3)], "_k string, _vc long, _rc long")
    got = current_rectangles(v, cells, 20).collect()
    assert got
    for i, x in enumerate(got):
        for y in got[:i]:
            assert x.valid_hi <= y.valid_lo or y.valid_hi <= x.valid_lo or x.recorded_hi <= y.recorded_lo or y.recorded_hi <= x.recorded_lo
