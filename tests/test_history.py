"""Version histories, against brute force and in the odd cases."""

import datetime as dt
import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docuplane.operators.history import merge_runs, snapshot_history, versions_of

SCHEMA = "id long, k string, day string, rec timestamp, gone boolean, a string, valid_from string, _k string"


def history(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = snapshot_history(df, key=F.col("k"), day=F.col("day"), recorded=F.col("rec"), row_id=F.col("id"), removed=F.col("gone"), payload=[F.col("a")])
    return sorted((r["_k"], r["valid_from"], r["valid_to"], r["_id"]) for r in got.collect())


def row(i, k, day, rec, gone, a):
    return (i, k, day, rec, gone, a, "clash", "clash")


def test_versions_removal_return_and_corrections(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [
        row(1, "x", "2020-01-01", t, False, "p"),
        row(2, "x", "2020-02-01", t, False, "p"),
        row(3, "x", "2020-03-01", t, False, "q"),
        row(4, "x", "2020-03-01", t + dt.timedelta(days=1), False, "r"),
        row(5, "x", "2020-04-01", t, True, "r"),
        row(6, "x", "2020-05-01", t, None, "p"),
        row(6, "x", "2020-05-01", t, None, "p"),
        row(7, "y", "2020-01-01", None, False, None),
        row(8, "y", "2020-01-01", None, False, ""),
        row(9, None, "2020-01-01", t, False, "p"),
        row(10, "z", "no day", t, False, "p"),
        row(11, "w", "2020-01-01", t, True, "p"),
    ]
    assert history(spark, rows) == [("x", "2020-01-01", "2020-02-29", 1), ("x", "2020-03-01", "2020-03-31", 4), ("x", "2020-05-01", "9999-12-31", 6), ("y", "2020-01-01", "9999-12-31", 8)]


def test_empty(spark):
    assert history(spark, []) == []


def test_one_hot_entity_against_brute_force(spark):
    r = random.Random(2)
    t = dt.datetime(2020, 1, 1)
    rows = [row(i, r.choice("xxxxxy"), f"2020-{r.randrange(1, 13):02d}-{r.randrange(1, 28):02d}", t + dt.timedelta(hours=i % 50), r.random() < 0.1, r.choice("pq") * 2000) for i in range(400)]
    last = {}
    for i, k, day, rec, gone, a, *_ in rows:
        last[k, day] = max(last.get((k, day), (rec, i, gone, a)), (rec, i, gone, a))
    want = []
    for k in "xy":
        now = since = None
        for day in sorted(d for q, d in last if q == k):
            rec, i, gone, a = last[k, day]
            state = None if gone else a
            if state != now:
                if now is not None:
                    want.append((k, since[0], str(dt.date.fromisoformat(day) - dt.timedelta(days=1)), since[1]))
                now, since = state, (day, i)
        if now is not None:
            want.append((k, since[0], "9999-12-31", since[1]))
    assert history(spark, rows) == sorted(want)


@given(st.lists(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 9)), max_size=5), max_size=4))
def test_merge_is_sorted(runs):
    merged = list(merge_runs(*[sorted(x) for x in runs]))
    assert merged == sorted(y for x in runs for y in x)


def test_versions_hold_one_row():
    assert list(versions_of(iter([("a", "1", "p", 1), ("a", "2", None, 2), ("b", "1", "p", 3)]))) == [("a", "1", "2", 1), ("b", "1", None, 3)]
