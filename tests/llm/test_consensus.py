import datetime as dt
import random

from pyspark.sql import functions as F

from docuplane.llm.consensus import latest_votes, weighted_consensus

L = ("B", "N", "R")


def consensus(spark, votes):
    return weighted_consensus(spark.createDataFrame(votes, "item string, annotator string, label string"), L)


def test_reliable_annotators_outvote_others(spark):
    r = random.Random(3)
    skill = {"a": 0.95, "b": 0.9, "c": 0.4, "d": 0.35, "e": 0.3}
    truth = {f"i{k}": r.choice(L) for k in range(400)}
    votes = [(i, a, t if r.random() < p else r.choice([x for x in L if x != t])) for i, t in truth.items() for a, p in skill.items() if r.random() < 0.8]
    got = consensus(spark, votes)
    items = {x["item"]: x for x in got.items.collect()}
    weighted = sum(items[i]["label"] == t for i, t in truth.items() if i in items) / len(items)
    by = {}
    for i, a, x in votes:
        by.setdefault(i, []).append(x)
    plain = sum(max(sorted(set(v)), key=v.count) == truth[i] for i, v in by.items()) / len(by)
    assert weighted > max(plain, 0.88)
    people = {x["annotator"]: x["reliability"] for x in got.annotators.collect()}
    assert all(abs(people[a] - p) < 0.1 for a, p in skill.items())


def test_agreement_single_votes_and_ties(spark):
    got = {x["item"]: x for x in consensus(spark, [("one", "a", "N"), ("tie", "a", "B"), ("tie", "b", "N"), ("tie", "b", "N"), ("same", "a", "R"), ("same", "b", "R"), ("bad", "a", "?")]).items.collect()}
    assert set(got) == {"one", "tie", "same"}
    assert got["one"]["agreement"] is None and got["one"]["label"] == "N" and got["one"]["chance_corrected"] is None
    assert got["same"]["agreement"] == 1.0 and got["tie"]["agreement"] == 0.0 and got["tie"]["n_labels"] == 2


def test_no_votes(spark):
    got = consensus(spark, [])
    assert got.items.count() == 0 and got.annotators.count() == 0


def test_latest_votes(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [("i", "a", "B", t), ("i", "a", "N", t + dt.timedelta(1)), ("i", "a", "N", t + dt.timedelta(1)), ("i", "b", "B", None), ("i", "b", None, t), ("i", None, "B", t), (None, "a", "B", t), ("j", "a", "B", t), ("j", "a", "N", t)]
    df = spark.createDataFrame(rows, "item string, who string, lab string, at timestamp")
    got = latest_votes(df, item=F.col("item"), annotator=F.col("who"), label=F.col("lab"), at=F.col("at")).collect()
    assert sorted(tuple(x) for x in got) == [("i", "a", "N"), ("j", "a", "N")]
