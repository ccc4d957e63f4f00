"""Leaked passages, mixtures and truncated texts on small collections."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from docuplane.llm.leakage import leaked_passages
from docuplane.llm.mixture import mixed_copies, mixing_rates, systematic_copies
from docuplane.llm.truncation import structure_state, truncated_texts

WORDS = [f"word{i}" for i in range(300)]
TOKENIZER = os.environ.get("DOCUPLANE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"


def test_leaks_against_brute_force(spark):
    r = random.Random(6)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(5, 60)))) for i in range(25)]
    docs = []
    for k in range(120):
        w = [r.choice(WORDS) for _ in range(80)]
        if k % 2:
            source = r.choice(items)[1].split()
            n = r.randrange(8, 20)
            at = r.randrange(max(1, len(source) - n))
            w[40:40] = [x.upper() + r.choice(["", ",", "\n", "”"]) for x in source[at : at + n]]
        docs.append((k, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "one two"), (0, docs[0][1])]
    items += [(900, None), (901, ""), (902, "short one")]
    got = leaked_passages(spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string"))
    phrases = {(x["doc_id"], x["item_id"]) for x in got.where("kind = 'phrase'").collect()}

    def tokens(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    windows = {}
    for i, t in items:
        w = tokens(t)
        for k in range(len(w) - 11):
            windows.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for w in [tokens(t)] for k in range(len(w) - 11) for i in windows.get(tuple(w[k : k + 12]), ())}
    assert phrases == want and want


def test_proximity(spark):
    item = " ".join(f"a{i}" for i in range(30))
    doc = " ".join(f"a{i}" for i in range(8)) + " x y " + " ".join(f"a{i}" for i in range(12, 20))
    got = leaked_passages(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [x["kind"] for x in got] in ([], ["proximity"])


def test_proximity_of_edited_items(spark):
    long, exact = [f"a{i}" for i in range(48)], [f"b{i}" for i in range(12)]
    edited = ["edit" if i % 10 == 5 else w for i, w in enumerate(long)]
    # b0..b2, twice, and only then b9..b11, within 40 words of the second b0
    short = exact[:3] + ["x"] * 30 + exact[:3] + ["y"] * 30 + exact[9:]
    lone = exact[:3] + ["z"] * 60 + exact[9:]
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(exact)), (3, "c0 c1 c2 c3 c4 c5")], "item_id long, text string")

    def leaks(*docs):
        rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
        return {(x["doc_id"], x["item_id"], x["kind"]) for x in leaked_passages(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}

    want = {(0, 1, "proximity"), (1, 2, "proximity")}
    assert leaks(edited, short, lone, ["c0", "c1", "c2", "c3", "c4"]) == want
    # an unrelated document that holds the whole item changes nothing for the others
    assert leaks(edited, short, lone, [], long) == want | {(4, 1, "phrase")}


def test_no_documents_or_items(spark):
    d, i = "doc_id long, text string", "item_id long, text string"
    some = " ".join(WORDS[:20])
    assert leaked_passages(spark.createDataFrame([], d), spark.createDataFrame([(1, some)], i)).count() == 0
    assert leaked_passages(spark.createDataFrame([(1, some)], d), spark.createDataFrame([], i)).count() == 0


def counts_of(spark, n=3000):
    r = random.Random(2)
    return spark.createDataFrame([(i, "big" if i % 3 else "small" if i % 20 else "tiny", r.randrange(1, 900)) for i in range(n)], "id long, source string, n_tokens long")


def test_shares_and_caps(spark):
    counts = counts_of(spark)
    targets = spark.createDataFrame([("big", 0.2, 1), ("small", 0.5, 2), ("tiny", 0.2, 5), ("absent", 0.1, 9)], "source string, target_share double, max_repeats int")
    sizes = counts.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    rates = mixing_rates(sizes, targets)
    copies = systematic_copies(counts, rates)
    got = {x["source"]: x for x in copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.max("copies").alias("m"), F.min("copies").alias("least"), F.count(F.lit(1)).alias("n")).collect()}
    total = sum(x["t"] for x in got.values())
    for s, share, cap in (("big", 0.2, 1), ("small", 0.5, 2), ("tiny", 0.2, 5)):
        assert abs(got[s]["t"] / total - share / 0.9) < 0.01 and got[s]["m"] <= cap and got[s]["m"] - got[s]["least"] <= 1
    assert copies.count() == counts.count()
    again = systematic_copies(counts.repartition(7), rates)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, copies.collect()))
    fixed = {x["source"]: x["rate"] for x in mixing_rates(sizes, targets, 10**9).collect()}
    assert fixed["big"] == 1.0 and fixed["tiny"] == 5.0 and fixed["absent"] == 0.0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files here")
def test_mix_of_texts(spark):
    docs = spark.createDataFrame([(1, "one two three", "A"), (2, None, "a"), (3, "", "a "), (4, "x", None), (5, "four <|endoftext|>", "other")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    args = dict(doc_id="doc_id", text="text", source=F.lower(F.trim("source")), target_source=F.col("source"), tokenizer=TOKENIZER)
    mix, report = mixed_copies(docs, targets, **args)
    assert sorted((x["id"], x["copies"]) for x in mix.collect()) == [(1, 3), (2, 3), (3, 3)]
    assert report.first()["actual_share"] == 1.0
    mix, report = mixed_copies(docs.limit(0), targets, **args)
    assert mix.count() == 0 and report.first()["tokens"] == 0


STATES = {
    "A whole sentence.": "complete", "": "complete", "He said “done.”": "complete", "Cut in mid": "no terminator", "Cut in mid wor...": "ellipsis", "broken ch�": "broken",
    "All done.\n(b) usable liner": "item", "All done.\n| 1 | desk | 4 EA |": "closing", "All done.\n| 1 | de": "open row", "Done.\n12 May 2020": "closing", "Done.\nContracting Officer, Harbor Works Bureau": "heading",
    "Done.\nEND OF SECTION": "heading", "Done.\nN/A": "heading", "Done.\nTotal lines: 8": "heading", "Done.\n\nThe vendor": "no terminator", "Done.\n\nThe": "no terminator", "see (the last part.": "unclosed",
    "A “quote that never": "unclosed", "<p>text.</p>": "complete", "<p>text": "no terminator", "<div><p>text.": "unclosed", "R&D and so on.": "complete", "fish &am": "broken", "then \\u00": "broken", "(a) opens\n\nnew. Done.": "complete",
    'He said "the contract is done.': "unclosed", 'He said "the contract" is done.': "complete", 'A 5" pipe and a 6" pipe.': "complete", 'He said "(see "here") now".': "complete", "x. " * 400 + "<a href='" + "y" * 600: "broken", "if a <b then " + "c " * 300 + "end.": "complete",
    "Done.\nTwo central bearing options exist: relocate the du": "no terminator", "Done.\n" + "Harbor Works Bureau and " * 6 + "Office": "heading",
}


def test_states():
    assert {t: structure_state(t) for t in STATES} == STATES


def test_limits_of_a_source(spark):
    r = random.Random(3)

    def text(n):
        return (" ".join(r.choice(WORDS) for _ in range(n)))[:n]

    rows = [(i, text(300), "cut") for i in range(30)] + [(100 + i, text(r.randrange(50, 290)) + ".", "cut") for i in range(60)]
    body = text(283) + ".\n(a) "
    rows += [(300, body + "x" * (300 - len(body)), "cut"), (301, body + "x" * (250 - 0), "other"), (302, text(299) + ".", "cut"), (303, None, "cut"), (304, "", None), (305, "é" * 100_000 + ".", "cut"), (306, "whole.", "cut"), (306, "whole.", "cut")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("state", F.lit("clash"))
    got = {x["id"]: x for x in truncated_texts(df, source=F.col("source")).collect()}
    assert all(got[i]["truncated"] for i in range(30)) and not any(got[100 + i]["truncated"] for i in range(60))
    assert got[300]["truncated"] and got[300]["at_limit"] and not got[301]["truncated"] and not got[302]["truncated"]
    assert not got[303]["truncated"] and got[303]["state"] is None and got[304]["state"] == "complete" and got[304]["source"] is None and not got[305]["truncated"]
    assert truncated_texts(df, source=F.col("source")).count() == len(rows)


def test_habit_of_a_source(spark):
    r = random.Random(4)

    def text(n):
        return " ".join(r.choice(WORDS) for _ in range(n))

    # one source never sets a full stop, one of few texts has one cut, one cuts many of its texts
    rows = [(i, text(r.randrange(10, 90)), "bare") for i in range(300)] + [(300 + i, text(r.randrange(10, 90)) + "." * (i > 0), "few") for i in range(3)] + [(400 + i, text(r.randrange(10, 90)) + "." * (i % 2), "half") for i in range(100)]
    rows += [(600 + i, text(40) + ".", "rest") for i in range(600)]
    got = {x["id"] for x in truncated_texts(spark.createDataFrame(rows, "doc_id long, text string, source string"), source=F.col("source")).where("truncated").collect()}
    assert got == {300} | {400 + i for i in range(0, 100, 2)}


def test_no_texts(spark):
    assert truncated_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
