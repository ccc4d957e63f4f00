"""Near-duplicates, cross-split overlap and page repair on small collections."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from docuplane.llm import overlap
from docuplane.llm.neardup import Signature, all_pairs, group_ids, near_duplicates
from docuplane.llm.overlap import chunk_record, cross_split_overlap, member_pairs
from docuplane.llm.page_queries import p5_found
from docuplane.llm.pagenoise import Lexicon, confusions, header_key, line_defects, page_defects, paragraph_breaks, repaired_page, repaired_pages
from docuplane.llm.shingles import WordHashes, jaccard, run_hashes, word_hashes
from docuplane.session import shuffles_dropped, stage_table

PAGE = "page_id long, doc_id string, page int, text_plain string, text_layout string, id string, sig string"


def collection(r, n=60):
    words = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(n):
        if k % 3 and texts:
            t = r.choice(texts).split()
            for _ in range(r.randrange(0, 12)):
                i = r.randrange(len(t))
                t[i : i + 1] = r.choice([[], [r.choice(words)], [t[i], r.choice(words)]])
            texts.append(" ".join(t))
        else:
            texts.append(" ".join(r.choice(words) for _ in range(r.randrange(60, 200))))
    return texts


def brute(texts, width, threshold):
    known = WordHashes()
    sets = [run_hashes(word_hashes(t, known), width) for t in texts]
    return {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i]) and jaccard(sets[i], sets[j]) >= threshold}


def test_near_duplicates_against_all_pairs(spark):
    texts = collection(random.Random(4)) + ["", None, "too short"] + ["the same page of text " * 12] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("rep", F.lit("clash"))
    for width, threshold in ((3, 0.6), (5, 0.8)):
        found = near_duplicates(df, threshold=threshold, shape=Signature(width=width, min_words=10))
        want = {(i, j) for i, j in brute(texts, width, threshold) if min(len((texts[i] or "").split()), len((texts[j] or "").split())) >= 10}
        assert {tuple(x) for x in all_pairs(found).collect()} == want
    reps = {x["id"]: x["rep"] for x in found.members.collect()}
    assert reps[63] == reps[64] == reps[65] == 63 and 60 not in reps and 61 not in reps


def test_short_and_very_long_texts(spark):
    long = " ".join(f"x{i % 5003}" for i in range(120_000))
    df = spark.createDataFrame([(1, "One two"), (2, "one, TWO"), (3, long), (4, long + " tail"), (None, "one two")], "id long, text string")
    assert {tuple(x) for x in all_pairs(near_duplicates(df)).collect()} == {(1, 2), (3, 4)}


def test_no_texts(spark):
    found = near_duplicates(spark.createDataFrame([], "id long, text string"))
    assert found.members.count() == 0 and found.links.count() == 0


def test_groups_reach_over_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 50)], "id_a long, id_b long")
    assert {x["rep"]: x["grp"] for x in group_ids(links).collect()} == {**dict.fromkeys(range(1, 21), 1), 40: 40, 50: 40}


def test_groups_of_a_long_chain_are_whole(spark):
    path = [0, *range(99, 0, -1)]
    links = spark.createDataFrame([(min(x), max(x)) for x in zip(path, path[1:])], "id_a long, id_b long")
    assert {x["rep"]: x["grp"] for x in group_ids(links).collect()} == dict.fromkeys(range(100), 0)
    assert group_ids(links.limit(0)).count() == 0


def test_chunks_cover_and_resume_after_an_edit():
    known = WordHashes()
    r = random.Random(1)
    words = [f"w{r.randrange(300)}" for _ in range(500)]
    a, b = (chunk_record(word_hashes(" ".join(w), known)) for w in (words, words[:250] + ["new"] + words[250:]))
    assert a[1].sum() == 500 and b[1].sum() == 501
    assert np.isin(a[0], b[0]).mean() > 0.9
    assert len(chunk_record(np.empty(0, np.uint64))[0]) == 0


def test_overlap_between_splits(spark):
    r = random.Random(9)
    texts = collection(r)
    texts += [texts[3].upper()] * 4
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(98, None, ""), (99, "", "")]
    sides = [(i, "ab"[i % 2]) for i in range(len(texts))] + [(0, "b"), (0, "a"), (98, "a"), (99, "b"), (99, "b"), (5, None), (7, "other")]
    got = cross_split_overlap(spark.createDataFrame(rows, "id long, text string, digest string"), spark.createDataFrame(sides, "id long, side string"), min_overlap=0.2)
    pairs = {(x["id_a"], x["id_b"]) for x in member_pairs(got, got.pairs).collect()}
    side = {"a": {i for i, s in sides if s == "a"}, "b": {i for i, s in sides if s == "b"}}
    known = WordHashes()
    chunks = [dict(zip(*(x.tolist() for x in chunk_record(word_hashes(t, known))))) for t in texts]
    size = [len(t.split()) for t in texts]
    want = set()
    for a in side["a"] & set(range(len(texts))):
        for b in side["b"] & set(range(len(texts))):
            both = sum(chunks[a][c] for c in chunks[a].keys() & chunks[b].keys())
            if a != b and both >= 0.2 * size[a] and both >= 0.2 * size[b]:
                want.add((a, b))
    assert pairs == want and want


def test_scattered_edits_across_splits(spark, tmp_path):
    r = random.Random(12)
    texts = []
    for k in range(150):
        words = [f"v{r.randrange(3000)}" for _ in range(r.randrange(30, 70))]
        # every edit breaks three runs; spread evenly, it breaks the most chunks
        gap = 12 + k % 3
        texts += [" ".join(words), " ".join("edit" + str(k) if i % gap == gap // 2 else w for i, w in enumerate(words))]
    pages = spark.createDataFrame([(i, f"d{i % 2}", t) for i, t in enumerate(texts)], "page_id long, doc_id string, text_plain string")
    pages.write.parquet(f"{tmp_path}/page_texts.parquet")
    spark.createDataFrame([("d0", "Train "), ("d1", "dev")], "doc_id string, split string").write.parquet(f"{tmp_path}/doc_splits.parquet")
    want = {(j, i) for i, j in brute(texts, 3, 0.6) if i % 2 != j % 2}
    want = {(min(x), max(x)) for x in want}
    sides = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(len(texts))], "id long, side string")
    met = cross_split_overlap(pages, sides, id_col="page_id", text_col="text_plain", signature=Signature(width=3), threshold=0.6).pairs
    assert want <= {(min(x["rep_a"], x["rep_b"]), max(x["rep_a"], x["rep_b"])) for x in met.collect()}
    assert {tuple(x) for x in p5_found(spark, str(tmp_path)).collect()} == want and len(want) > 50
    gate = cross_split_overlap(pages, sides, id_col="page_id", text_col="text_plain", min_overlap=0.2, min_words=30)
    assert want - {(min(x), max(x)) for x in gate.pairs.select("rep_a", "rep_b").collect()}


def test_chance_meetings_are_not_measured(spark, monkeypatch):
    r = random.Random(21)
    known = WordHashes()
    pool = [[f"s{k}w{r.randrange(60)}" for _ in range(9)] for k in range(700)]
    # a fifth of a text is boilerplate, of the rest each sentence is in a few texts
    texts = [" ".join(w for k in r.sample(range(12), 1 + n // 6) + r.sample(range(12, 700), n) for w in pool[k]) for n in r.choices((5, 22, 26), k=121)]
    texts += [" ".join(t.split()[:120] + [f"own{i}x{j}" for j in range(r.choice((60, 200, 470)))]) for i, t in enumerate(texts[:30])]
    chunks = [dict(zip(*(x.tolist() for x in chunk_record(word_hashes(t, known))))) for t in texts]
    size = [len(t.split()) for t in texts]
    sides = [(i, "ab"[i % 2]) for i in range(len(texts))] + [(i, "ab"[(i + 1) % 2]) for i in range(0, len(texts), 5)]
    records, placed = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(sides, "id long, side string")
    staged = {}
    monkeypatch.setattr(overlap, "stage_table", lambda df, name: staged.setdefault(name, stage_table(df, name)))
    across = [(a, b, chunks[a].keys() & chunks[b].keys()) for a, x in sides if x == "a" for b, y in sides if y == "b" and a != b]
    for mutual in (True, False):
        staged.clear()
        got = cross_split_overlap(records, placed, min_overlap=0.2, mutual=mutual)
        want = {(a, b) for a, b, c in across if sum(chunks[b][x] for x in c) >= 0.2 * size[b] and (not mutual or sum(chunks[a][x] for x in c) >= 0.2 * size[a])}
        assert {(x["id_a"], x["id_b"]) for x in member_pairs(got, got.pairs).collect()} == want and len(want) > 20
        assert staged["met"].count() < 3 * len(want)


def test_shuffles_of_a_stage_are_dropped(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(setting, None)
    with shuffles_dropped(spark):
        kept = stage_table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "kept")
    until = time.monotonic() + 20
    while files() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(setting, None) == was
    assert kept.count() == 7


def test_no_records(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert cross_split_overlap(empty, spark.createDataFrame([], "id long, side string")).pairs.count() == 0


WORDS = "the contractor shall inspect every schedule include manual before during number modern until terms order".split()


def lexicon():
    return Lexicon(dict.fromkeys(WORDS, 500) | {"sball": 3})


def test_confusions_and_words():
    lex = lexicon()
    assert "sball" not in lex.pages
    for read, meant in (("scbedule", "schedule"), ("iriclude", "include"), ("rnanual", "manual"), ("1nspect", "inspect"), ("nurnber", "number"), ("tbe", "the"), ("c0ntractor", "contractor")):
        assert confusions(read, meant) and lex.corrected(read) == meant, read
    for word in ("untli", "duirng", "schedules", "the", "Korralton".lower(), "2024"):
        assert lex.corrected(word) is None, word
    assert lex.decode("thecontractor") == ["the", "contractor"]
    assert lex.decode("sched-\nule inc lude") == ["schedule", "include"]
    assert lex.decode("xyzzy") is None


def test_line_defects():
    lines = ["The contractor shall inspect every sched-", "ule before the terms until every long-", "term order during tbe modern number", "52.203-6 tbe schedule", "untli the order"]
    assert sorted(line_defects(lexicon(), lines)) == [(0, "hyphen"), (2, "misread")]
    assert [*line_defects(lexicon(), ["no hyphen", "here end-", ""])] == []


def test_words_in_pieces_and_in_one():
    lex = lexicon()
    lines = ["The contractor shall inspect every sched", "ule before the terms until order", "during the nu rnber modern", "and so inc lude Korralton", "Base before"]
    assert sorted(line_defects(lex, lines)) == [(0, "hyphen"), (2, "misread")]
    text = "The contractor shall inspect every sched\nule before the terms inc lude (man ual), Thecontractor Korralton shall.\nTHE NU RNBER."
    assert repaired_page(lex, text, set()) == "The contractor shall inspect every schedule before the terms include (manual), The contractor Korralton shall. THE NUMBER."


def test_joint_decoding():
    lex = Lexicon(dict.fromkeys([*WORDS, "deliver", "be", "con", "for"], 500))
    assert repaired_page(lex, "the con tractor shall de liver", set()) == "the contractor shall deliver"
    assert repaired_page(lex, "every schedule be\nf0re the order", set()) == "every schedule before the order"
    assert repaired_page(lex, "Thecontractor shall inspect", set()) == "The contractor shall inspect"
    # blanks on the wrong side of a letter, and a name beside them
    assert repaired_page(lex, "th econtractor Korralton shall", set()) == "the contractor Korralton shall"
    # pieces that are all words stay, unless a hyphen says that they are pieces
    words = Lexicon(dict.fromkeys([*WORDS, "be", "fore"], 500))
    assert repaired_page(words, "the order be fore the", set()) == "the order be fore the"
    assert repaired_page(words, "the order be-\nfore the", set()) == "the order before the"
    assert sorted(line_defects(lex, ["it shall be-", "fore the", "52.203-6 tbe order", "as 52.203-6 says tbe order"])) == [(0, "hyphen"), (3, "misread")]
    assert repaired_page(lex, "(sched-\nule), tbe.", set()) == "(schedule), the."


def test_words_of_few_pages(spark):
    plain = "the contractor shall inspect every order"
    texts = ["we saw the gazebo here", "near the gaz-\nebo there", "by the g@zebo there", "the tone-\nless end", "by the gazeho there"] + [plain] * 45
    rows = [(i, None, 1, t, None, None, None) for i, t in enumerate(texts)]
    got = {(x["page_id"], x["line_no"], x["defect"]) for x in page_defects(spark.createDataFrame(rows, PAGE), min_share=0.2).collect()}
    # one page against one: either spelling of the last may be meant
    assert got == {(1, 0, "hyphen"), (2, 0, "misread")}


def test_headers_and_page_numbers(spark):
    body = ["the contractor shall inspect every schedule", "before the order until terms during number", "modern manual include every terms until"]
    rows = []
    for p in range(1, 5):
        lines = ["SOLICITATION Q12-2020-R-0001   Page %d of 4" % p, *body[p % 3 :], *body[: p % 3], "0017", body[p % 3], "- %d -" % p]
        rows.append((p, "d", p, "\n".join(lines), None, "x", "y"))
    rows += [(10, "e", 1, "\n".join(["Draft Form Alpha", *body]), "", None, None), (11, "e", 2, "\n".join(["Draft Form Alpha", *body]), "", None, None), (12, "f", 1, None, None, None, None), (13, "f", 2, "", "", None, None), (14, None, None, "7", None, None, None)]
    got = page_defects(spark.createDataFrame(rows, PAGE), min_share=0.3).collect()
    marks = {(x["page_id"], x["line_no"], x["defect"]) for x in got if x["defect"] in ("header", "page_number")}
    assert marks == {(p, 0, "header") for p in range(1, 5)} | {(p, 6, "page_number") for p in range(1, 5)}
    assert header_key("and so it ends.") is None and header_key("52.203-6 Title") is None


def test_repair(spark):
    text = "HEAD\nThe contractor shall inspect every sched-\nule before tbe terms until the order\nincludes.\n\nThe terms."
    assert repaired_page(lexicon(), text, {0}) == "The contractor shall inspect every schedule before the terms until the order includes.\n\nThe terms."
    assert paragraph_breaks([]) == [] and repaired_page(lexicon(), "", set()) == ""
    rows = [(1, "d", 1, None, None, "", ""), (2, "d", 2, "", "x" * 200_000, "", "")]
    got = {x["page_id"]: x for x in repaired_pages(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[1]["text_plain"] is None and got[2]["text_plain"] == "" and len(got[2]["text_layout"]) == 200_000


def test_no_pages(spark):
    empty = spark.createDataFrame([], PAGE)
    assert page_defects(empty).count() == 0 and repaired_pages(empty).count() == 0
