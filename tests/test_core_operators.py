"""Cleaning, registry, acquisition, features, sources and streams on small inputs."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docuplane.functions import cleaning as C
from docuplane.operators import acquisition as A
from docuplane.operators import features as X
from docuplane.operators import registry as R
from docuplane.sources import config, journals
from docuplane.sources.files import docx_texts, read_documents
from docuplane.sources.registry_xml import parse_section, parts_in_tree, read_sections
from docuplane.streaming.ingest import arriving_files, run_batches


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s"))).first()[0]


@pytest.mark.parametrize("text,want", [("mail a.b@x.gov now", "mail [EMAIL] now"), ("5000Some.One@va.gov", "[EMAIL]"), ("call (202) 555-0100 ext. 12.", "call [PHONE]."), ("202-555-0100", "[PHONE]"), ("252.204-7012", "252.204-7012"), ("52.212-4", "52.212-4"), ("$202-555-0100", "$202-555-0100"), ("252.204-7012 x12", "[PHONE]")])
def test_redaction(spark, text, want):
    assert one(spark, C.redacted, text) == want


def test_markings_html_and_boxes(spark):
    assert one(spark, C.markings, "This is CUI, and ITAR applies") == ["CUI", "export_control"]
    assert one(spark, C.banner_markings, "SOURCE SELECTION INFORMATION - SEE FAR") == ["source_selection"]
    assert one(spark, C.banner_markings, "a sentence about proprietary data") == [] and one(spark, C.banner_markings, "Distribution statement C") == ["distribution_statement"]
    assert one(spark, C.plain_html, "<p>A&nbsp;&lt;b&gt;\n <b>c</b>&amp;d</p>") == "A <b> c &d"
    for line, want in (("☒ yes ☐ no", "⟦X⟧ yes ⟦ ⟧ no"), (" ✓ done ✓", " ⟦X⟧ done ✓"), ("[X] item", "⟦X⟧ item"), ("[ ] item", "⟦ ⟧ item"), ("■ 52.203-6", "⟦X⟧ 52.203-6"), ("■ bullet", "■ bullet"), (" form", "⟦ ⟧ form"), (" q", "⟦?⟧ q")):
        assert one(spark, C.marked_line, line) == want
    assert one(spark, C.text_layout, "a\n\n \r\nb") == "a\nb"
    page = spark.createDataFrame([("see 52.212-5", "(4) 52.203-6 x\n⟦X⟧ (5) 52.204-8")], "p string, l string")
    assert page.select(C.lost_boxes(F.col("p"), F.col("l"))).first()[0] == "⟦?⟧ (4) 52.203-6 x\n⟦X⟧ (5) 52.204-8"


def test_registry(spark):
    rows = [("52.208-1 - 52.208-3", "a"), ("52.208-1 - 52.209-3", "b"), ("52.208-9", "c")]
    got = {(x["number"], x["source_range"]) for x in R.expand_ranges(spark.createDataFrame(rows, "number string, title string")).collect()}
    assert got == {(f"52.208-{k}", rows[0][0]) for k in (1, 2, 3)} | {(rows[1][0], None), ("52.208-9", None)}
    d = spark.createDataFrame([("52.1-1", "reserved", 1, [("2020", "x")]), ("52.1-1", "active", 2, [("2019", "y"), ("2020", "z")]), ("52.1-2", "removed", 3, [])], "number string, status string, seq int, versions array<struct<effective_from:string,v:string>>")
    got = {x["number"]: x for x in R.dedupe_numbers(d).collect()}
    assert got["52.1-1"]["status"] == "active" and [(v["effective_from"], v["v"]) for v in got["52.1-1"]["versions"]] == [("2019", "y"), ("2020", "x")]
    assert got["52.1-2"]["versions"] is None
    order = spark.createDataFrame([(x,) for x in ("52.219-14", "52.219-9", "52.219-a", "252.2-1")], "n string").orderBy(R.natural_key(F.col("n")))
    assert [x["n"] for x in order.collect()] == ["52.219-9", "52.219-14", "52.219-a", "252.2-1"]
    e = spark.createDataFrame([("a", "2020-05-01"), ("a", "2019-01-01"), ("b", None)], "number string, day string")
    v = spark.createDataFrame([("a", "2020-01-01", "2020-12-31", "2019-10"), ("a", "2021-01-01", None, "2021-01")], "number string, valid_from string, valid_to string, clause_date string")
    assert sorted((str(x["day"]), x["clause_date"]) for x in R.version_in_force(e, v).collect()) == [("2019-01-01", None), ("2020-05-01", "2019-10"), ("None", None)]
    c = spark.createDataFrame([(True, "2019-01", "2019-02"), (True, None, None), (False, "x", "y"), (True, "2019-02", None)], "k boolean, c string, f string").select(R.currency(F.col("k"), F.col("c"), F.col("f")))
    assert [x[0] for x in c.collect()] == ["older", "no_date_cited", "not_in_registry", "no_version_data"]


def test_acquisition(spark):
    names = {"DEPT OF DEFENSE.DEPT OF THE ARMY": "DOD_ARMY", "Dept of Defense": "DOD_OTHER", "Veterans Affairs, Department Of": "VA", "x": "OTHER", None: "OTHER"}
    assert all(one(spark, A.department, k) == v for k, v in names.items())
    assert one(spark, A.hint_score, "Solicitation SF1449 drawing.pdf") == 3 * 2 - 2
    assert one(spark, A.extension, "a.b.PDF") == ".pdf" and one(spark, A.extension, "none") == ""
    f = spark.createDataFrame([("g", "clauses.pdf", 5), ("g", "rfp.pdf", 90), ("g", "other.pdf", 20), ("g", "last.pdf", 15), ("h", "x.pdf", None)], "grp string, file string, bytes long")
    got = {x["file"]: x["reason"] for x in A.capped_files(f, 2, 100).collect()}
    assert got == {"rfp.pdf": None, "clauses.pdf": None, "other.pdf": "over_file_cap", "last.pdf": "over_file_cap", "x.pdf": None}
    assert {x["file"]: x["reason"] for x in A.capped_files(f, 9, 100).collect()}["other.pdf"] == "over_notice_bytes"
    n = spark.createDataFrame([(f"n{i}", f"2020-{i % 4 + 1:02d}", "big" if i % 2 else f"d{i % 10}") for i in range(80)], "notice_id string, month string, department string")
    sel = A.balanced_selection(n, 20, 0.25).where("selected").collect()
    assert len(sel) == 20 and sum(x["department"] == "big" for x in sel) <= 5 and sorted(x["rank"] for x in sel) == list(range(20))
    assert max(sum(x["month"] == m for x in sel) for m in ("2020-01", "2020-02", "2020-03", "2020-04")) <= 8


def test_ngrams_and_scores(spark):
    assert one(spark, X.char_ngrams, "Ab c") == [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "]
    v = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "zz", 1.0)], "id int, term string, weight double")
    w = spark.createDataFrame([("a", "x", 1.0), ("b", "y", -1.0)], "term string, class string, coef double")
    b = spark.createDataFrame([("x", 0.0), ("y", 0.5)], "class string, b double")
    got = {(r["id"], r["class"]): r["p"] for r in X.linear_scores(v, w, b).collect()}
    s = [1 / (1 + 2.718281828459045 ** -z) for z in (1.0, -1.5)]
    assert abs(got[1, "x"] - s[0] / sum(s)) < 1e-9 and abs(got[2, "x"] + got[2, "y"] - 1) < 1e-9
    folds = X.grouped_folds(spark.createDataFrame([(g,) for g in "aaaabbbccd"], "grp string"), 2)
    assert {r["grp"]: r["fold"] for r in folds.collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}
    rows = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "x double, y double")
    assert X.train_linear(rows, ["x"], "y")[1]["x"] > 0


def docx(body):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    w14 = "http://schemas.microsoft.com/office/word/2010/wordml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:w14="{w14}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_documents(spark, tmp_path):
    box = "<w:tc><w:p><w:sdt><w:sdtPr><w14:checkbox><w14:checked w14:val='1'/></w14:checkbox></w:sdtPr></w:sdt></w:p></w:tc>"
    content = docx(f"<w:p><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr>{box}<w:tc><w:p><w:r><w:t>52.203-6</w:t></w:r></w:p></w:tc></w:tr></w:tbl>")
    assert docx_texts(content) == ("Title\n52.203-6", "Title\n⟦X⟧ 52.203-6")
    for name, data in (("a.docx", content), ("b.txt", "☒ yes\n\nno".encode()), ("c.pdf", b"%PDF-1.7 x"), ("d.docx", b"PK\x03\x04broken"), ("e.txt", b"")):
        (tmp_path / name).write_bytes(data)
    got = {x["path"].rsplit("/", 1)[1]: x for x in read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["text_layout"].endswith("⟦X⟧ 52.203-6") and got["b.txt"]["text_layout"] == "⟦X⟧ yes\nno"
    assert got["c.pdf"]["error"] == "no reader for pdf" and got["d.docx"]["error"] and "e.txt" not in got


def test_section_xml(spark):
    xml = '<DIV8 N="52.203-6" TYPE="SECTION"><HEAD>52.203-6   Restrictions on Sales.</HEAD><P>As prescribed in 3.503, insert the following clause:</P><HD1>Restrictions on Sales (JUN 2020)</HD1><P>text</P><P>(End of clause)</P><P>Alternate I (NOV 2021). As prescribed</P></DIV8>'
    p = parse_section(xml)
    assert (p["number"], p["title"], p["kind"], p["clause_date"], p["alternates"]) == ("52.203-6", "Restrictions on Sales", "clause", "2020-06", [{"name": "Alternate I", "date": "2021-11"}])
    assert parse_section('<DIV8 N="52.1-1"><HEAD>52.1-1 [Reserved]</HEAD></DIV8>')["reserved"]
    rows = read_sections(spark.createDataFrame([(xml,), ("<bad",)], "xml string")).collect()
    assert rows[0]["kind"] == "clause" and rows[1]["error"]
    tree = {"type": "title", "children": [{"type": "chapter", "identifier": "1", "children": [{"type": "part", "identifier": "52"}, {"type": "part", "identifier": "53"}]}, {"type": "chapter", "identifier": "2", "children": [{"type": "part", "identifier": "252"}]}]}
    assert parts_in_tree(tree) == [("52", "1"), ("252", "2")]


def test_config_and_journals(spark, tmp_path):
    (tmp_path / "a.toml").write_text("x = 1\n")
    c = config.load_config("a", tmp_path)
    assert c["x"] == 1 and len(c["_hash"]) == 64
    (tmp_path / ".env").write_text("# no\nA='q w'\nB=\nexport C=3\nnothing\n")
    env = {"C": "kept"}
    config.load_env(tmp_path / ".env", env)
    assert env == {"C": "kept", "A": "q w"}
    with pytest.raises(KeyError):
        config.require_env("B", env)
    m = config.manifest([tmp_path / "a.toml", tmp_path / "gone"], c)
    assert m["files"][0]["bytes"] == 6 and m["files"][1]["missing"]
    journal = str(tmp_path / "journal")
    journals.append_events(spark.createDataFrame([("notice_done", "n1"), ("file", "n2")], "event string, notice_id string"), journal)
    journals.append_events(spark.createDataFrame([("notice_done", "n3")], "event string, notice_id string"), journal)
    assert sorted(x[0] for x in journals.done_keys(spark, journal, "event string, notice_id string", "notice_id").collect()) == ["n1", "n3"]
    days = str(tmp_path / "days")
    journals.write_days(spark.createDataFrame([("2020-01-01", 1), ("2020-01-02", 2)], "day string, v int"), days)
    journals.write_days(spark.createDataFrame([("2020-01-02", 3)], "day string, v int"), days)
    assert sorted(x["v"] for x in journals.read_days(spark, days).collect()) == [1, 3]
    journals.write_days(spark.createDataFrame([("2020-01-03", "x")], "day string, contact_name string"), days)
    with pytest.raises(ValueError):
        journals.read_days(spark, days)
    cache = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)], "key string, answer string, seq int")
    hit, miss = journals.with_cached(spark.createDataFrame([("k",), ("m",)], "key string"), cache)
    assert [x["answer"] for x in hit.collect()] == ["new"] and [x["key"] for x in miss.collect()] == ["m"]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"sha256": s, "ts": "2020-01-01T00:00:00"}) for s in ("a", "b", "a")))
    seen = []

    def keep(batch, number):
        seen.extend(x["sha256"] for x in batch.collect())

    for _ in range(2):
        run_batches(arriving_files(spark, str(tmp_path / "in"), "sha256 string, ts string"), keep, str(tmp_path / "checkpoint"))
    assert sorted(seen) == ["a", "b"]
