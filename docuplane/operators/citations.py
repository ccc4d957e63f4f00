"""Citations in page text: plain number search, and mentions with offsets and context.

All of it is column expressions. A match's groups and place come from one replace that
wraps each match in control characters, followed by a split: a segment then holds the
match's groups, the match and the text up to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docuplane.functions import patterns as P
from docuplane.functions.normal import named_month

_OPEN, _SEP, _CLOSE = "\x01", "\x03", "\x02"
MAX_RANGE = 60


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x1c-\x1f\u0085\p{Z}]+|[\s\x1c-\x1f\u0085\p{Z}]+$", "")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none or it is empty."""
    got = F.regexp_extract(text, pattern, group)
    return F.when(got != "", got)


def plain_numbers(text: Column) -> Column:
    """Distinct numbers of the plain search: a known part not after a digit, with an
    optional suffix of up to four digits after an ASCII hyphen."""
    def part_numbers(part: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(rf"(?<!\d)({part}\.\d{{3}}(?:-\d{{1,4}})?)"), F.lit(1))
        return F.when(text.contains(f"{part}."), hits).otherwise(F.array().cast("array<string>"))  # most parts are on few pages

    every = F.flatten(F.array(*[part_numbers(p) for p in P.PLAIN_PARTS]))
    return F.array_sort(F.array_distinct(every))


def page_lines(pages: DataFrame, text: str = "text_layout") -> DataFrame:
    """``page_id, doc_id, page, line_no, line``, blank lines included, numbered from 0."""
    return pages.select("page_id", "doc_id", "page", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def line_offsets(pages: DataFrame, text: str = "text_layout") -> DataFrame:
    """Lines with ``line_start``, the code points of the page before each."""
    before = W.partitionBy("page_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return page_lines(pages, text).withColumn("line_start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def _number_lines(pages: DataFrame, text: str) -> DataFrame:
    lines = F.split(text, "\n")
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.get(lines, i + 1).alias("following")))
    kept = F.filter(marked, lambda s: s["line"].rlike(P.MAYBE_NUMBER))
    rows = pages.where(F.col(text).rlike(P.MAYBE_NUMBER)).select("page_id", "doc_id", "page", F.col(text).alias("_text"), F.explode(kept).alias("l"))
    start = F.when(F.col("l.line_no") == 0, 0).otherwise(F.length(F.expr("substring_index(_text, '\n', l.line_no)")) + 1)
    return rows.select("page_id", "doc_id", "page", "l.*", start.alias("line_start"))


def number_matches(pages: DataFrame, text: str = "text_layout") -> DataFrame:
    """One row for each match of the extended number pattern, with its line and place."""
    wrapped = F.regexp_replace("line", P.NUMBER, f"{_OPEN}$1{_SEP}$2{_SEP}$3{_SEP}$4{_SEP}$0{_CLOSE}")
    lines = _number_lines(pages, text).withColumn("_seg", F.split(wrapped, _OPEN)).where(F.size("_seg") > 1)
    # a segment's share of the line: all of the first, else the match and what follows it
    share = F.transform("_seg", lambda s, i: F.when(i == 0, F.length(s)).otherwise(F.length(F.element_at(F.split(s, _SEP), -1)) - 1))
    lines = lines.withColumn("_len", share)
    rows = lines.select("*", F.posexplode("_seg").alias("match_no", "_s")).where("match_no > 0")
    g = F.split("_s", _SEP)
    full = F.split(F.get(g, F.lit(4)), _CLOSE)
    before = F.aggregate(F.slice("_len", F.lit(1), F.col("match_no")), F.lit(0), lambda a, x: a + x)
    rows = rows.select(
        "page_id", "doc_id", "page", "line_no", "line", "following", "line_start", "match_no",
        F.when(F.get(g, F.lit(0)) != "", F.get(g, F.lit(0))).alias("prefix"), F.get(g, F.lit(1)).alias("part"), F.get(g, F.lit(2)).alias("section"), F.when(F.get(g, F.lit(3)) != "", F.get(g, F.lit(3))).alias("suffix"),
        before.alias("match_start"), F.get(full, F.lit(0)).alias("match"), F.coalesce(F.get(full, F.lit(1)), F.lit("")).alias("rest"),
    )
    lead = F.length(F.regexp_extract("match", r"(?i)^([A-Za-z]*\s*)", 1))
    return rows.withColumn("start", F.col("match_start") + lead).withColumn("end", F.col("match_start") + F.length("match"))


def mentions(pages: DataFrame, registry: DataFrame | None = None, text: str = "text_layout") -> DataFrame:
    """Candidate mentions, one row each, with the columns of the candidates table.

    ``registry``: ``number, status``; without it ``in_registry`` is null. ``cited_date``
    is the month of the first dated parenthesis before the next number, else of one that
    opens the next line, else of an alternate named before the number. Pages with a
    null or empty text have no mentions.
    """
    m = number_matches(pages, text)
    sub = found(F.col("rest"), P.SUBPARAGRAPH)
    sub_len = F.length(F.regexp_extract("rest", P.SUBPARAGRAPH, 0))
    m = m.withColumns({"subpara": sub, "end2": F.col("end") + sub_len, "after": F.substr("rest", sub_len + 1)})
    head = F.expr("substring(line, 1, match_start)")
    left = F.expr("substring(line, 1, start)")
    own = named_month(found(F.col("after"), P.DATED))
    wrapped = named_month(found(F.coalesce("following", F.lit("")), P.DATED_START))
    alt_after = found(F.col("after"), P.ALTERNATE_AFTER)
    alt_before = found(head, P.ALTERNATE_BEFORE)
    alt_date = F.when(alt_after.isNull(), named_month(found(head, P.ALTERNATE_BEFORE, 2)))
    near = F.expr("substring(line, greatest(start - 1, 1), least(start, 2))")
    near3 = F.expr("substring(line, greatest(start - 2, 1), least(start, 3))")
    tail2 = F.expr("substring(line, end2 + 1, 2)")
    hints = F.filter(
        F.array(
            F.when(near.contains("$"), F.lit("money")),
            F.when(near.rlike(r"\d,$") | near3.rlike(r"\d[.,]\s?$"), F.lit("longer_number")),
            F.when(tail2.rlike(r"^\s?%"), F.lit("percent")),
            F.when(tail2.rlike(r"^\p{Nd}"), F.lit("followed_by_digit")),
            F.when(tail2.rlike(r"^\.\d"), F.lit("decimal_continuation")),
        ),
        lambda h: h.isNotNull(),
    )
    number = F.concat("part", F.lit("."), "section", F.coalesce(F.concat(F.lit("-"), "suffix"), F.lit("")))
    codes = F.create_map(*[F.lit(x) for kv in P.REGULATIONS.items() for x in kv])
    base = m.select(
        "page_id", "doc_id", "page", "line_no", "match_no", "part", "section", "suffix", "line", "line_start", "start", "end", "rest",
        F.lit(0).alias("copy_no"),
        (F.col("line_start") + F.col("start")).alias("char_start"),
        (F.col("line_start") + F.col("end2")).alias("char_end"),
        F.expr("substring(line, start + 1, end2 - start)").alias("raw"),
        number.alias("number"), F.try_element_at(codes, F.col("part")).alias("regulation"), "prefix", "subpara", stripped(F.col("line")).alias("line_text"),
        F.coalesce(own, wrapped, alt_date).alias("cited_date"),
        F.concat(F.lit("Alternate "), F.upper(F.coalesce(alt_after, alt_before))).alias("alternate"),
        stripped(found(F.col("line"), P.DEVIATION, 0)).alias("deviation_marker"),
        F.try_element_at(F.regexp_extract_all(left, F.lit(f"({P.MARKER})"), F.lit(1)), F.lit(-1)).alias("box_marker"),
        F.lit(False).alias("from_range"), hints.alias("nonclause_hints"),
    )
    every = base.drop("rest", "end").unionByName(_range_copies(base))
    order = W.partitionBy("page_id").orderBy("line_no", "match_no", "copy_no")
    named = every.withColumn("ordinal", F.row_number().over(order) - 1).withColumn("cand_id", F.concat("doc_id", F.lit("-p"), F.col("page").cast("string"), F.lit("-"), F.col("ordinal").cast("string")))
    if registry is None:
        named = named.withColumns({"in_registry": F.lit(None).cast("boolean"), "registry_status": F.lit(None).cast("string")})
    else:
        known = registry.select("number", F.col("status").alias("registry_status"))
        named = named.join(known, "number", "left").withColumn("in_registry", F.col("registry_status").isNotNull())
    return named.select(
        "page_id", "cand_id", "doc_id", "page", "line_no", "char_start", "char_end", "raw", "number", "regulation", "prefix", "subpara", "line_text", "cited_date", "alternate", "deviation_marker", "box_marker", "from_range", "nonclause_hints", "in_registry", "registry_status"
    )


def _range_copies(base: DataFrame) -> DataFrame:
    """The numbers between the ends of a range, and its end where that is abbreviated."""
    tail = F.expr("substring(line, `end` + 1, length(line))")  # an end written out is the next match, so the segment does not reach it
    b, s, e = (found(tail, P.RANGE, i) for i in (1, 2, 3))
    r = base.where(F.col("suffix").isNotNull()).withColumns({"_b": b, "_sec": s, "_lo": F.col("suffix").cast("int"), "_hi": e.cast("int"), "_n": F.length(F.regexp_extract(tail, P.RANGE, 0))})
    r = r.where(F.col("_hi").isNotNull() & (F.col("_b").isNull() | ((F.col("_b") == F.col("part")) & (F.col("_sec") == F.col("section")))) & (F.col("_lo") < F.col("_hi")) & (F.col("_hi") <= F.col("_lo") + MAX_RANGE))
    last = F.when(F.col("_b").isNotNull(), F.col("_hi") - 1).otherwise(F.col("_hi"))
    r = r.withColumn("_last", last).where("_last > _lo")
    r = r.select("*", F.explode(F.expr("sequence(_lo + 1, _last)")).alias("_k"))
    return r.select(
        "page_id", "doc_id", "page", "line_no", "match_no", "part", "section", "suffix", "line", "line_start", "start", (F.col("_k") - F.col("_lo")).alias("copy_no"),
        "char_start", (F.col("line_start") + F.col("end") + F.col("_n")).alias("char_end"), F.expr("substring(line, start + 1, `end` + _n - start)").alias("raw"),
        F.concat("part", F.lit("."), "section", F.lit("-"), F.col("_k").cast("string")).alias("number"), "regulation",
        F.when(F.col("_k") != F.col("_hi"), F.col("prefix")).alias("prefix"), F.lit(None).cast("string").alias("subpara"), "line_text", "cited_date",
        F.lit(None).cast("string").alias("alternate"), "deviation_marker", "box_marker", F.lit(True).alias("from_range"), F.array().cast("array<string>").alias("nonclause_hints"),
    )
