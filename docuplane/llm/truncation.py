"""Texts whose end is missing, by a structural completeness check.

A stack automaton reads each text's structural tokens (quotes of all kinds, brackets,
markup tags) and its last line: what is still open at the end, a broken character or
escape, an ellipsis in place of the rest, or a missing terminator. Lines that need no
terminator (list items, table rows, headings, dates, signatures, other short closing
lines) are recognised by shape.

Two baselines of each source judge what the shape leaves open. Its field limits are the
lengths at which far more of its texts end without a terminator than at the lengths
around; a weak closing line just at a limit counts as cut. And its habit is how often
its texts that are not at a limit do end in a terminator: where a source hardly ever
sets one, a missing terminator says nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docuplane.session import stage_table

_STRUCTURE = re.compile(r"[()\[\]{}“”«»\"]|<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?(/?)>|\n\s*\n")
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
# Elements that are never closed.
_VOID = frozenset({"br", "hr", "img", "input", "meta", "link", "wbr", "col", "area", "base", "source"})
_CLOSERS = "'\"”’»)]"
_TERMINATORS = ".!?。！？…"
_ELLIPSIS = re.compile(r"\w\s?(?:\.\.\.|…)\Z")
_BROKEN = re.compile(r"(?:\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&#?\w{1,7}|%[0-9A-F]?|=[0-9A-F]?=?)\Z")
_OPEN_TAG = re.compile(r"<(?:/?[a-zA-Z][\w:-]*(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"<>]*\"?|'[^'<>]*'?|[^\s<>\"']*))?)*\s*/?|/)?\Z")
_AMPERSAND_WORD = re.compile(r"\w&\w*$")
_ITEM = re.compile(r"^\s*(?:\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}\)|[-–•*‣▪·o])\s+\S")
_ROW = re.compile(r"^\s*\|.*\|$|^[^\t]*\t.*$")
_OPEN_ROW = re.compile(r"^\s*\|.*[^|]$")
_DATE = re.compile(r"^\W*(?:[A-Za-z]+,? )?(?:\d{1,2}(?:st|nd|rd|th)? [A-Za-z]{3,9}\.?,? \d{4}|[A-Za-z]{3,9}\.? \d{1,2}(?:st|nd|rd|th)?, \d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\W*$")
# a field: a label of at most three words and a value of at most four
_FIELD = re.compile(r"^[A-Z][\w/.#-]*(?: [\w/.#-]+){0,2}:\s*\S+(?:\s\S+){0,3}$")
# Words that headings leave in lower case.
_SMALL = frozenset("a an and de for in of on or the to y".split())


def _titled(line: str) -> bool:
    """A signature or a heading: capitals only, or at least two capitalised words."""
    words = re.findall(r"[^\W\d_][\w'’/-]*", line)
    if not words:
        return False
    if line.upper() == line and len(max(words, key=len)) > 1:
        return True
    main = [w for w in words if w.lower() not in _SMALL]
    return len(main) > 1 and words[0][:1].isupper() and all(w[:1].isupper() for w in main)


def structure_state(text: str) -> str:
    """How a text ends: 'complete', 'closing', 'heading' (also signatures and fields), 'item',
    or a reason why it is cut."""
    body = text.rstrip()
    if not body:
        return "complete"
    line = body[body.rfind("\n") + 1 :]
    if body[-1] == "�" or "\ud800" <= body[-1] <= "\udbff":
        return "broken"
    # escapes are as short as their patterns, so that they lie in the last word; a tag begins at the last '<'
    word = line.split()[-1]
    if _BROKEN.search(word) and not _AMPERSAND_WORD.search(word):
        return "broken"
    opened = body.rfind("<")
    if opened > body.rfind(">") and _OPEN_TAG.match(body, opened):
        return "broken"
    if _ELLIPSIS.search(body, max(0, len(body) - 5)):
        return "ellipsis"
    stack: list[tuple[str, bool]] = []
    for m in _STRUCTURE.finditer(body):
        token = m.group()
        if token == '"':  # a straight quote closes the open one; it opens one only before a word and after none
            at, end = m.span()
            if any(x == ('"', False) for x in stack):
                while stack.pop() != ('"', False):
                    pass
            elif (not at or body[at - 1].isspace() or body[at - 1] in "([{—–-") and end < len(body) and not body[end].isspace():
                stack.append((token, False))
        elif token in "([{“«":
            stack.append((token, False))
        elif token in _PAIRS:
            if stack and stack[-1][0] == _PAIRS[token]:
                stack.pop()
        elif token[0] == "<":
            name = m.group(2).lower()
            if m.group(1):
                while stack and stack[-1] != (name, True):
                    stack.pop()
                if stack:
                    stack.pop()
            elif not m.group(3) and name not in _VOID:
                stack.append((name, True))
        else:  # a new paragraph: brackets and quotes do not reach over it, markup does
            stack = [x for x in stack if x[1]]
    if any(not tag for _, tag in stack):
        return "unclosed"
    if body.rstrip(_CLOSERS)[-1:] in tuple(_TERMINATORS):
        return "unclosed" if stack else "complete"
    if _ROW.match(line) or _DATE.match(line):
        return "closing"
    if _OPEN_ROW.match(line):
        return "open row"
    if _ITEM.match(line):
        return "item"
    if body.endswith(">") and not stack:
        return "complete"
    if _FIELD.match(line) or _titled(line):
        return "heading"
    return "no terminator"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([None if t is None else structure_state(t) for t in texts], pa.string()), pa.array([0 if t is None else len(t) for t in texts], pa.int64()), pa.array([0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())],
            names=["id", "source", "state", "n_chars", "n_bytes"],
        )


CUT = ("broken", "ellipsis", "unclosed", "open row", "no terminator")
#: States that a length at a limit of the source turns into a cut.
WEAK = ("item", "heading")


def field_limits(states: DataFrame, *, least: int = 4, factor: float = 8.0, around: int = 60) -> DataFrame:
    """``source, unit, field_limit, n_at_limit``: lengths at which a source cuts.

    A limit has at least ``least`` unterminated texts of exactly that length, and
    ``factor`` times as many as a length within ``around`` of it has on the average; six
    deviations of that average come on top of ``least``, so that no chance makes a limit.
    """
    cut = states.where(F.col("state").isin(*CUT))
    lengths = cut.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length")))).alias("l")).groupBy("source", "l.unit", "l.length").agg(F.count(F.lit(1)).alias("n"))
    beside = W.partitionBy("source", "unit").orderBy("length").rangeBetween(-around, around)
    peak = lengths.withColumn("others", (F.sum("n").over(beside) - F.col("n")) / (2.0 * around))
    # the bytes a cut inside a character leaves, and blanks taken off, fall just below a limit
    peak = peak.withColumn("above", F.sum("n").over(W.partitionBy("source", "unit").orderBy("length").rangeBetween(1, 4)))
    mean = F.greatest(F.col("others") - F.coalesce("above", F.lit(0)) / (2.0 * around), F.lit(0.0))
    found = peak.where((F.col("n") >= least + 6 * F.sqrt(mean)) & (F.col("n") >= factor * mean) & (F.coalesce("above", F.lit(0)) <= F.col("n")))
    return found.select("source", "unit", F.col("length").alias("field_limit"), F.col("n").alias("n_at_limit"))


def _lengths() -> Column:
    return F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length")))).alias("l")


def terminator_habit(states: DataFrame, at_limit: DataFrame, prior: float = 5.0) -> DataFrame:
    """``source, habit``: how often the source's texts that are at no limit end in a
    terminator, of those that end in running text; drawn to the rate of all sources as
    if ``prior`` more texts had it, so that a few texts decide nothing."""
    free = states.where(F.col("state").isin("complete", "no terminator") & (F.col("n_chars") > 0)).join(at_limit, states["id"] == at_limit["at_id"], "left_anti")
    n = free.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "complete").alias("k"))
    every = n.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    return n.join(F.broadcast(every)).select("source", ((F.col("k") + prior * F.try_divide("all_k", "all_n")) / (F.col("n") + prior)).alias("habit"))


def truncated_texts(rows: DataFrame, *, text: str = "text", source: Column | None = None, row_id: str = "doc_id", least_habit: float = 0.2) -> DataFrame:
    """``id, source, state, n_chars, n_bytes, at_limit, truncated`` for every row.

    ``source``: the normal form of a row's source; null is a source of its own. A text
    without a terminator is truncated unless fewer than ``least_habit`` of its source's
    texts set one and its length is no limit of the source; if all sources were like
    that, none of their texts would be. Null and empty texts are not truncated; their
    state is null and 'complete'. Rows repeat as they do in the table, texts are read
    whole, very long ones too; an empty table gives no rows. Other columns are not read,
    whatever their names.
    """
    src = source if source is not None else F.lit(None).cast("string")
    read = rows.select(F.col(row_id).alias("id"), F.coalesce(src, F.lit("")).alias("source"), F.col(text).cast("string").alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    states = stage_table(read.mapInArrow(_states, f"id {kind}, source string, state string, n_chars long, n_bytes long"), "text-states")
    limits = field_limits(states)
    near = states.where(F.col("state").isin("no terminator", *WEAK)).select("id", "source", "state", _lengths())
    at = near.join(limits, (near["source"] == limits["source"]) & (F.col("l.unit") == limits["unit"]) & F.col("l.length").between(limits["field_limit"] - 1, limits["field_limit"])).select(F.col("id").alias("at_id")).distinct()
    at = stage_table(at, "texts-at-limits")
    judged = states.join(at, F.col("id") == F.col("at_id"), "left").join(terminator_habit(states, at), "source", "left")
    at_limit = F.col("at_id").isNotNull()
    cut = F.col("state").isin(*[x for x in CUT if x != "no terminator"]) | at_limit | ((F.col("state") == "no terminator") & (F.coalesce("habit", F.lit(1.0)) >= least_habit))
    return judged.select("id", F.when(F.col("source") != "", F.col("source")).alias("source"), "state", "n_chars", "n_bytes", at_limit.alias("at_limit"), F.coalesce(cut, F.lit(False)).alias("truncated"))
