"""Repair of text from scanned pages.

A first pass counts, over all pages, the words that stand whole inside lines, and takes
each page's edge lines. Words of at least ``min_share`` of the pages make the lexicon;
as a page holds some hundred different words, it has at most that many divided by
``min_share`` entries, whatever the size of the collection, and is broadcast. Running
headers and page numbers are found by aggregates over edge lines by document.

A second pass takes the lines off each page and decodes its stream of characters as a
lattice, from the page's first word to its last: an edge is a word as it stands, a word
with confused characters, words that lack the blank between them, a word with a stray
blank in it or broken over a line end with or without a hyphen, or a stretch cut into
other words altogether. The cheapest way through (Viterbi) decides all of them jointly;
what the confusions cost is learnt from how often the collection shows each of them.
Stretches of known words have one way through only, so that the search runs between
them and its results are kept by spelling. Defects and repaired text both come from this
one decoding. Paragraph boundaries are chosen by dynamic programming over the lines.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docuplane.session import stage_table

# What is read, and what stands there.
LOOKALIKES = (
    ("c", "e"), ("@", "a"), ("f", "t"), ("ri", "n"), ("0", "o"), ("!", "i"), ("1", "l"), ("l", "i"), ("5", "s"), ("ii", "u"), ("cl", "d"), ("rn", "m"),
    ("9", "g"), ("b", "h"), ("6", "b"), ("vv", "w"), ("m", "rn"), ("d", "cl"), ("n", "ri"), ("|", "l"), ("|", "i"), ("1", "i"), ("$", "s"), ("8", "b"), ("q", "g"),
)
_ONE = str.maketrans({"c": "e", "@": "a", "f": "t", "0": "o", "!": "i", "1": "i", "l": "i", "|": "i", "5": "s", "$": "s", "9": "g", "q": "g", "b": "h", "6": "h", "8": "h"})
_LINE_HYPHENS = "-\u00ad‐‑¬–"
HYPHENS = re.compile(r"[-­‐‑‒–−¬]")
_READABLE = re.compile(r"[\w!@|$]+")
#: What a word pays for running over a blank, a line end, and a hyphen at a line end.
_RUNS_ON = {" ": 4.0, "\n": 3.0, "-\n": 0.5}
_EDGE = ".,;:()[]{}\"“”'’?"
CLAUSE = re.compile(r"\d{2,4}\s?\.\s?\d{3}")
_CLAUSE_LINE = re.compile(r"^\s*(?:⟦.⟧\s*)?(?:[A-Z]{3,6}\s+)?\d{2,4}\s?\.\s?\d{3}")
_SECTION = re.compile(r"^\s*[A-Z]\.\d+\s")
_PAGE = r"(?:page\s*[\dlo]{1,5}(?:\s*of\s*[\dlo]{1,5})?|pg\.?\s*[\dlo]{1,5}|\[\s*\d{1,5}\s*\]|[-–—]\s*\d{1,5}\s*[-–—]|\d{1,5}\s*/\s*\d{1,5})"
_ROMAN = r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
PAGE_LINE = re.compile(rf"^\s*(?:{_PAGE}|\d{{1,4}}|{_ROMAN})\s*$", re.IGNORECASE)
_PAGE_PART = re.compile(rf"^\s*{_PAGE}\s+(?=\S)|(?<=\S)\s+{_PAGE}\s*$", re.IGNORECASE)
_BARE = re.compile(r"^\s*\d+\s*$")


def ends_broken(line: str) -> bool:
    """Whether a line ends in a hyphen right after characters of a word."""
    end = len(line.rstrip())
    if end < 2 or line[end - 1] not in _LINE_HYPHENS:
        return False
    at = end - 1
    while at and (line[at - 1].isalnum() or line[at - 1] in "_!@|$"):
        at -= 1
        if line[at].isalpha():
            return True
    return False


@lru_cache(maxsize=200_000)
def shape(word: str) -> str:
    """The word with characters that are taken for each other made one."""
    # runs first as they are read, then again as single characters made one have left them
    s = word
    for a, b in (("cl", "d"), ("ri", "n"), ("ii", "u"), ("rn", "m"), ("vv", "w")):
        s = s.replace(a, b)
    s = s.translate(_ONE)
    for a, b in (("ei", "d"), ("ri", "n"), ("ii", "u"), ("rn", "m")):
        s = s.replace(a, b)
    return s


def explained(read: str, meant: str, most: int = 4) -> tuple[tuple[str, str], ...] | None:
    """The fewest confusions that turn ``meant`` into ``read``; None if none do."""
    best: dict[tuple[int, int], tuple[tuple[str, str], ...]] = {(0, 0): ()}
    for i in range(len(read) + 1):
        for j in [j for (x, j) in best if x == i]:
            so_far = best[i, j]
            if read[i : i + 1] and read[i] == meant[j : j + 1] and ((i + 1, j + 1) not in best or len(best[i + 1, j + 1]) > len(so_far)):
                best[i + 1, j + 1] = so_far
            for a, b in LOOKALIKES if len(so_far) < most else ():
                at = (i + len(a), j + len(b))
                if read.startswith(a, i) and meant.startswith(b, j) and (at not in best or len(best[at]) > len(so_far) + 1):
                    best[at] = (*so_far, (a, b))
    return best.get((len(read), len(meant)))


def confusions(read: str, meant: str, most: int = 4) -> int | None:
    """How many confusions turn ``meant`` into ``read``; None if none do."""
    found = explained(read, meant, most)
    return None if found is None else len(found)


class Chunk(NamedTuple):
    """What stands between blanks: its parts between hyphens, as read and in lower case,
    whether it begins and ends without punctuation, and whether there is nothing to decode."""

    parts: tuple[str, ...]
    low: tuple[str, ...]
    opens: bool
    closes: bool
    sure: tuple[bool, ...]


class Edit(NamedTuple):
    """Parts ``first`` to ``last`` of a page's stream, read as other words."""

    first: int
    last: int
    words: tuple[str, ...]
    confused: int


class Stream(NamedTuple):
    """A page without its lines: parts, where each stands (line, chunk, part) and what
    follows it: a blank, a line end, a hyphen, both, or what no word runs over."""

    raw: list[str]
    low: list[str]
    at: list[tuple[int, int, int]]
    after: list[str]
    edits: list[Edit]


class Lexicon:
    """Words with their numbers of pages, by spelling, by shape and as a prefix tree."""

    def __init__(self, pages: dict[str, int], ratio: float = 20.0, prices: dict[tuple[str, str], float] | None = None) -> None:
        by_shape: dict[str, list[str]] = defaultdict(list)
        for w in sorted(pages, key=lambda w: (-pages[w], w)):
            # a frequent misreading of a far more frequent word is no word
            if any(pages[v] >= ratio * pages[w] and confusions(w, v) for v in by_shape[shape(w)]):
                continue
            by_shape[shape(w)].append(w)
        self.pages = {w: pages[w] for ws in by_shape.values() for w in ws}
        self.by_shape = dict(by_shape)
        total = sum(self.pages.values()) or 1
        self.cost = {w: 2.0 + 0.3 * log(total / n) for w, n in self.pages.items()}
        self._tree: dict | None = None
        self._known: dict[str, str | None] = {}
        self._segmented: dict[tuple[str, float], list[tuple[str, int, int]] | None] = {}
        self.prices = {x: (prices or {}).get(x, 3.0) for x in LOOKALIKES}
        self._chunks: dict[str, Chunk] = {}
        self._ways: dict[str, list[Edit]] = {}

    @property
    def tree(self) -> dict:
        if self._tree is None:
            self._tree = {}
            for w in self.pages:
                node = self._tree
                for ch in w:
                    node = node.setdefault(ch, {})
                node["$word"] = w
        return self._tree

    def corrected(self, word: str) -> str | None:
        """The lexicon word of which ``word`` is a misreading, or None."""
        if word in self.pages:
            return None
        if word not in self._known:
            if len(self._known) > 300_000:
                self._known.clear()
            found = [(self.cost[v] + sum(self.prices[x] for x in e), v) for v in self.by_shape.get(shape(word), ()) if (e := explained(word, v)) and 2 * len(e) <= len(v) + 1]
            self._known[word] = min(found)[1] if found else None
        return self._known[word]

    def decode(self, stream: str, slack: float = 24.0) -> list[str] | None:
        """The cheapest words for a stretch of lower-case characters with blanks and line
        ends; None where no words cover it all."""
        found = self.segments(stream, slack)
        return None if found is None else [w for w, _, _ in found]

    def segments(self, stream: str, slack: float = 24.0) -> list[tuple[str, int, int]] | None:
        """``decode`` with where each word begins and ends, by a search over positions."""
        key = (stream, slack)
        if key not in self._segmented:
            if len(self._segmented) > 100_000:
                self._segmented.clear()
            self._segmented[key] = self._search(stream, slack)
        return self._segmented[key]

    def _search(self, stream: str, slack: float) -> list[tuple[str, int, int]] | None:
        end = len(stream)
        best: list[tuple[float, list[tuple[str, int, int]]] | None] = [None] * (end + 1)
        best[0] = (0.0, [])
        for i in range(end):
            if best[i] is None or best[i][0] > slack:
                continue
            paid, words = best[i]
            stack = [(i, self.tree, paid, False)]
            while stack:
                at, node, cost, begun = stack.pop()
                if cost > slack:
                    continue
                word = node.get("$word")
                if word is not None:
                    total = cost + self.cost[word]
                    # the blank after a word, or 4 for its absence
                    for to, more in ((at + 1, 0.0),) if at < end and stream[at] in " \n" else ((at, 0.0 if at == end else 4.0),):
                        if best[to] is None or best[to][0] > total + more:
                            best[to] = (total + more, [*words, (word, i, at)])
                if at >= end:
                    continue
                ch = stream[at]
                if ch in node:
                    stack.append((at + 1, node[ch], cost, True))
                if begun and ch == " ":
                    stack.append((at + 1, node, cost + 4.0, True))
                elif begun and ch == "\n":
                    stack.append((at + 1, node, cost + 3.0, True))
                elif begun and HYPHENS.match(ch) and stream[at + 1 : at + 2] == "\n":
                    stack.append((at + 2, node, cost + 0.5, True))
                for a, b in LOOKALIKES:
                    if stream.startswith(a, at):
                        into = node
                        for x in b:
                            into = into.get(x)
                            if into is None:
                                break
                        if into is not None:
                            stack.append((at + len(a), into, cost + self.prices[a, b], True))
        return best[end][1] if best[end] else None


    def chunk(self, text: str) -> Chunk:
        found = self._chunks.get(text)
        if found is None:
            if len(self._chunks) > 300_000:
                self._chunks.clear()
            core = text.strip(_EDGE)
            parts = tuple(p for p in HYPHENS.split(core) if p)
            low = tuple(p.lower() for p in parts)
            fixed = CLAUSE.search(text) is not None
            sure = tuple(fixed or p in self.pages or len(p) < 2 or not _READABLE.fullmatch(p) or not any(ch.isalpha() for ch in p) for p in low)
            found = self._chunks[text] = Chunk(parts, low, bool(parts) and not fixed and text.startswith(parts[0]), bool(parts) and not fixed and text.endswith(parts[-1]), sure)
        return found

    def stream(self, lines: list[str]) -> Stream:
        """The page's lines as one stream, decoded."""
        raw, low, at, after, open_ = [], [], [], [], []
        for n, line in enumerate(lines):
            chunks = line.split()
            if not chunks and after:
                after[-1] = "|"
            for k, text in enumerate(chunks):
                c = self.chunk(text)
                if after and (not c.opens or not c.parts):
                    after[-1] = "|"
                for i, part in enumerate(c.parts):
                    if not c.sure[i]:
                        open_.append(len(raw))
                    raw.append(part)
                    low.append(c.low[i])
                    at.append((n, k, i))
                    after.append("-")
                if c.parts:
                    after[-1] = " " if c.closes else "|"
            if chunks and after and at[-1][0] == n:
                if ends_broken(line) and at[-1][1] == len(chunks) - 1:
                    after[-1] = "-\n"
                    open_.append(len(raw) - 1)
                elif after[-1] == " ":
                    after[-1] = "\n"
        if after:
            after[-1] = "|"
        for i, sep in enumerate(after):  # what goes on after a hyphen begins like a word
            if sep == "-\n" and not (low[i + 1][0].isalpha() or low[i + 1][0] in "!@|$015689"):
                after[i] = "|"
        edits: list[Edit] = []
        done = taken = -1
        for i in sorted(set(open_)):
            if i <= done:
                continue
            # a word that is known on either side belongs to the stretch: it may be a piece
            first = i - 1 if i - 1 > max(done, taken) and after[i - 1] not in "|-" else i
            last, known = i, 0
            while after[last] not in "|-" and known < 2:
                last += 1
                known = known + 1 if self._settled(low[last]) and after[last] != "-\n" else 0
            edits.extend(Edit(e.first + first, e.last + first, e.words, e.confused) for e in self._way(raw[first : last + 1], after[first:last]))
            done = last - 1 if known else last
            taken = edits[-1].last if edits else -1
        return Stream(raw, low, at, after, edits)

    def _settled(self, low: str) -> bool:
        return low in self.pages or not _READABLE.fullmatch(low) or not any(ch.isalpha() for ch in low)

    def _way(self, raw: list[str], after: list[str]) -> list[Edit]:
        """The cheapest way through a stretch, as what it reads differently."""
        key = "".join(x + y for x, y in zip(raw, [*after, ""]))
        found = self._ways.get(key)
        if found is None:
            if len(self._ways) > 200_000:
                self._ways.clear()
            found = self._ways[key] = self._viterbi(raw, after)
        return found

    def _viterbi(self, raw: list[str], after: list[str]) -> list[Edit]:
        n = len(raw)
        low = [x.lower() for x in raw]
        unknown = [not self._settled(w) and self.corrected(w) is None for w in low]
        piece = [(i < n - 1 and after[i] == "-\n") or (i > 0 and after[i - 1] == "-\n") for i in range(n)]
        alone = [self.cost.get(w, 6.0) if not u else 11.0 + 0.5 * len(w) for w, u in zip(low, unknown)]
        best: list[tuple[float, int, Edit | None]] = [(0.0, -1, None)] + [(9e9, -1, None)] * n

        def offer(i: int, j: int, price: float, edit: Edit | None) -> None:
            total = best[i][0] + price
            if total < best[j + 1][0]:
                best[j + 1] = (total, i, edit)

        for i in range(n):
            w = low[i]
            v = self.corrected(w) if not piece[i] and misread_word(self, w) else None
            if v is not None:
                e = explained(w, v)
                offer(i, i, self.cost[v] + sum(self.prices[x] for x in e), Edit(i, i, (v,), len(e)))
            else:  # left as it is; a hyphen that stays at a line end has its price too
                offer(i, i, alone[i] + (3.0 if i < n - 1 and after[i] == "-\n" else 0.0), None)
            if unknown[i] and not piece[i] and len(w) > 5 and w.isalpha() and (raw[i].islower() or len(w) > 8):
                cut = self.segments(w, alone[i])
                # a capitalised one may be a name, so that its words must stand there as they are
                if cut and len(cut) > 1 and (raw[i].islower() or "".join(x for x, _, _ in cut) == w):
                    offer(i, i, sum(self.cost[x] for x, _, _ in cut) + 4.0 * (len(cut) - 1), Edit(i, i, tuple(x for x, _, _ in cut), 0))
            price = 0.0
            for j in range(i + 1, min(n, i + 5)):
                sep = after[j - 1]
                price += _RUNS_ON[sep]
                if sep != "-\n" and not (raw[j][:1].islower() or raw[j].isupper() and raw[i].isupper()):
                    break
                whole = "".join(low[i : j + 1])
                hyphens = all(x == "-\n" for x in after[i:j])
                if not hyphens and (not any(unknown[i : j + 1]) or len(whole) < 5 or not low[j][0].isalpha()):
                    continue
                if whole in self.pages:
                    offer(i, j, price + self.cost[whole], Edit(i, j, (whole,), 0))
                elif (v := self.corrected(whole)) is not None:
                    offer(i, j, price + self.cost[v] + sum(self.prices[x] for x in explained(whole, v)), Edit(i, j, (v,), len(explained(whole, v))))
                elif j == i + 1 and sep == " " and unknown[i] and unknown[j] and whole.isalpha():
                    cut = self.segments(f"{low[i]} {low[j]}", alone[i] + alone[j])
                    if cut and len(cut) > 1:
                        offer(i, j, sum(self.cost[x] for x, _, _ in cut) + 8.0, Edit(i, j, tuple(x for x, _, _ in cut), 0))
        out, k = [], n
        while k > 0:
            _, was, edit = best[k]
            if edit:
                out.append(edit)
            k = was
        return out[::-1]


def letters(chunk: str) -> list[str]:
    """The parts between hyphens of a chunk between blanks, lower case, without punctuation at the edges."""
    return [p for p in HYPHENS.split(chunk.strip(_EDGE).lower()) if p]


def _unknown(lexicon: Lexicon, word: str) -> bool:
    return len(word) > 1 and any(ch.isalpha() for ch in word) and word not in lexicon.pages and lexicon.corrected(word) is None


def _whole_words(lines: list[str]) -> set[str]:
    found: set[str] = set()
    carried = False
    for line in lines:
        chunks = line.split()
        if carried:
            chunks = chunks[1:]
        carried = ends_broken(line)
        if carried:
            chunks = chunks[:-1]
        for c in chunks:
            found.update(p for p in letters(c) if p.isalpha())
    return found


def _heading(line: str) -> bool:
    """Not running text: a line that begins with a clause number, or a numbered heading,
    no word of which but small ones is in lower case."""
    return _CLAUSE_LINE.match(line) is not None or _SECTION.match(line) is not None and not any(w.islower() and len(w) > 3 for w in line.split())


def line_defects(lexicon: Lexicon, lines: list[str], open_cases: list[tuple[int, str, str]] | None = None) -> Iterator[tuple[int, str]]:
    """``(line, 'hyphen' or 'misread')`` of a page's lines, as its decoding has them.

    ``open_cases`` takes ``(line, defect, word)`` of what hangs on words that are not in
    the lexicon: words broken over a line end, and unknown single words.
    """
    s = lexicon.stream(lines)
    read = set()
    for e in s.edits:
        read.update(range(e.first, e.last + 1))
        line, end = s.at[e.first][0], s.at[e.last][0]
        if end > line:
            if len(e.words) == 1:
                yield line, "hyphen"
        elif e.confused and len(e.words) == 1 and 2 * e.confused <= len(e.words[0]) + 1 and not _heading(lines[line]):
            yield line, "misread"
    if open_cases is None:
        return
    for i, w in enumerate(s.low):
        if i in read:
            continue
        if s.after[i] == "-\n":
            if i + 1 not in read:
                open_cases.append((s.at[i][0], "hyphen", w + s.low[i + 1]))
        elif (i == 0 or s.after[i - 1] != "-\n") and len(w) > 2 and w not in lexicon.pages and not CLAUSE.search(w) and _unknown(lexicon, w) and not _heading(lines[s.at[i][0]]):
            open_cases.append((s.at[i][0], "misread", w))


def misread_word(lexicon: Lexicon, word: str) -> bool:
    if word in lexicon.pages or word.isdigit() or len(word) < 2 or (len(word) < 3 and word.isalpha()):
        return False
    return any(ch.isalpha() for ch in word) and lexicon.corrected(word) is not None


def _edges_and_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "word", "n", "page_id", "doc_id", "page", "line_no", "side", "depth", "key", "adjacent", "value", "bare"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    for batch in batches:
        words: Counter = Counter()
        rows: list[tuple] = []
        n = 0
        for page_id, doc, page, text in zip(*[c.to_pylist() for c in batch.columns]):
            if not text:
                continue
            lines = text.split("\n")
            words.update(_whole_words(lines))
            n += 1
            if page_id is not None and doc is not None:
                rows.extend(_edge_rows(page_id, doc, page, lines))
        rows.extend(("word", w, k, *[None] * 10) for w, k in words.items())
        rows.append(("pages", None, n, *[None] * 10))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names=names)


#: How many lines deep the edges of a page are: headers and page numbers together.
EDGE_LINES = 6
EDGE = "kind string, word string, n long, page_id long, doc_id string, page int, line_no int, side string, depth int, key string, adjacent string, value long, bare boolean"


def header_key(line: str) -> str | None:
    """What recurs of a line that may be a running header, or None where it cannot be one."""
    rest = _PAGE_PART.sub("", line).strip()
    if not rest or CLAUSE.search(rest) or _SECTION.match(rest) or rest[-1] in ".;," or rest[:1].islower() or not re.search(r"[^\W\d_]", rest):
        return None
    return shape(re.sub(r"\s+", " ", rest.lower()))


def _edge_rows(page_id: int, doc: str, page: int | None, lines: list[str]) -> Iterable[tuple]:
    full = [i for i, line in enumerate(lines) if line.strip()]
    for side, order in (("top", full[: EDGE_LINES + 1]), ("bottom", full[::-1][: EDGE_LINES + 1])):
        for depth, i in enumerate(order[:EDGE_LINES]):
            line = lines[i]
            number = bool(PAGE_LINE.match(line))
            inner = [lines[j] for j in order[depth + 1 :] if not PAGE_LINE.match(lines[j])]
            digits = re.search(r"\d+", line)
            beside = blake2b(inner[0].encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() if inner else ""
            yield ("edge", None, None, page_id, doc, page, i, side, depth, None if number else header_key(line), beside, int(digits.group()) if number and digits else None, bool(_BARE.match(line)) if number else None)


def edge_marks(edges: DataFrame) -> DataFrame:
    """``page_id, line_no, defect``: running headers and page numbers.

    A header recurs on two pages of the document at least, beside different lines, so
    that the edge of a page stored twice is none. A page number is alone on its line at
    the page's edge; a bare number must run along with the page count on two pages, or
    be within three of it. Inside the edge line stands one only where all lines further
    out are headers or numbers, ``EDGE_LINES`` of them at most.
    """
    e = edges.where("kind = 'edge'")
    # a header recurs in one place: on either edge, or so many lines inside of one
    place = F.when(F.col("depth") > 1, F.concat("side", "depth")).otherwise("edge")
    e = e.withColumn("place", place)
    keys = e.where("key IS NOT NULL").groupBy("doc_id", "key", "place").agg(F.countDistinct("page_id").alias("on"), F.countDistinct("adjacent").alias("beside")).where("on >= 2 AND beside >= 2").select("doc_id", "key", "place", F.lit("header").alias("header"))
    runs = e.where("value IS NOT NULL AND bare").groupBy("doc_id", (F.col("value") - F.col("page")).alias("shift")).agg(F.countDistinct("page_id").alias("along")).where("along >= 2")
    seen = e.join(keys, ["doc_id", "key", "place"], "left").withColumn("shift", F.col("value") - F.col("page")).join(runs, ["doc_id", "shift"], "left")
    number = F.col("bare").isNotNull() & (~F.col("bare") | F.col("along").isNotNull() | F.coalesce(F.abs("shift") <= 3, F.lit(False)))
    kinds = seen.withColumn("defect", F.when(F.col("header").isNotNull(), "header").when(number, "page_number"))
    outer = F.count("defect").over(W.partitionBy("page_id", "doc_id", "page", "side").orderBy("depth").rowsBetween(W.unboundedPreceding, -1))
    return kinds.withColumn("outer", outer).where(F.col("defect").isNotNull() & (F.col("outer") >= F.col("depth"))).select("page_id", "line_no", "defect").distinct()


def lexicon_of(table: DataFrame, min_share: float = 0.001, least: int = 3) -> Lexicon:
    """The words of at least ``min_share`` of the pages, and of ``least`` pages, and what
    confusions cost.

    At most (mean number of different words of a page) / ``min_share`` of them. A
    confusion costs the less the more pages have words that it explains."""
    pages = table.where("kind = 'pages'").agg(F.sum("n")).first()[0] or 0
    words = table.where("kind = 'word'").groupBy("word").agg(F.sum("n").alias("n"))
    common = {r["word"]: r["n"] for r in words.where(F.col("n") >= max(least, min_share * pages)).collect()}
    rough = table.sparkSession.sparkContext.broadcast(Lexicon(common))
    used = words.mapInArrow(_confusions_used(rough), "read string, meant string, n long").groupBy("read", "meant").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in used)
    rough.destroy()
    return Lexicon(common, prices={(a, b): 6.0 for a, b in LOOKALIKES} | {(r["read"], r["meant"]): min(6.0, 1.5 + 0.5 * log(total / r["n"])) for r in used} if total else None)


def _confusions_used(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        for batch in batches:
            seen: Counter = Counter()
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if misread_word(lex, word):
                    for x in explained(word, lex.corrected(word)):
                        seen[x] += n
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in seen], pa.string()), pa.array([b for _, b in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["read", "meant", "n"])

    return run


def _text_defects(lexicon):
    """Defects, and with a ``word`` the open cases and their shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                if text and page_id is not None:
                    cases: list[tuple[int, str, str]] = []
                    rows.extend((page_id, i, what, None, None) for i, what in line_defects(lexicon.value, text.split("\n"), cases))
                    rows.extend((page_id, i, what, w, shape(w)) for i, what, w in cases)
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=["page_id", "line_no", "defect", "word", "shape"])

    return run


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shape(w) for w in batch.column(0).to_pylist()], pa.string())], names=["meant", "n", "shape"])


def _misread_as(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yes = [2 * (n or 99) <= len(meant) + 1 for n, meant in ((confusions(w, m), m) for w, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))]
        yield batch.filter(pa.array(yes, pa.bool_())).select(["word", "meant"])


def rare_cases(cases: DataFrame, table: DataFrame, ratio: float = 20.0) -> DataFrame:
    """``page_id, line_no, defect`` of the open cases that the words of all pages decide,
    however few pages hold the word.

    A broken word stands whole elsewhere, as it is or as what it was misread from. An
    unknown word is a misreading of a word of its shape if it holds a character that is
    no letter, or is on ``ratio`` times fewer pages.
    """
    words = table.where("kind = 'word'").groupBy("word").agg(F.sum("n").alias("n"))
    asked = cases.select("defect", "word", "shape").distinct()
    shaped = words.mapInArrow(_shapes, "meant string, n long, shape string")
    whole = asked.where("defect = 'hyphen'").join(words, "word", "left_semi").select("defect", "word")
    own = asked.join(words.select("word", F.col("n").alias("own")), "word", "left")
    alike = own.join(shaped, "shape").where(F.col("word") != F.col("meant")).where(~F.col("word").rlike(r"^\p{L}+$") | (F.col("n") >= ratio * F.coalesce("own", F.lit(1))))
    pairs = alike.select("word", "meant").distinct().mapInArrow(_misread_as, "word string, meant string")
    read = asked.join(pairs, "word", "left_semi").select("defect", "word")
    return cases.join(whole.unionByName(read).distinct(), ["defect", "word"], "left_semi").select("page_id", "line_no", "defect")


def _scan(pages: DataFrame, text: str) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col(text).cast("string").alias("text"))
    return stage_table(rows.mapInArrow(_edges_and_words, EDGE), "edges-and-words")


def page_defects(pages: DataFrame, *, text: str = "text_plain", min_share: float = 0.001) -> DataFrame:
    """``page_id, line_no, defect`` of every page; defects are hyphen, misread, header, page_number.

    ``pages`` has ``page_id, doc_id, page`` and the text. A page without an id, or with
    a null or empty text, has no defects; one without a ``doc_id`` has no headers and
    page numbers. Rows of one page id are one page; the result is distinct. Texts are
    read whole. An empty table has no defects.
    """
    table = _scan(pages, text)
    marks = edge_marks(table)
    lexicon = pages.sparkSession.sparkContext.broadcast(lexicon_of(table, min_share))
    inside = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(text).cast("string").alias("text")).mapInArrow(_text_defects(lexicon), "page_id long, line_no int, defect string, word string, shape string")
    inside = stage_table(inside, "line-defects")
    rare = rare_cases(inside.where("word IS NOT NULL"), table)
    inside = inside.where("word IS NULL").select("page_id", "line_no", "defect").unionByName(rare)
    misread = inside.join(marks.select("page_id", "line_no"), ["page_id", "line_no"], "left_anti")
    return misread.unionByName(marks).distinct()


_STARTS = re.compile(r"^\s*(?:⟦.⟧\s*)?(?:\(?\d{1,3}[.)]|\([a-zA-Z]{1,4}\)|[-•*]\s|[A-Z]\.\d+\s|\d{2,4}\.\d{3}|(?:Clause|Provision|FAR)\s+\d)")


def paragraph_breaks(lines: list[str]) -> list[bool]:
    """For each line but the first, whether a paragraph begins with it, by dynamic
    programming: a state for each line, going on or beginning, with costs for what its
    end, its length and the next line's start say."""
    if not lines:
        return []
    width = sorted(len(x) for x in lines)[int(0.9 * (len(lines) - 1))] or 1
    cost, back = {False: 9e9, True: 0.0}, []
    for before, line in zip(lines, lines[1:]):
        blank = not before.strip() or not line.strip()
        ends = before.rstrip()[-1:] in ".!?:;”\""
        short = len(before) + len(line.split(None, 1)[0] if line.strip() else "") + 1 < 0.85 * width
        opens = 0.0 if blank else 3.0 + (2.0 if not ends else 0.0) - (3.0 if short else 0.0) - (5.0 if _STARTS.match(line) or _STARTS.match(before) else 0.0) + (3.0 if line[:1].islower() else 0.0)
        goes = 8.0 if blank else 1.0 + (1.5 if short and ends else 0.0)
        step = {}
        for now, price in ((True, opens), (False, goes)):
            was = min((False, True), key=lambda s: cost[s] + (0.5 if s and now and not blank else 0.0))
            step[now] = (cost[was] + (0.5 if was and now and not blank else 0.0) + price, was)
        back.append({k: v[1] for k, v in step.items()})
        cost = {k: v[0] for k, v in step.items()}
    state = min(cost, key=cost.get)
    out = []
    for b in reversed(back):
        out.append(state)
        state = b[state]
    return out[::-1]


def repaired_page(lexicon: Lexicon, text: str, marked: set[int]) -> str:
    """The page as paragraphs: without headers and page numbers, lines joined, and every
    stretch as the page's decoding reads it."""
    lines = [x for i, x in enumerate(text.split("\n")) if i not in marked]
    starts = [True, *paragraph_breaks(lines)][: len(lines)]
    s = lexicon.stream(lines)
    chunks = [line.split() for line in lines]
    for e in reversed(s.edits):
        (line, k, i), (end, m, j) = s.at[e.first], s.at[e.last]
        words = list(e.words)
        read = "".join(s.raw[e.first : e.last + 1])
        words = [w.upper() for w in words] if read.isupper() and len(read) > 1 else [words[0].capitalize() if read[:1].isupper() else words[0], *words[1:]]
        head, tail = chunks[line][k], chunks[end][m]
        before = head[: _part(head, lexicon.chunk(head).parts, i)[0]]
        behind = tail[_part(tail, lexicon.chunk(tail).parts, j)[1] :]
        whole = before + " ".join(words) + behind
        if (line, k) == (end, m):
            chunks[line][k] = whole
            continue
        # what is left of the last chunk stands with the first; the chunks between are its pieces
        chunks[line][k:] = [whole, *(chunks[line][m + 1 :] if line == end else [])]
        if end > line:
            chunks[end][: m + 1] = []
            starts[end] = False
    paragraphs: list[str] = []
    for i, (row, begins) in enumerate(zip(chunks, starts)):
        if not row:
            continue
        joined = " ".join(row)
        if begins or not paragraphs or not lines[i - 1].strip():
            paragraphs.append(joined)
        elif ends_broken(paragraphs[-1]):
            paragraphs[-1] = HYPHENS.sub("-", paragraphs[-1][-1:]).join((paragraphs[-1][:-1], joined))
        else:
            paragraphs[-1] += " " + joined
    return "\n\n".join(paragraphs)


def _part(chunk: str, parts: tuple[str, ...], i: int) -> tuple[int, int]:
    """Where the i-th part between hyphens begins and ends in its chunk."""
    at = 0
    for k in range(i + 1):
        at = chunk.index(parts[k], at)
        if k < i:
            at += len(parts[k])
    return at, at + len(parts[i])


def _repair(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, plain, layout, marks = (c.to_pylist() for c in batch.columns)
            fixed = [[None if t is None else repaired_page(lexicon.value, t, set(m or ())) for t, m in zip(texts, marks)] for texts in (plain, layout)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.string()) for x in fixed]], names=["page_id", "text_plain", "text_layout"])

    return run


def repaired_pages(pages: DataFrame, *, min_share: float = 0.001) -> DataFrame:
    """``page_id, text_plain, text_layout`` of every page row, as continuous paragraphs.

    Null texts stay null, empty ones empty. A line of the layout has the number of the
    plain text's line, so headers and page numbers are taken out of both.
    """
    table = _scan(pages, "text_plain")
    marks = edge_marks(table).groupBy("page_id").agg(F.sort_array(F.collect_set("line_no")).alias("marks"))
    lexicon = pages.sparkSession.sparkContext.broadcast(lexicon_of(table, min_share))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "text_plain", "text_layout").join(marks, "page_id", "left")
    return rows.mapInArrow(_repair(lexicon), "page_id long, text_plain string, text_layout string")
