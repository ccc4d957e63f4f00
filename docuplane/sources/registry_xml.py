"""Sections of a regulation from its XML and its structure tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

SECTIONS = "number string, title string, reserved boolean, kind string, kind_source string, clause_date string, alternates array<struct<name:string,date:string>>, error string"
# Short month names.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_of(text: str) -> str | None:
    for name, year in re.findall(r"\b([A-Za-z]{3,9})\.?,?\s+((?:19|20)\d{2})\b", text):
        if name.lower()[:3] in _MONTHS:
            return f"{year}-{_MONTHS.index(name.lower()[:3]) + 1:02d}"
    return None


def _said(e: ET.Element) -> str:
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip()


def parse_section(xml: str) -> dict:
    """Title, whether reserved, kind (from the prescribing sentence and the end marker;
    unknown where they disagree), clause date and dated alternates of one section."""
    root = ET.fromstring(xml)
    head = _said(root.find("HEAD")) if root.find("HEAD") is not None else ""
    number = root.get("N") or (re.match(r"[\d.\-]+", head) or [""])[0]
    title = re.sub(rf"^{re.escape(number)}\s*", "", head).rstrip(".")
    texts = [_said(e) for e in root.iter() if e.tag in ("P", "HD1", "HD2", "HD3", "FP")]
    first = next((m[1].lower() for t in texts[:3] if (m := re.search(r"insert (?:the following|a) (clause|provision)", t, re.IGNORECASE))), None)
    last = next((m[1].lower() for t in reversed(texts) if (m := re.search(r"\(End of (clause|provision)\)", t, re.IGNORECASE))), None)
    kind = "unknown" if first and last and first != last else first or last or "unknown"
    source = "conflict" if first and last and first != last else "prescription" if first else "end_marker" if last else None
    heads = [_said(e) for e in root.iter() if e.tag in ("HD1", "HD2", "HD3")]
    named = [(m[1], month_of(t)) for t in texts if (m := re.match(r"(Alternate [IVXLC]+)\b", t))]
    date = next((d for t in heads if not t.startswith("Alternate") and (d := month_of(t))), None)
    if date is None:
        date = next((d for t in texts if re.match(r"[A-Z][A-Z ,\-]{5,}\(", t) and (d := month_of(t))), None)
    alternates = list({n: {"name": n, "date": d} for n, d in reversed(named)}.values())[::-1]
    return {"number": number, "title": title, "reserved": "[reserved]" in head.lower(), "kind": kind, "kind_source": source, "clause_date": date, "alternates": alternates, "error": None}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in ("number title reserved kind kind_source clause_date alternates error".split())]
    for pdf in batches:
        rows = []
        for xml in pdf["xml"]:
            try:
                rows.append(parse_section(xml))
            except Exception as e:
                rows.append(dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"[:200]})
        yield pd.DataFrame(rows, columns=names)


def read_sections(xml: DataFrame) -> DataFrame:
    """Parsed sections of a table with one section's XML in ``xml``; order within a section
    matters to the rules, which is why the row XML reader does not serve."""
    return xml.select("xml").mapInPandas(_parse, SECTIONS)


def parts_in_tree(tree: dict, suffix: str = "52") -> list[tuple[str, str]]:
    """(part, chapter) of every part whose number ends in ``suffix``, in the tree's order."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[dict, str]] = [(tree, "")]
    while stack:
        node, chapter = stack.pop()
        if node.get("type") == "chapter":
            chapter = str(node.get("identifier"))
        if node.get("type") == "part" and str(node.get("identifier", "")).endswith(suffix):
            out.append((str(node["identifier"]), chapter))
        stack.extend((child, chapter) for child in reversed(node.get("children") or []))
    return out
