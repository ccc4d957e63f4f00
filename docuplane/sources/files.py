"""Documents as pages: plain text natively, word-processor files by their own XML, other kinds as error rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuplane.functions.cleaning import file_kind, text_layout
from docuplane.session import ship_package

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
PAGES = "path string, doc_id string, page int, text_plain string, text_layout string, error string"
_MARKS = {True: "⟦X⟧", False: "⟦ ⟧"}
# Symbol characters of checked and empty boxes.
_SYMBOLS = {"F0FE": "⟦X⟧", "F0FD": "⟦X⟧", "F0A8": "⟦ ⟧", "F06F": "⟦ ⟧", "F0A3": "⟦ ⟧"}


def _on(element: ET.Element | None, name: str) -> bool:
    value = None if element is None else element.get(name)
    return element is not None and value not in ("0", "false")


def _paragraph(p: ET.Element) -> tuple[str, str]:
    """Plain and marked text of a paragraph, boxes in the place where they stand."""
    plain, marked = [], []
    for node in p.iter():
        if node.tag == f"{_W}t":
            plain.append(node.text or "")
            marked.append(re.sub("[☒☑]", "⟦X⟧", re.sub("[☐□]", "⟦ ⟧", node.text or "")))
        elif node.tag in (f"{_W}tab", f"{_W}br"):
            plain.append(" ")
            marked.append(" ")
        elif node.tag == f"{_W}sym":
            marked.append(_SYMBOLS.get((node.get(f"{_W}char") or "").upper(), ""))
        elif node.tag == f"{_W14}checkbox":
            marked.append(_MARKS[_on(node.find(f"{_W14}checked"), f"{_W14}val")])
        elif node.tag == f"{_W}checkBox":
            state = node.find(f"{_W}checked")
            marked.append(_MARKS[_on(state if state is not None else node.find(f"{_W}default"), f"{_W}val")])
    layout = re.sub(r"(⟦[X ]⟧)\s*⟦[X ]⟧", r"\1", "".join(marked))
    return "".join(plain), layout


def docx_texts(content: bytes) -> tuple[str, str]:
    """Plain and layout text of a word-processor file: paragraphs and table rows in order;
    a cell that is only a box is put before the next cell's text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    plain, layout = [], []
    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            pairs = [_paragraph(block)]
        elif block.tag == f"{_W}tbl":
            pairs = []
            for row in block.iter(f"{_W}tr"):
                cells = [[_paragraph(p) for p in cell.iter(f"{_W}p")] for cell in row.iter(f"{_W}tc")]
                pairs.append((" ".join(a for c in cells for a, _ in c).strip(), " ".join(b.strip() for c in cells for _, b in c if b.strip())))
        else:
            pairs = [_paragraph(p) for p in block.iter(f"{_W}p")]
        for a, b in pairs:
            if a.strip() or b.strip():
                plain.append(a)
                layout.append(b)
    return "\n".join(plain), "\n".join(layout)


def _docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, doc, content in zip(pdf["path"], pdf["doc_id"], pdf["content"]):
            try:
                rows.append((path, doc, 1, *docx_texts(content), None))
            except Exception as e:
                rows.append((path, doc, None, None, None, f"{type(e).__name__}: {e}"[:200]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all files under ``path``: ``path, doc_id, page, text_plain, text_layout, error``.

    ``doc_id`` is the first 16 digits of the content's SHA-256; a file stored twice
    gives its page twice, under one id. A file of an unknown kind, or one that
    cannot be read, gives a row with an error and no text; an empty file gives none."""
    ship_package(spark)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    f = raw.select("path", "content", F.substring(F.sha2("content", 256), 1, 16).alias("doc_id"), file_kind(F.col("content")).alias("kind"))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    txt = f.where("kind = 'txt'").select("path", "doc_id", F.lit(1).alias("page"), text.alias("text_plain"), text_layout(text).alias("text_layout"), F.lit(None).cast("string").alias("error"))
    docx = f.where("kind = 'zip'").select("path", "doc_id", "content").mapInPandas(_docx, PAGES)
    none = F.lit(None)
    rest = f.where("kind IS NULL OR kind NOT IN ('txt', 'zip')").select("path", "doc_id", none.cast("int").alias("page"), none.cast("string").alias("text_plain"), none.cast("string").alias("text_layout"), F.concat(F.lit("no reader for "), F.coalesce("kind", F.lit("this kind"))).alias("error"))
    return txt.unionByName(docx).unionByName(rest)
