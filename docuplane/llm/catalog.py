"""Queries of this subpackage, by problem, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib
import importlib.util

_PARTS = ("label_queries", "page_queries", "corpus_queries")
QUERIES: dict = {}
SQL: dict = {}
for _name in _PARTS:
    if importlib.util.find_spec(f"docuplane.llm.{_name}"):
        _m = importlib.import_module(f"docuplane.llm.{_name}")
        QUERIES |= _m.QUERIES
        SQL |= _m.SQL
