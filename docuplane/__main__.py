"""Command line: list and run queries, read documents, build the mention and ledger tables."""

from __future__ import annotations

import argparse
import importlib
import sys
from pathlib import Path

from pyspark.sql import functions as F

from docuplane.operators import citations, sections
from docuplane.operators.registry import section_status
from docuplane.plans import document_queries
from docuplane.session import local_session, read_table
from docuplane.sources.files import read_documents


CORE = ("docuplane.plans.registry_queries", "docuplane.plans.ledger_queries", "docuplane.plans.document_queries", "docuplane.plans.feature_queries")


def _queries(modules: list[str]) -> dict:
    return {k: q for n in (*CORE, *modules) for k, q in importlib.import_module(n).QUERIES.items()}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docuplane", description=__doc__)
    p.add_argument("--queries", action="append", default=[], metavar="MODULE", help="a further module with QUERIES")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    run = sub.add_parser("query", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    for name, text in (("extract", "pages of all documents under a path"), ("mentions", "citations of a pages table"), ("sections", "section labels of a pages table"), ("status", "section status of registry snapshots")):
        s = sub.add_parser(name, help=text)
        s.add_argument("source")
    for s in sub.choices.values():
        s.add_argument("--out", help="write Parquet here instead of printing rows")
        s.add_argument("--rows", type=int, default=20, help="rows to print")
        s.add_argument("--cpus", default="*")
    a = p.parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(_queries(a.queries))))
        return 0
    if a.command == "query" and a.name not in _queries(a.queries):
        print(f"no query {a.name}", file=sys.stderr)
        return 2
    spark = local_session(a.cpus)
    if a.command == "query":
        df = _queries(a.queries)[a.name](spark, a.tables)
    elif a.command == "extract":
        df = read_documents(spark, a.source)
    elif a.command == "status":
        df = section_status(document_queries.snapshots(spark, a.source))
    else:
        folder, table = str(Path(a.source).parent), Path(a.source).stem
        pages = read_table(spark, folder, table)
        df = citations.mentions(pages) if a.command == "mentions" else sections.section_labels(pages)
    if a.out:
        df.write.mode("errorifexists").parquet(a.out)
        print(a.out)
    else:
        df.select(*[F.col(f"`{c}`") for c in df.columns]).show(a.rows, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
