"""A table of mentions made of the order lines, so that the numeric operators run at the
size of the largest fact table. The same expressions make it in SQL and in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docuplane.session import read_table

_NUMBER = "concat('52.2', lpad(cast({p} % 50 AS varchar(8)), 2, '0'), '-', cast({s} AS varchar(8)))"
COLUMNS = {
    "doc_id": "l_orderkey",
    "number": _NUMBER.format(p="l_partkey", s="(CASE WHEN l_suppkey % 10 = 0 THEN 9000 + l_suppkey % 7 ELSE l_partkey % 40 + 1 END)"),
    "box_marker": "CASE l_returnflag WHEN 'R' THEN 'X' WHEN 'A' THEN ' ' END",
    "alternate": "CASE WHEN l_linenumber % 3 = 0 THEN 'Alternate I' END",
    "cited_date": "substring(cast(l_shipdate AS varchar(32)), 1, 7)",
    "b": "cast(l_partkey % 101 AS double) / 100",
    "e": "CASE WHEN l_suppkey % 23 = 0 THEN cast(0.5 AS double) ELSE cast(0 AS double) END",
    "source": "CASE WHEN l_partkey % 3 = 0 THEN 'model' WHEN l_partkey % 3 = 1 THEN 'box_rule' ELSE 'list_rule' END",
    "role": "CASE l_returnflag WHEN 'R' THEN 'SELECTED' WHEN 'A' THEN 'NOT_SELECTED' ELSE 'BY_REFERENCE' END",
    "y": "l_linestatus = 'F'",
    "line_text": "concat('line ', cast(l_linenumber AS varchar(8)), ' part ', cast(l_partkey AS varchar(12)))",
    "page": "l_linenumber",
    "ordinal": "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)",
}
SELECT = ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items())
#: The table as a common table expression.
MENTIONS = f"m AS (SELECT {SELECT} FROM lineitem)"
REGISTRY = f"r AS (SELECT DISTINCT {_NUMBER.format(p='p_partkey', s='(p_partkey % 40 + 1)')} AS number FROM part)"


def derived_mentions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").selectExpr(*[f"{sql} AS {name}" for name, sql in COLUMNS.items()])


def derived_registry(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").selectExpr(f"{_NUMBER.format(p='p_partkey', s='(p_partkey % 40 + 1)')} AS number").distinct()
