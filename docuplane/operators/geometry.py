"""Boxes on a page: drawn squares and form fields, and the text lines they belong to.

Drawings arrive as rows with a box (x0, y0, x1, y1); joins are by page, with the
distances as residue, and the nearest line is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_spans(text: Column) -> Column:
    """``start, end`` of each line of a text, in code points."""
    lines = F.split(text, "\n")
    step = F.aggregate(
        lines,
        F.expr("cast(named_struct('at', 0, 'done', array()) AS struct<at: int, done: array<struct<start: int, end: int>>>)"),
        lambda s, x: F.struct((s["at"] + F.length(x) + 1).alias("at"), F.concat(s["done"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(x)).alias("end")))).alias("done")),
    )
    return step["done"]


def square_state(width: Column, height: Column, filled: Column, diagonal: Column, curve: Column, empty: Column) -> Column:
    """'X' or ' ' of a drawn square of 5 to 14 points whose sides are nearly equal; null for other drawings."""
    square = width.between(5, 14) & height.between(5, 14) & (F.abs(width - height) <= 2)
    return F.when(square & (filled | diagonal | curve), "X").when(square & empty, " ")


def field_state(value: Column) -> Column:
    """'X' of a form field that is on; off and empty ones are ' '."""
    return F.when(F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("", "off", "no", "false", "0"), " ").otherwise("X")


def fields_to_lines(fields: DataFrame, lines: DataFrame, left: float = -4.0, right: float = 80.0) -> DataFrame:
    """``page_id, field, line_no``: for each field the line that begins nearest to its right on
    the same baseline; a field without one is left out.

    ``fields``: ``page_id, field, x1, y0, y1``; ``lines``: ``page_id, line_no, lx0, ly0, ly1``."""
    middle = (F.col("y0") + F.col("y1")) / 2
    met = fields.join(lines, "page_id").where(middle.between(F.col("ly0"), F.col("ly1")) & (F.col("lx0") - F.col("x1")).between(left, right))
    return met.groupBy("page_id", "field").agg(F.min_by("line_no", F.struct((F.col("lx0") - F.col("x1")).alias("gap"), "line_no")).alias("line_no"))


def squares_to_lines(squares: DataFrame, lines: DataFrame, above: float = -2.0, below: float = 14.0) -> DataFrame:
    """``page_id, square, line_no``: for each square the first line whose top is within the given
    distances of the square's top.

    ``squares``: ``page_id, square, y0``; ``lines``: ``page_id, line_no, ly0``."""
    met = squares.join(lines, "page_id").where((F.col("ly0") - F.col("y0")).between(above, below))
    return met.groupBy("page_id", "square").agg(F.min("line_no").alias("line_no"))
