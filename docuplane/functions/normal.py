"""Normal forms of section numbers, months, titles and labels, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that stand for a hyphen.
HYPHENS = "‐‑‒–—―−﹘﹣－"
# Month names and their usual short forms.
MONTHS = (
    ("jan", "january"),
    ("feb", "february"),
    ("mar", "march"),
    ("apr", "april"),
    ("may", "may"),
    ("jun", "june"),
    ("jul", "july"),
    ("aug", "august"),
    ("sep", "september"),
    ("oct", "october"),
    ("nov", "november"),
    ("dec", "december"),
)
#: Blanks of any kind, and characters that are not seen.
UNSEEN = r"[\s\u0085\p{Z}\p{Cf}\p{Cc}]"


def plain_hyphens(c: Column) -> Column:
    return F.translate(c, HYPHENS, "-" * len(HYPHENS))


def number_key(c: Column) -> Column:
    """A section number with ASCII hyphens and without blanks or invisible characters."""
    return F.regexp_replace(plain_hyphens(c.cast("string")), UNSEEN, "")


def _month_numbers() -> Column:
    pairs: list[Column] = []
    for i, (short, full) in enumerate(MONTHS, 1):
        for name in dict.fromkeys((short, full)):
            pairs += [F.lit(name), F.lit(i)]
    pairs += [F.lit("sept"), F.lit(9)]
    return F.create_map(*pairs)


def month_key(c: Column) -> Column:
    """The month a date names, as ``YYYY-MM``; null where it names no real month.

    Takes ISO months and days, month/year, month/day/year and month names, long or
    short, with or without a day, in any case and with stray blanks or full stops.
    """
    s = F.lower(F.trim(F.regexp_replace(plain_hyphens(c.cast("string")), rf"(?:{UNSEEN})+", " ")))
    iso = F.regexp_extract(s, r"^[(\[]?(\d{4})[-/.](\d{1,2})(?:[-/.]\d{1,2})?(?:[t ]\d.*)?[)\].]?$", 1)
    iso_m = F.regexp_extract(s, r"^[(\[]?(\d{4})[-/.](\d{1,2})(?:[-/.]\d{1,2})?(?:[t ]\d.*)?[)\].]?$", 2)
    packed = F.regexp_extract(s, r"^(\d{4})(\d{2})(?:\d{2})?$", 1)
    packed_m = F.regexp_extract(s, r"^(\d{4})(\d{2})(?:\d{2})?$", 2)
    us = r"^[(\[]?(\d{1,2})(?:[-/.]\d{1,2})?[-/.](\d{4})[)\].]?$"
    named = F.regexp_extract(s, r"(?:^|[^a-z])([a-z]{3,9})(?:[^a-z]|$)", 1)
    year = F.regexp_extract(s, r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)", 1)
    y = F.when(iso != "", iso).when(packed != "", packed).when(F.regexp_extract(s, us, 2) != "", F.regexp_extract(s, us, 2)).otherwise(year)
    m = (
        F.when(iso != "", iso_m.try_cast("int"))
        .when(packed != "", packed_m.try_cast("int"))
        .when(F.regexp_extract(s, us, 2) != "", F.regexp_extract(s, us, 1).try_cast("int"))
        .otherwise(F.try_element_at(_month_numbers(), named))
    )
    return F.when((F.length(y) == 4) & m.between(1, 12), F.concat(y, F.lit("-"), F.lpad(m.cast("string"), 2, "0")))


def named_month(c: Column) -> Column:
    """``YYYY-MM`` of a month name and a year, such as 'Oct. 2022'; null for no real month."""
    month = F.try_element_at(_month_numbers(), F.lower(F.regexp_extract(c, "([A-Za-z]{3,9})", 1)))
    return F.concat(F.regexp_extract(c, r"((?:19|20)\d{2})\s*$", 1), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def loose_text(c: Column) -> Column:
    """Text without what does not count in a comparison: case, blanks, the kind of
    hyphen and closing full stops. Null and empty are both the empty string."""
    bare = F.lower(F.regexp_replace(plain_hyphens(c.cast("string")), UNSEEN, ""))
    return F.coalesce(F.regexp_replace(bare, r"\.+$", ""), F.lit(""))


def label_name(c: Column) -> Column:
    """A name in lower case with single underscores for blanks, hyphens and underscores;
    null where nothing is left."""
    s = F.lower(F.regexp_replace(plain_hyphens(c.cast("string")), rf"(?:{UNSEEN}|[_-])+", "_"))
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s != "", s)
