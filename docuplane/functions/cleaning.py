"""Cleaning and checks of text: redaction, markings, markup, box markers, file kinds."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from docuplane.functions.patterns import any_phrase
from docuplane.operators.citations import stripped
from docuplane.operators.sections import LIST_ITEM

# Names of markings, and the wordings that are each of them.
MARKING_WORDINGS = {
    "CUI": ("CUI", "controlled unclassified information"),
    "FOUO": ("FOUO", "for official use only"),
    "proprietary": ("proprietary",),
    "source_selection": ("source selection information",),
    "distribution_statement": ("distribution statement b/c/d/e/f",),
    "export_control": ("export controlled", "export-controlled", "ITAR", "EAR99", "EAR 99", "international traffic in arms"),
}
MARKINGS = {name: rf"\b{any_phrase(*wordings)}\b" for name, wordings in MARKING_WORDINGS.items()}
EMAIL = r"[\w.%+-]+@(?:[\w-]+\.)+\p{Alpha}{2,}(?!\p{Alpha})"
#: A North American phone number with an extension or none. One that is just a section number (three or four digits, '.', three, '-', four) is none.
_EXTENSION = r"\s?(?:ext\.?|x)\s?\d{1,5}"
_SECTION_NUMBER = rf"\d{{3,4}}\.\d{{3}}-\d{{4}}(?![\w/-])(?!{_EXTENSION})"
PHONE = rf"(?U)(?<![\w./$-])(?!{_SECTION_NUMBER})(?:\+?1[\s.-]?)?(?:\(\d{{3}}\)\s?|\d{{3}}[\s.-])\d{{3}}[\s.-]\d{{4}}(?:{_EXTENSION})?(?![\w/-])"
# Boxes and ticks.
CHECKED, UNCHECKED, TICKS = "☒☑", "☐□◻❏❑", "✓✔✗✘"
_X, _BLANK, _LOST = "⟦X⟧", "⟦ ⟧", "⟦?⟧"


def redacted(text: Column) -> Column:
    """E-mail addresses and phone numbers replaced; section numbers kept."""
    mail = F.when(text.contains("@"), F.regexp_replace(text, EMAIL, "[EMAIL]")).otherwise(text)
    return F.when(mail.rlike(r"\d{3}[\s\u0085\p{Z}.\-]\d{4}"), F.regexp_replace(mail, PHONE, "[PHONE]")).otherwise(mail)


def mentions_marking(text: Column) -> Column:
    """Whether a text mentions any marking: the cheap test before they are named."""
    return text.rlike("(?i)" + "|".join(MARKINGS.values()))


def _named(tests: list[tuple[str, Column]]) -> Column:
    return F.array_sort(F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests]), lambda x: x.isNotNull()))


def markings(text: Column) -> Column:
    """Names of the markings a text mentions."""
    return _named([(n, text.rlike(f"(?i){p}")) for n, p in MARKINGS.items()])


def banner_markings(line: Column) -> Column:
    """Markings that a line shows as a banner: short, and at least 80 % of its letters
    capital; a distribution statement in any case."""
    s = stripped(line)
    capital = F.try_divide(F.regexp_count(s, F.lit(r"\p{Lu}")).cast("double"), F.regexp_count(s, F.lit(r"\p{L}")).cast("double")) >= 0.8
    short = F.length(s).between(3, 120)
    return _named([(n, short & s.rlike(f"(?i){p}") & (F.lit(n == "distribution_statement") | F.coalesce(capital, F.lit(False)))) for n, p in MARKINGS.items()])


def plain_html(markup: Column) -> Column:
    """Text of a page: tags off, the common entities read, blanks made single."""
    s = F.regexp_replace(markup, r"(?s)<[^>]+>", " ")
    for name in ("nbsp", "lt", "gt", "quot", "ndash", "mdash", "sect", "rsquo", "lsquo", "rdquo", "ldquo"):
        s = F.replace(s, F.lit(f"&{name};"), F.lit(html.entities.html5[f"{name};"]))
    for code, char in (("39", "'"), ("34", '"'), ("160", " "), ("167", "§"), ("8211", "–"), ("8212", "—")):
        s = F.replace(s, F.lit(f"&#{code};"), F.lit(char))
    return F.trim(F.regexp_replace(F.replace(s, F.lit("&amp;"), F.lit("&")), r"(?U)\s+", " "))


#: Whether a line can hold a box at all.
_MAYBE_BOX = rf"[{CHECKED}{UNCHECKED}{TICKS}■\x{{F06F}}-\x{{F072}}\x{{F0A8}}\x{{F0FC}}-\x{{F0FE}}]|^\s*(?:\[[\s_xX]|\[\]|\(\s|\([xX]|_[xX]_)"


def marked_line(line: Column) -> Column:
    """A text line with its boxes as markers: ballot boxes anywhere, ticks and a filled
    square before a number at the start, boxes typed as text at the start."""
    s = F.regexp_replace(line, rf"^(\s*)[{TICKS}]", f"$1{_X}")
    s = F.regexp_replace(s, r"^(\s*)■(?=\s*(?:\(\w{1,4}\)\s*)*(?:FAR\s+|DFARS\s+)?\d{2,4}\.\d{3})", f"$1{_X}")
    s = F.regexp_replace(s, r"^(\s*)(?:\[\s*[xX]\s*\]|\(\s*[xX]\s*\)|_[xX]_)(?=\s|$)", f"$1{_X}")
    s = F.regexp_replace(s, r"^(\s*)(?:\[\s*\]|\(\s{1,3}\)|\[_{1,3}\])(?=\s|$)", f"$1{_BLANK}")
    s = F.regexp_replace(F.regexp_replace(s, f"[{CHECKED}]", _X), f"[{UNCHECKED}]", _BLANK)
    # Private-use code points of box shapes; only two have a known state
    s = F.regexp_replace(F.regexp_replace(s, r"^(\s*)\x{F0FC}", f"$1{_X}"), r"\x{F072}", _BLANK)
    s = F.regexp_replace(s, r"[\x{F06F}\x{F070}\x{F071}\x{F0A8}\x{F0FC}\x{F0FD}\x{F0FE}]", _LOST)
    return F.when(line.rlike(_MAYBE_BOX), s).otherwise(line)


def text_layout(text: Column) -> Column:
    """The layout of a plain text file: lines that are not blank, with box markers."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{0085}\x{2028}\x{2029}]"), lambda x: x.rlike(r"[^\s\x1c-\x1f\u0085\p{Z}]"))
    return F.array_join(F.transform(lines, marked_line), "\n")


# Clauses that are lists to choose from, and families of such clauses.
_CHECKLISTS = r"52\.(?:212-5|213-4|222-\d+)|252\.(?:212-7001|2\d\d-70\d\d)"


def lost_boxes(page_text: Column, layout: Column) -> Column:
    """Layout in which list items of a page that names a checklist have an unknown box, if none is seen."""
    lines = F.transform(F.split(layout, "\n"), lambda x: F.when(~x.contains("⟦") & x.rlike(r"^\s*" + LIST_ITEM[1:]) & x.rlike(r"\)\s*(?:D?FARS?\s+)?2?52\."), F.concat(F.lit(f"{_LOST} "), x)).otherwise(x))
    return F.when(page_text.rlike(_CHECKLISTS), F.array_join(lines, "\n")).otherwise(layout)


def file_kind(content: Column) -> Column:
    """pdf, zip, doc or txt by the first bytes; null for none of them."""
    head = F.hex(F.substring(content, 1, 8))
    start = F.substring(content, 1, 2048)
    text = F.when(F.is_valid_utf8(start.cast("string")), start.cast("string")).otherwise(F.decode(start, "ISO-8859-1"))
    printable = F.try_divide(F.length(F.regexp_replace(text, r"[\p{C}&&[^\r\n\t]]", "")).cast("double"), F.length(text).cast("double")) > 0.95
    return F.when(head.startswith("255044462D"), "pdf").when(head.startswith("504B0304"), "zip").when(head == "D0CF11E0A1B11AE1", "doc").when((F.length(content) > 0) & ~text.contains("\x00") & printable, "txt")
