"""Text helpers as Column expressions.

Blank and strip tests name the white space they mean: SQL ``trim`` removes
spaces only, and report cells do carry no-break spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: what Unicode counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Rows of a symbol-grouped table that are headings, not lots.
CATEGORY_HEADINGS = ("total", "cash", "cash equivalent", "mutual fund")

# Fixed value: the only date spelling that keeps a first cell from being a symbol.
US_DATE = r"^\d{1,2}/\d{1,2}/\d{4}$"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def _starts_visibly(text: Column) -> Column:
    """First byte is a printable ASCII character: the cheap test for most cells."""
    return (text >= "!") & (text < "\x7f")


def strip_cell(text: Column) -> Column:
    """As :func:`strip`, for cells of rows: most have no white space at their ends, which is told before they are searched."""
    return F.when(_starts_visibly(text) & _starts_visibly(F.substring(text, -1, 1)), text).otherwise(strip(text))


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.when(_starts_visibly(text), False).otherwise(F.coalesce(strip(text) == "", F.lit(True)))


def blank_to_null(text: Column) -> Column:
    return F.when(_starts_visibly(text), text).when(strip(text) != "", text)


def is_missing(text: Column) -> Column:
    """True for null, blank and any spelling of ``nan``."""
    like_nan = F.lower(F.substring(text, 1, 1)) == "n"
    return F.when(text == "", True).when(_starts_visibly(text) & ~like_nan, False).otherwise(F.coalesce(F.lower(strip(text)).isin("", "nan"), F.lit(True)))


def nan_to_null(text: Column) -> Column:
    return F.when(~is_missing(text), text)


def normalise_header(text: Column) -> Column:
    """Lookup form of a header: stripped, lower case, separators as one space.

    Stripping comes before separators turn into spaces, so ``_x`` keeps a
    leading space; ``# $ ( ) *`` are significant and stay.
    """
    separated = F.regexp_replace(F.lower(strip(text)), r"[-_/]+", " ")
    return F.regexp_replace(separated, f"[{WHITE_SPACE}]+", " ")


def is_us_date(text: Column) -> Column:
    return F.when((text < "0") | (text >= ":"), False).otherwise(text.rlike(US_DATE))


def is_category_heading(text: Column) -> Column:
    begins = sorted({heading[:2] for heading in CATEGORY_HEADINGS})
    other = _starts_visibly(text) & ~F.lower(F.substring(text, 1, 2)).isin(*begins)
    return F.when(other, False).otherwise(F.lower(strip(text)).isin(*CATEGORY_HEADINGS))


def broker_from_path(path: Column) -> Column:
    """Text before the first ``_`` of the file name without its extension."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    broker = F.substring_index(stem, "_", 1)
    return F.when(broker != "", broker)
