"""String to number coercion that never raises, also under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# A bare cast would also accept Java suffixes such as ``5d``.
_NUMERIC = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\z"


def strict_number(text: Column) -> Column:
    """Double, or null for anything that is not a plain number.

    Most cells have nothing around their number, so white space is cut only where the cell as it is is none.
    """
    text = text.cast("string")
    bare = strip(text)
    return F.when(text.rlike(_NUMERIC), text.try_cast("double")).when(bare.rlike(_NUMERIC), bare.try_cast("double"))


def lenient_number(text: Column) -> Column:
    """As :func:`strict_number`, after removing thousands separators."""
    return strict_number(F.replace(text.cast("string"), F.lit(","), F.lit("")))
