from .dates import lenient_date, whole_days, years_between, years_held
from .growth import cagr, cagr_from_text, initial_value
from .numbers import lenient_number, strict_number
from .text import (
    blank_to_null,
    broker_from_path,
    is_blank,
    is_category_heading,
    is_missing,
    is_us_date,
    nan_to_null,
    normalise_header,
    strip,
)

__all__ = [
    "blank_to_null",
    "broker_from_path",
    "cagr",
    "cagr_from_text",
    "initial_value",
    "is_blank",
    "is_category_heading",
    "is_missing",
    "is_us_date",
    "lenient_date",
    "lenient_number",
    "nan_to_null",
    "normalise_header",
    "strict_number",
    "strip",
    "whole_days",
    "years_between",
    "years_held",
]
