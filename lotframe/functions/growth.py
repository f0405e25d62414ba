"""Growth rates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import lenient_number


def cagr(initial: Column, final: Column, years: Column) -> Column:
    """(final / initial) ** (1 / years) - 1, null unless all three are > 0."""
    rate = F.pow(F.try_divide(final, initial), F.try_divide(F.lit(1.0), years)) - 1
    valid = (initial > 0) & (final > 0) & (years > 0)
    finite = ~F.isnan(rate) & (rate < F.lit(float("inf")))
    return F.when(valid & finite, rate)


def cagr_from_text(initial: Column, final: Column, years: Column) -> Column:
    """:func:`cagr` over numeric-like text (``1,000.50``)."""
    return cagr(lenient_number(initial), lenient_number(final), lenient_number(years))


def initial_value(total_cost: Column, quantity: Column, cost_per_unit: Column) -> Column:
    """Total cost where known, else quantity times unit cost (all doubles)."""
    return F.coalesce(total_cost, quantity * cost_per_unit)
