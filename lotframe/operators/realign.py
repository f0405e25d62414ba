"""Lots listed under a summary row get that row's symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .classify import is_account_source
from .headers import has_symbol_and_more
from .segment import BLOCK


def carry_symbols(roles: DataFrame) -> DataFrame:
    """Current symbol under both layouts.

    Runs along a block, whose rows are in this order already; a symbol counts for rows of its own table. The value
    at the segment's start comes in as ``hybrid_carry`` and ``group_carry``.
    """
    so_far = Window.partitionBy(*BLOCK).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)

    def current(symbol: str, carry: str) -> Column:
        named = F.when(F.col(symbol).isNotNull(), F.struct("table_row", symbol))
        latest = F.last(named, ignorenulls=True).over(so_far)
        own = F.when(latest["table_row"] == F.col("table_row"), latest[symbol])
        return F.coalesce(own, F.col(carry))

    return roles.withColumns(
        {
            "hybrid_current": current("hybrid_symbol", "hybrid_carry"),
            "group_current": current("group_symbol", "group_carry"),
        }
    )


def hybrid_lots() -> Column:
    """Lot rows where the first column is the symbol slot."""
    return F.col("is_data") & F.col("hybrid_symbol").isNull() & F.col("hybrid_current").isNotNull()


def group_lots() -> Column:
    """Lot rows of a symbol-grouped table; headings do not end a group."""
    return F.col("group_lot") & F.col("group_current").isNotNull()


def choose_route(fields: Sequence[str]) -> Column:
    """``plain``, ``hybrid`` or ``group`` for tables that give lots, else null.

    A standard file keeps a symbol-grouped table as it is if realigning it
    would leave nothing; a hybrid file has no such way back.
    """
    in_hybrid = F.when(F.col("header.is_holdings") & ~is_account_source(), F.when(F.col("is_group"), "group").otherwise("hybrid"))
    in_standard = F.when(
        has_symbol_and_more(F.col("header.positions"), fields),
        F.when(F.col("is_group") & F.col("has_group_lots"), "group").otherwise("plain"),
    )
    return F.when(F.col("is_hybrid"), in_hybrid).otherwise(in_standard)


def keep_lots(routed: DataFrame) -> DataFrame:
    """Rows that are lots under their table's ``route``."""
    route = F.col("route")
    return routed.filter(
        F.when(route == "plain", F.col("is_data")).when(route == "hybrid", hybrid_lots()).when(route == "group", group_lots())
    )
