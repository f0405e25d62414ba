"""Row roles, table kinds and file structure.

Row roles need the table's header facts; table and file decisions are minima
and maxima over row numbers, first per (block, table), so their input shrinks
to one summary row per block and table before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_category_heading, is_missing, is_us_date, strip_cell
from .headers import has_symbol_and_more
from .prefix import attach_totals, last_before
from .segment import BLOCK, TABLE, is_data_row

SEGMENT = (*BLOCK, "table_row")


def cell_at(position: Column) -> Column:
    """Cell at a 1-based position; short rows count as padded with blanks."""
    return F.when(position > 0, F.coalesce(F.get("cells", position - 1), F.lit("")))


def row_roles(rows: DataFrame) -> DataFrame:
    """Adds the row's role under both summary layouts.

    ``hybrid_symbol``: the first cell, if it names a symbol. ``group_symbol``:
    the symbol cell, if filled. ``group_member``: no symbol but an account.
    """
    first = strip_cell(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    symbol = cell_at(F.col("header.symbol_at"))
    account = cell_at(F.col("header.account_at"))
    grouped = (F.col("header.symbol_at") > 0) & (F.col("header.account_at") > 0)
    member = grouped & is_missing(symbol) & ~is_missing(account)
    return rows.withColumns(
        {
            "is_data": is_data_row(),
            "hybrid_symbol": F.when(is_data_row() & (first != "") & ~is_us_date(first), first),
            "group_symbol": F.when(is_data_row() & grouped & ~is_missing(symbol), strip_cell(symbol)),
            "group_member": is_data_row() & member,
            "group_lot": is_data_row() & member & ~is_category_heading(account),
        }
    )


def summarise_segments(roles: DataFrame) -> DataFrame:
    """One row per (block, table) with everything table decisions need."""
    row_no = F.col("row_no")
    account = strip_cell(cell_at(F.col("header.first_account_at")))
    hybrid_lot = F.col("is_data") & F.col("hybrid_symbol").isNull()

    def where(condition: Column) -> Column:
        return F.when(condition, row_no)

    return roles.groupBy(*SEGMENT).agg(
        F.first("header").alias("header"),
        F.min("row_no").alias("first_row"),
        F.max("row_no").alias("last_row"),
        F.count(where(F.col("is_data"))).alias("n_rows"),
        F.min(where(F.col("hybrid_symbol").isNotNull())).alias("first_hybrid"),
        F.max(where(hybrid_lot)).alias("last_hybrid_lot"),
        F.min(where(F.col("group_symbol").isNotNull())).alias("first_group"),
        F.max(where(F.col("group_member"))).alias("last_member"),
        F.max(where(F.col("group_lot"))).alias("last_group_lot"),
        F.max_by("hybrid_symbol", where(F.col("hybrid_symbol").isNotNull())).alias("hybrid_tail"),
        F.max_by("group_symbol", where(F.col("group_symbol").isNotNull())).alias("group_tail"),
        F.min_by(account, where(F.col("is_data") & (account != ""))).alias("account_value"),
    )


def decide_tables(segments: DataFrame) -> DataFrame:
    """Adds table-wide decisions and the symbol carried into each segment."""
    def yes(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    carried = last_before(segments, TABLE, "block", ["hybrid_tail", "group_tail"])
    carried = carried.withColumnsRenamed({"hybrid_tail_before": "hybrid_carry", "group_tail_before": "group_carry"})
    folds = {
        "table_rows": (F.sum, "n_rows"),
        "_first_group": (F.min, "first_group"),
        "_last_member": (F.max, "last_member"),
        "_last_group_lot": (F.max, "last_group_lot"),
        "_first_hybrid": (F.min, "first_hybrid"),
        "_last_hybrid_lot": (F.max, "last_hybrid_lot"),
    }
    # A table's facts meet its blocks by groups of them, however many blocks it has.
    present = F.col("table_row").isNotNull()
    told = attach_totals(carried, present, TABLE, "block", folds)

    def decided(condition: Column) -> Column:
        return F.when(present, yes(condition))

    return told.withColumns(
        {
            "is_group": decided(F.col("_first_group") < F.col("_last_member")),
            "has_group_lots": decided(F.col("_first_group") < F.col("_last_group_lot")),
            "has_hybrid_lots": decided(F.col("_first_hybrid") < F.col("_last_hybrid_lot")),
        }
    ).drop(*[name for name in folds if name.startswith("_")])


def _table_place() -> Column:
    return F.struct("sheet_no", "table_row")


def decide_files(decided: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Structure, account and extraction flags per file, in one aggregation.

    The account is the first value found in an account summary; summaries up to
    that table are not holdings, a later one can be.
    """
    place = _table_place()
    summary = F.col("header.is_summary")
    holdings = F.col("header.is_holdings")
    names_account = summary & F.col("account_value").isNotNull()
    usable = has_symbol_and_more(F.col("header.positions"), fields) & (F.col("table_rows") > 0)
    realigned = F.when(F.col("is_group"), F.col("has_group_lots")).otherwise(F.col("has_hybrid_lots"))
    files = decided.groupBy("file").agg(
        F.min(F.when(summary, place)).alias("_first_summary"),
        F.max(F.when(holdings & F.col("has_hybrid_lots"), place)).alias("_last_holdings"),
        F.min_by("account_value", F.when(names_account, F.struct("sheet_no", "table_row", "block"))).alias("account"),
        F.min(F.when(names_account, place)).alias("account_place"),
        F.bool_or(usable).alias("_standard"),
        F.bool_or(holdings & ~summary & realigned).alias("_plain_holdings"),
        F.max(F.when(holdings & summary & realigned, place)).alias("_late_holdings"),
    )
    hybrid = F.coalesce(F.col("_last_holdings") > F.col("_first_summary"), F.lit(False))
    late = F.coalesce(F.col("_late_holdings") > F.col("account_place"), F.lit(False))
    return files.select(
        "file",
        hybrid.alias("is_hybrid"),
        "account",
        "account_place",
        F.when(hybrid, F.col("_plain_holdings") | late).otherwise(F.col("_standard")).alias("has_lots"),
    )


def is_account_source() -> Column:
    """Summary table used up in the search for the file's account."""
    place = _table_place()
    return F.col("header.is_summary") & (F.col("account_place").isNull() | (place <= F.col("account_place")))


def table_kinds(decided: DataFrame) -> DataFrame:
    """One row per table: its predicates and sizes."""
    return decided.groupBy(*TABLE).agg(
        F.first("header.is_summary").alias("is_summary"),
        F.first("header.is_holdings").alias("is_holdings"),
        F.first("header.positions").alias("positions"),
        F.first("header.mapped").alias("mapped"),
        F.first("table_rows").alias("n_rows"),
        F.first("is_group").alias("is_group"),
        F.first("has_group_lots").alias("has_group_lots"),
        F.first("has_hybrid_lots").alias("has_hybrid_lots"),
    )
