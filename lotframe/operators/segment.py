"""Tables inside report grids: maximal runs of non-blank rows.

Grid columns: ``file``, ``sheet_no`` (0 for text files, from 1 for workbook
sheets), ``block`` (a bounded run of consecutive rows, increasing with
``row_no``), ``row_no`` and ``cells``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import is_blank, is_missing
from ..session import keep_methods_small
from .prefix import running_row_number, shuffled, states_before

BLOCK = ("file", "sheet_no", "block")
TABLE = ("file", "sheet_no", "table_row")

_UP_TO = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def blank_row() -> Column:
    """Every cell blank; in a workbook the text ``nan`` is blank too."""
    cells = F.col("cells")
    return F.when(F.col("sheet_no") > 0, F.forall(cells, is_missing)).otherwise(F.forall(cells, is_blank))


def opens_table() -> Column:
    """Non-blank row able to start a table: one-cell text rows are titles."""
    return ~F.col("is_blank") & ((F.col("sheet_no") > 0) | (F.size("cells") != 1))


def _known() -> Column:
    return F.col(BLOCK[0]).isNotNull() & F.col(BLOCK[1]).isNotNull() & F.col(BLOCK[2]).isNotNull()


def by_block(grid: DataFrame) -> DataFrame:
    """The one shuffle of the raw grid; every later step reuses it.

    A row without a key raises. The filter after that removes nothing: it states what inner
    joins would else infer on some branches only, which would keep the exchanges from being equal.
    """
    keys = [F.coalesce(name, F.raise_error(F.lit(f"a row of the grid has no {name}"))).alias(name) for name in BLOCK]
    keep_methods_small(grid.sparkSession)
    return grid.select(*keys, "row_no", "cells").where(_known()).repartition(*BLOCK)


def blocked_as_stored(grid: DataFrame) -> DataFrame:
    """As :func:`by_block` for a stored grid whose buckets hold whole blocks: nothing is moved.

    The filter removes nothing here either; it keeps a pass over the grid equal on all branches, so that it is made once.
    """
    if not grid.where(" or ".join(f"{name} is null" for name in BLOCK)).isEmpty():
        raise ValueError("a row of the grid has no file, sheet_no or block")
    keep_methods_small(grid.sparkSession)
    return grid.select(*BLOCK, "row_no", "cells").where(_known())


def flag_blank_rows(grid: DataFrame) -> DataFrame:
    return grid.withColumn("is_blank", blank_row())


def _mark_candidates(blocked: DataFrame, header: Column) -> DataFrame:
    """Block-local view: the last blank row and the last table start so far."""
    in_block = Window.partitionBy(*BLOCK).orderBy("row_no")
    up_to, before = in_block.rowsBetween(*_UP_TO), in_block.rowsBetween(*_BEFORE)
    row_no = F.col("row_no")
    after_blank = F.col("_opened") < F.coalesce(F.col("_blank"), F.lit(-1))
    return (
        flag_blank_rows(blocked)
        .withColumn("_opens", opens_table())
        .withColumns(
            {
                "_blank": F.max(F.when(F.col("is_blank"), row_no)).over(up_to),
                "_opened": F.max(F.when(F.col("_opens"), row_no)).over(before),
            }
        )
        .withColumn("_starts", F.col("_opens") & (F.col("_opened").isNull() | after_blank))
        .withColumns(
            {
                "_start": F.max(F.when(F.col("_starts"), row_no)).over(up_to),
                "_header": F.last(F.when(F.col("_starts"), header), ignorenulls=True).over(up_to),
            }
        )
    )


def _carry_open_table(marked: DataFrame) -> DataFrame:
    """Per block: the table still open when the block begins, if any."""
    summary = marked.groupBy(*BLOCK).agg(
        F.max("_blank").alias("_last_blank"),
        F.max("_start").alias("_last_start"),
        F.max_by("_header", "row_no").alias("_last_header"),
    )
    # A block with a blank row ends what was open before it; what its last start opened stays open.
    alive = F.col("_last_start") > F.coalesce(F.col("_last_blank"), F.lit(-1))
    opened = F.when(alive, F.struct(F.col("_last_start").alias("start"), F.col("_last_header").alias("header")))
    states = summary.select(*BLOCK, F.col("_last_blank").isNotNull().alias("_ends"), opened.alias("_open"))
    carried = states_before(states, ["file", "sheet_no"], "block", "_ends", ["_open"])
    return carried.select(
        *BLOCK, F.col("_open_before.start").alias("_open_start"), F.col("_open_before.header").alias("_open_header")
    )


def open_tables(blocked: DataFrame, header: Column) -> DataFrame:
    """One row per block: the table still open when it begins, if any. Takes a pass over the grid."""
    return _carry_open_table(_mark_candidates(blocked, header))


def resolve_rows(
    blocked: DataFrame,
    header: Column | None = None,
    by: Sequence[int | str] = BLOCK,
    opened: DataFrame | None = None,
) -> DataFrame:
    """All rows with ``table_row`` and ``header``, null outside tables. ``by``: what the rows are dealt out by, as ``repartition`` takes it.

    ``table_row`` is the row number of the header row and identifies the table
    within its sheet. ``header`` is any expression over a header row; it is
    evaluated on header rows only and repeated on the rows below. A table may
    span any number of blocks. ``opened``: :func:`open_tables`, if it is known.
    """
    header = F.col("cells") if header is None else header
    marked = _mark_candidates(blocked, header)
    carried_in = (_carry_open_table(marked) if opened is None else opened).repartition(*by)
    joined = marked.join(shuffled(carried_in), list(BLOCK), "left")
    leading = F.col("_blank").isNull()
    own = ~F.col("is_blank") & (leading | (F.col("_start") > F.col("_blank")))
    carried = ~F.col("is_blank") & leading & F.col("_open_start").isNotNull()
    table_row = F.when(carried, F.col("_open_start")).when(own, F.col("_start")).alias("table_row")
    of_table = F.when(carried, F.col("_open_header")).when(own, F.col("_header")).alias("header")
    return joined.select(*BLOCK, "row_no", "cells", table_row, of_table)


def resolve_tables(blocked: DataFrame, header: Column | None = None, by: Sequence[int | str] = BLOCK) -> DataFrame:
    """Rows that belong to a table; see :func:`resolve_rows`."""
    return resolve_rows(blocked, header, by).filter(F.col("table_row").isNotNull())


def is_data_row() -> Column:
    return F.col("row_no") > F.col("table_row")


def number_tables(rows: DataFrame) -> DataFrame:
    """Header rows with ``table_no``, counted from 1 per sheet."""
    headers = rows.filter(F.col("row_no") == F.col("table_row"))
    return running_row_number(headers, ["file", "sheet_no"], "block", ["row_no"], "table_no")


def table_headers(rows: DataFrame) -> DataFrame:
    """One row per table that has data rows: its number, header and row count."""
    sizes = rows.filter(is_data_row()).groupBy(*TABLE).agg(F.count("*").alias("n_rows"))
    return number_tables(rows).drop("block", "row_no", "cells").join(sizes, list(TABLE))


def align_cells(cells: Column, width: Column) -> Column:
    """Pad with empty text or cut to ``width``."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def align_rows(rows: DataFrame) -> DataFrame:
    """Data rows with cells as wide as their header (``header`` = header cells)."""
    return rows.filter(is_data_row()).withColumn("cells", align_cells(F.col("cells"), F.size("header")))


def table_samples(rows: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` data rows of each table.

    Each block keeps at most ``n`` of its rows before the rows of a table meet.
    """
    first_in_block = Window.partitionBy(*BLOCK, "table_row").orderBy("row_no")
    first_in_table = Window.partitionBy(*TABLE).orderBy("row_no")
    few = (
        rows.filter(is_data_row())
        .withColumn("_rank", F.row_number().over(first_in_block))
        .filter(F.col("_rank") <= n)
    )
    return (
        few.withColumn("sample_no", F.row_number().over(first_in_table))
        .filter(F.col("sample_no") <= n)
        .drop("_rank")
    )
