"""Tables of unknown headers as one: rows by column name, a schema found by an aggregate.

A row carries its cells as a map from column name to text, so tables with any
headers share one plan. A header that a table repeats is told apart by its number
(``Value``, ``Value#2``), and the n-th of one table is that of every other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .segment import align_cells, is_data_row

#: Columns that :func:`widened` makes of names at most; rows stay usable as maps beyond that.
MOST_COLUMNS = 10_000
#: Between a repeated header and its number, so that no header can be taken for a numbered one.
NUMBER = "\x1f"


def column_names(cells: Column) -> Column:
    """Keys of a header row's columns; worked out once per table (``header`` of ``resolve_tables``)."""
    known = F.transform(cells, lambda name: F.coalesce(name, F.lit("")))

    def numbered(name: Column, place: Column) -> Column:
        nth = F.size(F.filter(F.slice(known, F.lit(1), place + 1), lambda other: other == name))
        return F.when(nth > 1, F.concat(name, F.lit(NUMBER), nth.cast("string"))).otherwise(name)

    return F.transform(known, numbered)


def rows_by_name(rows: DataFrame) -> DataFrame:
    """``file``, ``sheet_no``, ``row_no`` and ``cells_by_name`` of the data rows; ``rows``: tables whose header is names.

    A row is padded with empty text or cut to its header's width.
    """
    data = rows.filter(is_data_row())
    cells = align_cells(F.col("cells"), F.size("header"))
    return data.select("file", "sheet_no", "row_no", F.map_from_arrays("header", cells).alias("cells_by_name"))


def folded_columns(rows: DataFrame) -> DataFrame:
    """``name`` of every column of the tables and its first place; a row per name, folded before it is shuffled."""
    heads = rows.filter(F.col("row_no") == F.col("table_row"))
    named = heads.select("file", "sheet_no", "table_row", F.posexplode("header").alias("pos", "name"))
    place = F.struct("file", "sheet_no", "table_row", "pos")
    return named.groupBy("name").agg(F.min(place).alias("first_place"))


def column_list(columns: DataFrame, most: int = MOST_COLUMNS) -> list[str]:
    """Names in the order of their first places; raises if there are more than ``most``."""
    found = columns.orderBy("first_place").limit(most + 1).select("name").collect()
    if len(found) > most:
        raise ValueError(f"over {most} columns; read cells_by_name instead")
    return [row["name"] for row in found]


def widened(named_rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """A struct ``row`` with a field per name, null where a row's table lacks it; repeated headers are ``name#2``."""
    fields: dict[str, Column] = {}
    for name in names:
        shown = name.replace(NUMBER, "#")
        while shown in fields:
            shown += "#"
        fields[shown] = F.try_element_at("cells_by_name", F.lit(name)).alias(shown)
    return named_rows.select("file", "sheet_no", "row_no", F.struct(*fields.values()).alias("row"))
