"""From table rows to the canonical field list."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import broker_from_path
from .classify import cell_at

# Output fields where the caller names none, and the longer list
# that ships with the settings.
DEFAULT_FIELDS = [
    "Account", "Symbol", "Quantity", "Acquisition Date", "Cost per Unit", "Total Cost", "Value", "Type",
]
FULL_FIELDS = [
    "Broker", "Account", "Account#", "Symbol", "Quantity", "Acquisition Date", "Cost per Unit",
    "Total Cost", "Value", "Type", "Source",
]


def parse_fields(setting: str | Sequence[str] | None) -> list[str]:
    """Field list from a list, a JSON list or a comma-separated text."""
    if not setting:
        return list(DEFAULT_FIELDS)
    if isinstance(setting, str):
        text = setting.strip()
        items: object = None
        if text.startswith("[") and text.endswith("]"):
            try:
                items = json.loads(text)
            except ValueError:
                items = None
        setting = items if isinstance(items, list) else text.split(",")
    return [str(item).strip() for item in setting if str(item).strip()]


def fallback_values(fields: Sequence[str]) -> Column:
    """Per file, aligned with ``fields``: key-value, else account or broker.

    Reads ``file``, ``kv``, ``is_hybrid`` and ``account``. Only hybrid files
    take the account of their summary table.
    """

    def value(field: str) -> Column:
        found = F.try_element_at("kv", F.lit(field))
        if field == "Broker":
            return F.coalesce(found, broker_from_path(F.col("file")))
        if field == "Account":
            return F.coalesce(found, F.when(F.col("is_hybrid"), F.col("account")))
        return found

    return F.array(*[value(field) for field in fields])


def project_fields(lots: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Exactly ``fields``, by position; an absent column takes the file's value.

    Blank cells of a present column stay blank. Realigned rows show the carried
    symbol in place of their own symbol cell.
    """
    route = F.col("route")
    slotted = lots.select(
        "file",
        "sheet_no",
        "row_no",
        "cells",
        "fallback",
        F.col("header.positions").alias("positions"),
        F.when(route == "hybrid", 1).when(route == "group", F.col("header.symbol_at")).otherwise(0).alias("slot"),
        F.when(route == "hybrid", F.col("hybrid_current")).otherwise(F.col("group_current")).alias("symbol"),
    )

    def value(index: int) -> Column:
        position = F.get("positions", F.lit(index))
        shown = F.when(position == F.col("slot"), F.col("symbol")).otherwise(cell_at(position))
        return F.when(position > 0, shown).otherwise(F.get("fallback", F.lit(index)))

    columns = [value(index).alias(field) for index, field in enumerate(fields)]
    return slotted.select("file", "sheet_no", "row_no", *columns)


def fallback_rows(files: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row from key-values alone for each file without extracted lots."""
    columns = [F.get("fallback", F.lit(index)).alias(field) for index, field in enumerate(fields)]
    without = files.filter(~F.coalesce("has_lots", F.lit(False)))
    return without.select("file", F.lit(0).alias("sheet_no"), F.lit(0).cast("long").alias("row_no"), *columns)
