"""Synonyms: vendor header spelling to canonical field."""

from __future__ import annotations

import json
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import normalise_header

log = logging.getLogger(__name__)

# The synonyms shipped by default. Order matters, a spelling
# listed twice belongs to the later field.
DEFAULT_SYNONYMS = {
    "Account": ["account", "acct", "portfolio", "Account Registration", "Description"],
    "Account#": ["account number", "acct", "acct no", "acc no", "Account #"],
    "Symbol": ["symbol", "ticker", "symbol cusip", "stock", "security", "cusip"],
    "Quantity": ["quantity", "qty", "shares", "units", "Qty #"],
    "Acquisition Date": [
        "acquisition date", "purchase date", "date acquired", "acquisition",
        "Date Acquired", "Initial Purchase Date",
    ],
    "Cost per Unit": [
        "cost per unit", "unit cost", "price", "price per share", "cost basis", "cost",
        "Unit Cost ($)", "Price Paid $", "Unit Principal Cost*",
    ],
    "Total Cost": [
        "total cost", "cost basis total", "total amount", "amount", "Cost Basis ($)",
        "Total Cost", "Principal ($)*",
    ],
    "Value": ["value", "market value", "current value", "fair market value", "value $", "Value ($)"],
    "Type": ["type", "investment type", "asset type", "security type", "Fund Category", "Asset Type"],
}


def mapping_entries(spec: dict) -> list[tuple[str, str]]:
    """(variant, canonical) in file order, from either JSON shape or a mix."""
    entries = []
    for key, value in spec.items():
        if isinstance(value, list):
            entries += [(variant, key) for variant in value]
        else:
            entries.append((key, value))
    return entries


def load_mapping(spark: SparkSession, path: str) -> dict:
    """The specification in a JSON file, read by Spark; empty if it is missing or unreadable."""
    try:
        spec = json.loads("\n".join(row[0] for row in spark.read.text(path, wholetext=True).collect()))
        mapping_entries(spec)
        return spec
    except (AnalysisException, ValueError, AttributeError) as error:
        log.warning("no usable column mapping at %s: %s", path, error)
        return {}


def resolve_variants(entries: DataFrame) -> DataFrame:
    """``mapping(variant, canonical)`` from ``entries(ord, raw, canonical)``, last entry wins."""
    return entries.groupBy(normalise_header(F.col("raw")).alias("variant")).agg(
        F.max_by("canonical", "ord").alias("canonical")
    )


def mapping_frame(spark: SparkSession, spec: dict) -> DataFrame:
    """The mapping of a specification as a frame; some dozens of rows."""
    rows = [(number, raw, canonical) for number, (raw, canonical) in enumerate(mapping_entries(spec))]
    return resolve_variants(spark.createDataFrame(rows, "ord int, raw string, canonical string"))


def resolve_mapping(spark: SparkSession, spec: dict) -> dict[str, str]:
    """Normalised variant to canonical name, the last entry wins; a configuration's few entries."""
    return {row.variant: row.canonical for row in mapping_frame(spark, spec).collect()}


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Canonical name of a normalised key, null if unknown.

    The mapping is a configuration file of some dozens of entries, so it
    travels inside the expression as one constant map.
    """
    if not mapping:
        return F.lit(None).cast("string")
    constant = F.from_json(F.lit(json.dumps(mapping)), "map<string,string>")
    return F.try_element_at(constant, key)
