"""Header synonyms and per-table column positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalise_header, strip
from ..sources.mapping import lookup

# Header wording that marks account summaries and holdings.
SUMMARY_TERMS = ("net account value", "total gain", "available", "cash")
DATE_TERMS = ("date acquired", "purchase date", "initial purchase date")
QUANTITY_TERMS = ("qty", "quantity")


def canonical_names(cells: Column, mapping: dict[str, str]) -> Column:
    """Canonical field per header cell; unknown headers keep their spelling."""
    return F.transform(cells, lambda cell: F.coalesce(lookup(mapping, normalise_header(cell)), cell))


def first_position(names: Column, field: str) -> Column:
    """1-based, 0 if absent."""
    return F.array_position(names, field).cast("int")


def last_position(names: Column, field: str) -> Column:
    from_end = F.array_position(F.reverse(names), field).cast("int")
    return F.when(from_end > 0, F.size(names) - from_end + 1).otherwise(0)


def _mentions(cells: Column, terms: Sequence[str]) -> Column:
    return F.exists(cells, lambda cell: F.lower(cell).rlike("|".join(terms)))


def _says(cells: Column, word: str) -> Column:
    return F.exists(cells, lambda cell: F.lower(strip(cell)) == word)


def is_account_summary(cells: Column) -> Column:
    """By literal wording; synonyms are not consulted here."""
    return _says(cells, "account") & _mentions(cells, SUMMARY_TERMS)


def is_holdings(cells: Column) -> Column:
    return _mentions(cells, DATE_TERMS) & _mentions(cells, QUANTITY_TERMS) & _says(cells, "symbol")


def header_facts(mapping: dict[str, str], fields: Sequence[str]) -> Column:
    """What later steps need to know of a header, over its ``cells``.

    ``positions`` is aligned with ``fields``. The symbol-group rules take the
    last column of a name, everything else the first.
    """
    cells = F.col("cells")
    wanted = F.split(F.lit("\n".join(fields)), "\n")

    def known(cell: Column) -> Column:
        return lookup(mapping, normalise_header(cell)).isNotNull()

    def facts(names: Column) -> Column:
        return F.struct(
            is_account_summary(cells).alias("is_summary"),
            is_holdings(cells).alias("is_holdings"),
            last_position(names, "Symbol").alias("symbol_at"),
            last_position(names, "Account").alias("account_at"),
            first_position(names, "Account").alias("first_account_at"),
            F.transform(wanted, lambda field: F.array_position(names, field).cast("int")).alias("positions"),
            F.size(F.filter(cells, known)).alias("mapped"),
        )

    # A one-element array binds the names once, however often they are used.
    return F.get(F.transform(F.array(canonical_names(cells, mapping)), facts), F.lit(0))


def map_headers(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Header cells as rows joined with ``mapping(variant, canonical)``.

    The mapping is a configuration-sized frame, so broadcasting it is safe.
    """
    cells = headers.select("*", F.posexplode("header").alias("pos", "raw_name"))
    keyed = cells.withColumn("variant", normalise_header(F.col("raw_name")))
    joined = keyed.join(F.broadcast(mapping), "variant", "left")
    return joined.withColumn("name", F.coalesce("canonical", "raw_name")).drop("canonical", "variant")


def position_maps(mapped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per table: field to first position and field to last position, from 0."""
    spans = mapped.groupBy(*keys, "name").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return spans.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("name", "first"))).alias("first_pos"),
        F.map_from_entries(F.collect_list(F.struct("name", "last"))).alias("last_pos"),
    )


def has_symbol_and_more(positions: Column, fields: Sequence[str]) -> Column:
    """A usable table shows ``Symbol`` and at least one other output field."""
    if "Symbol" not in fields:
        return F.lit(False)
    present = F.size(F.filter(positions, lambda p: p > 0))
    return (F.get(positions, F.lit(list(fields).index("Symbol"))) > 0) & (present >= 2)
