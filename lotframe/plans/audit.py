"""What an ingest did, in counts per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators import canonical, clean, classify
from ..operators.prefix import shuffled
from .ingest import Parsed, parse_reports


def audit_of(parsed: Parsed, fields: Sequence[str]) -> DataFrame:
    """Tables, renamed columns, rows in and out, removed rows, key-values per file."""
    tables = (
        classify.table_kinds(parsed.tables)
        .groupBy("file")
        .agg(
            F.count("*").alias("tables"),
            F.count(F.when(F.col("n_rows") == 0, 1)).alias("empty_tables"),
            F.sum("n_rows").alias("table_rows"),
            F.sum("mapped").cast("long").alias("renamed_columns"),
        )
    )
    # One pass over the lots: equal rows collapse first, empty ones keep a flag.
    extracted = parsed.lots.withColumn("from_table", F.lit(True)).unionByName(
        parsed.fallback.withColumn("from_table", F.lit(False))
    )
    empty = F.coalesce(*[clean.quoted(field) for field in fields]).isNull()
    copies = (
        clean.blanks_to_nulls(extracted, fields)
        .groupBy("file", "from_table", *map(clean.quoted, fields))
        .agg(F.count("*").alias("copies"))
        .groupBy("file")
        .agg(
            F.sum(F.when(F.col("from_table"), F.col("copies"))).alias("rows_extracted"),
            F.count(F.when(~empty, 1)).alias("lots"),
            F.sum(F.when(~empty, F.col("copies"))).alias("_kept"),
        )
    )
    counts = ["tables", "empty_tables", "table_rows", "renamed_columns", "rows_extracted", "lots", "_kept", "key_values"]
    structure = F.when(F.col("is_hybrid"), "hybrid").otherwise("standard")
    # A file's last key-values are in its map; to count the pairs would be another pass over the reports.
    key_values = F.when(F.col("kv").isNotNull(), F.size("kv")).cast("long")
    joined = parsed.files.select("file", structure.alias("structure"), key_values.alias("key_values"))
    for part in (tables, copies):
        joined = joined.join(shuffled(part), "file", "left")
    joined = joined.na.fill(0, counts)
    return joined.select(
        "file",
        "structure",
        *counts[:6],
        F.greatest(F.col("rows_extracted") - F.col("_kept"), F.lit(0)).alias("blank_rows_removed"),
        (F.col("_kept") - F.col("lots")).alias("duplicates_removed"),
        "key_values",
    )


def ingest_audit(
    grid: DataFrame,
    fields: Sequence[str] = canonical.FULL_FIELDS,
    synonyms: dict | None = None,
    stored_by: Sequence[int | str] | None = None,
) -> DataFrame:
    return audit_of(parse_reports(grid, fields, synonyms, stored_by), fields)
