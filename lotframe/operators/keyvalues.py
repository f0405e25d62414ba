"""``key: value`` and ``key = value`` text anywhere in a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import normalise_header, strip


def key_value_pairs(grid: DataFrame, mapping: DataFrame) -> DataFrame:
    """Accepted pairs with their place in the file.

    A segment with a colon is never read as ``key = value``. Rows without
    either sign are not split at all.
    """
    line = F.array_join("cells", ",")
    has_sign = F.contains(line, F.lit(":")) | F.contains(line, F.lit("="))
    # The outer generator keeps this test above the shared shuffle of the grid.
    segments = grid.select(
        "file",
        "sheet_no",
        "row_no",
        F.posexplode_outer(F.when(has_sign, F.split(line, "[;,]"))).alias("seg_no", "segment"),
    )
    segment = F.col("segment")
    sign = F.when(F.contains(segment, F.lit(":")), ":").when(F.contains(segment, F.lit("=")), "=")
    at = F.instr(segment, F.col("_sign"))
    split = (
        segments.withColumn("_sign", sign)
        .filter(F.col("_sign").isNotNull())
        .select(
            "file",
            "sheet_no",
            "row_no",
            "seg_no",
            normalise_header(F.substring(segment, F.lit(1), at - 1)).alias("variant"),
            strip(F.substring(segment, at + 1, F.length(segment))).alias("value"),
        )
    )
    accepted = split.filter(F.col("value") != "").join(F.broadcast(mapping), "variant")
    return accepted.select("file", "sheet_no", "row_no", "seg_no", F.col("canonical").alias("field"), "value")


def last_values(pairs: DataFrame) -> DataFrame:
    """The last pair of each (file, field) in sheet, row and segment order."""
    place = F.struct("sheet_no", "row_no", "seg_no")
    return pairs.groupBy("file", "field").agg(F.max_by("value", place).alias("value"))


def key_value_maps(pairs: DataFrame) -> DataFrame:
    """One map per file; it has at most one entry per canonical field."""
    entries = F.collect_list(F.struct("field", "value"))
    return last_values(pairs).groupBy("file").agg(F.map_from_entries(entries).alias("kv"))
