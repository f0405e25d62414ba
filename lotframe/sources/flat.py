"""Flat CSV files with a header line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T


def read_flat(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All columns as text, nothing inferred; cells may hold line breaks and keep their spaces.

    With ``columns`` the header is not sampled and columns match by position. A
    file with line breaks in cells can't be split: one task reads one file. Give
    large tables as several files, or as Parquet.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(name, T.StringType()) for name in columns]))
    else:
        reader = reader.option("inferSchema", False)
    return reader.csv(path)
