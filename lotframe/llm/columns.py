"""Column expressions and table helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The six ASCII white space characters; a word is a longest run of anything else.
ASCII_SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
LAST_ID = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Words of ``text`` in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def nullable_key(name: str) -> Column:
    """A text key that is never null and tells null from every value."""
    return F.coalesce(F.concat(F.lit("v"), F.col(name).cast("string")), F.lit("n"))


def held(names: list[str]) -> Column:
    """The caller's columns as one struct, so that no name of an operator's own can clash with theirs."""
    return (F.struct(*[F.col(f"`{name}`") for name in names]) if names else F.struct(F.lit(0).alias("_"))).alias("_doc")


def released(names: list[str]) -> list[Column]:
    return [F.col("_doc").getField(name).alias(name) for name in names]


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Equal for equal documents only (64 bits); rows that repeat a document share it."""
    return F.xxhash64(F.lit(1), F.col(doc_id), F.lit(2), F.col(text), F.col(text).isNull())
