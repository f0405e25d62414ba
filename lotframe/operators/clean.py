"""Cleaning of canonical lots: blanks, empty rows, duplicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.text import blank_to_null
from ..session import keep_methods_small


def quoted(field: str) -> Column:
    """Fields carry spaces and ``#``."""
    return F.col(f"`{field}`")


def blanks_to_nulls(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Blank text becomes null; other values are not trimmed."""
    return df.withColumns({field: blank_to_null(quoted(field)) for field in fields})


def drop_empty_rows(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.filter(F.coalesce(*[quoted(field).cast("string") for field in fields]).isNotNull())


def distinct_lots(df: DataFrame, fields: Sequence[str], place: Sequence[str] = ()) -> DataFrame:
    """Distinct on all fields, null equal to null.

    With ``place`` columns the smallest place of each lot is kept as the struct
    ``first_seen``, so the caller can restore first-occurrence order. Equal rows
    collapse before the shuffle either way.
    """
    if not place:
        return df.select(*map(quoted, fields)).distinct()
    return df.groupBy(*map(quoted, fields)).agg(F.min(F.struct(*place)).alias("first_seen"))


def clean_lots(
    df: DataFrame,
    fields: Sequence[str],
    place: Sequence[str] = (),
    observe: tuple[Observation, Observation, Observation] | None = None,
) -> DataFrame:
    """Blank to null, empty rows out, duplicates out.

    ``observe`` takes three observations that receive the row counts before
    cleaning, without empty rows and after de-duplication, as ``n_rows``.
    """

    keep_methods_small(df.sparkSession)

    def counted(frame: DataFrame, step: int) -> DataFrame:
        return frame.observe(observe[step], F.count("*").alias("n_rows")) if observe else frame

    filled = counted(blanks_to_nulls(df, fields), 0)
    kept = counted(drop_empty_rows(filled, fields), 1)
    return counted(distinct_lots(kept, fields, place), 2)


def append_lots(existing: DataFrame, new: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Earlier output and new lots as one clean frame.

    Values are compared as text, so ``100`` read back is the ``100`` written.
    """
    same = [quoted(field).cast("string").alias(field) for field in fields]
    return clean_lots(existing.select(*same).unionByName(new.select(*same)), fields)


def lot_key(fields: Iterable[str], made_of: Mapping[str, str] | None = None) -> Column:
    """Equal for equal lots, whatever the order of their fields; a field that is null counts as absent.

    ``made_of``: the SQL of fields that are yet to be made.
    """
    of = quoted if made_of is None else lambda field: F.expr(made_of[field])
    return F.xxhash64(*[of(field).cast("string") for field in sorted(fields)])


def distinct_in_buckets(df: DataFrame, fields: Sequence[str], buckets: int) -> DataFrame:
    """Distinct lots with their ``lot_key``, dealt out by it: one shuffle does for both, or none if they have it and are."""
    keyed = df if "lot_key" in df.columns else df.withColumn("lot_key", lot_key(fields))
    return keyed.select(*map(quoted, fields), "lot_key").repartition(buckets, "lot_key").distinct()


def append_to_buckets(existing: DataFrame, new: DataFrame, fields: Sequence[str], buckets: int) -> DataFrame:
    """As :func:`append_lots` for clean, distinct ``existing`` lots, bucketed by ``lot_key`` (:func:`lot_key`).

    Only the new lots are shuffled, once, into the same buckets; equal ones collapse before that and after it. Each
    bucket's history streams past a hash table of its new lots; it is neither moved nor sorted.
    """
    keep_methods_small(new.sparkSession)
    names = [quoted(field).cast("string").alias(field) for field in fields]
    kept = drop_empty_rows(blanks_to_nulls(new.select(*names), fields), fields)
    keyed = kept.select(lot_key(fields).alias("_new_key"), F.struct(*map(quoted, fields)).alias("_new"))
    # By key alone, so that the lots come out in their buckets. Lots that differ may share a key: all of them are kept.
    of_key = keyed.groupBy("_new_key").agg(F.collect_set("_new").alias("_of_key")).repartition(buckets, "_new_key")
    fresh = of_key.select("_new_key", F.explode("_of_key").alias("_new")).hint("shuffle_hash")
    old = existing.select("lot_key", F.struct(*names).alias("_old"))
    # The comparison of lots is not an equality of columns, which would have to be hashed as well.
    same = (F.col("lot_key") == F.col("_new_key")) & F.array_contains(F.array("_old"), F.col("_new"))
    return old.join(fresh, same, "full_outer").select(F.coalesce("_old", "_new").alias("_lot")).select("_lot.*")
