"""Sharding along a Hilbert curve through metadata.

Source, language and size are quantised to ``2 ** BITS`` levels each; documents
are ordered by the place of that cell on a three-dimensional Hilbert curve and
the order is cut into runs of equal count. Neighbours on the curve are near in
every dimension, so a file's minima and maxima are narrow in all three and a
filter on any of them skips most files.

Ranks are prefix sums: over the cells (at most ``2 ** (3 * BITS)`` rows), over
bounded chunks of a cell, and within a chunk; a cell may hold any share of rows.

Defined results: null language or source are values of their own; null text has
no bytes; repeated rows get slots of their own; an empty table stays empty.
Columns named like the operator's own (shard, slot) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.staging import stage
from .columns import documents, held, nullable_key, released

N_SHARDS = 24
BITS = 5
CHUNK_ROWS = 4096


def hilbert_index(df: DataFrame, axes: list[str], bits: int, into: str) -> DataFrame:
    """``into``: distance along the Hilbert curve of the integer point ``axes``.

    Skilling's transform: rotations are undone from the highest bit down, the
    result is Gray-coded and the bits of the axes are interleaved.
    """
    first, names = "_h0", [f"_h{i}" for i in range(len(axes))]
    df = df.withColumns({name: F.col(axis).cast("long") for name, axis in zip(names, axes)})
    for bit in range(bits - 1, 0, -1):
        low = F.lit((1 << bit) - 1).cast("long")
        for name in names:
            is_set = F.col(name).bitwiseAND(F.lit(1 << bit)) != 0
            df = df.withColumn("_t", F.col(first).bitwiseXOR(F.col(name)).bitwiseAND(low))
            df = df.withColumn("_set", is_set)
            flipped = F.when(F.col("_set"), F.col(first).bitwiseXOR(low)).otherwise(F.col(first).bitwiseXOR(F.col("_t")))
            if name == first:  # with itself the difference is zero
                df = df.withColumn(first, flipped)
            else:
                other = F.when(F.col("_set"), F.col(name)).otherwise(F.col(name).bitwiseXOR(F.col("_t")))
                df = df.withColumns({first: flipped, name: other})
    for before, name in zip(names, names[1:]):
        df = df.withColumn(name, F.col(name).bitwiseXOR(F.col(before)))
    df = df.withColumn("_t", F.lit(0).cast("long"))
    for bit in range(bits - 1, 0, -1):
        is_set = F.col(names[-1]).bitwiseAND(F.lit(1 << bit)) != 0
        turned = F.col("_t").bitwiseXOR(F.lit((1 << bit) - 1).cast("long"))
        df = df.withColumn("_t", F.when(is_set, turned).otherwise(F.col("_t")))
    df = df.withColumns({name: F.col(name).bitwiseXOR(F.col("_t")) for name in names})
    index: Column = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for name in names:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(name), bit).bitwiseAND(F.lit(1)))
    return df.withColumn(into, index).drop("_t", "_set", *names)


def levels(docs: DataFrame, column: str, into: str, bits: int) -> DataFrame:
    """One row per value of ``column``, its rank scaled to ``2 ** bits`` levels; staged, so that its size is known."""
    values = docs.select(nullable_key(column).alias(f"_key_{into}")).distinct()
    rank = F.row_number().over(Window.orderBy(f"_key_{into}")) - 1
    total = F.count("*").over(Window.partitionBy())
    scaled = values.withColumn(into, F.floor(rank * F.lit(1 << bits) / total).cast("long"))
    return stage(scaled.coalesce(1), "hilbert-levels")


def hilbert_shards(
    docs: DataFrame, n_shards: int = N_SHARDS, bits: int = BITS, size: Column | None = None, tie: Column | None = None
) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; counts of shards differ by one at most.

    ``size`` (the third dimension) and ``tie`` (a hash that orders the rows of a
    cell) are made from doc_id and text unless given. Rows are shuffled once.
    """
    names = [name for name in docs.columns if name not in ("shard", "slot")]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8 if size is None else size
    tie = F.xxhash64("doc_id", "text") if tie is None else tie
    n_rows = docs.count()
    keyed = docs.select(
        held(names), nullable_key("source").alias("_key__source"), nullable_key("lang").alias("_key__lang"), tie.alias("_tie"),
        F.least(F.floor(F.log2(size) * 1.5).cast("long"), F.lit((1 << bits) - 1)).alias("_size"), F.col("doc_id").alias("_id"),
    )
    keyed = keyed.join(levels(docs, "source", "_source", bits), "_key__source")
    keyed = keyed.join(levels(docs, "lang", "_lang", bits), "_key__lang")
    axes = ["_source", "_lang", "_size"]
    # At most 2 ** (3 * bits) cells. Staged, since the optimizer would push filters on the
    # curve index down through the chained steps and multiply their expressions.
    cells = keyed.groupBy(*axes).agg(F.count("*").alias("_cell_rows")).coalesce(1)
    curve = stage(hilbert_index(cells, axes, bits, "_curve"), "hilbert-cells")
    chunks = F.ceil(F.col("_cell_rows") / F.lit(CHUNK_ROWS))
    keyed = keyed.join(curve, axes).withColumn("_chunk", F.pmod(F.col("_tie"), chunks)).drop("_cell_rows")

    chunk_rows = stage(keyed.groupBy("_curve", "_chunk").agg(F.count("*").alias("_rows")), "hilbert-chunks")
    in_cell = Window.partitionBy("_curve").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk_at = chunk_rows.withColumn("_in_cell", F.coalesce(F.sum("_rows").over(in_cell), F.lit(0)))
    cells = chunk_rows.groupBy("_curve").agg(F.sum("_rows").alias("_cell_rows"))
    along = Window.orderBy("_curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_curve", F.coalesce(F.sum("_cell_rows").over(along), F.lit(0)).alias("_cell_at"))
    offsets = chunk_at.join(cells, "_curve").select("_curve", "_chunk", (F.col("_in_cell") + F.col("_cell_at")).alias("_offset"))
    offsets = stage(offsets, "hilbert-offsets")

    local = F.row_number().over(Window.partitionBy("_curve", "_chunk").orderBy("_tie", "_id")) - 1
    ranked = keyed.withColumn("_local", local).join(offsets, ["_curve", "_chunk"])
    ranked = ranked.withColumn("_rank", F.col("_local") + F.col("_offset"))
    ranked = ranked.withColumn("shard", F.floor(F.col("_rank") * n_shards / F.lit(max(n_rows, 1))).cast("int"))
    begins = F.ceil(F.col("shard").cast("long") * F.lit(n_rows) / n_shards)
    ranked = ranked.withColumn("slot", (F.col("_rank") - begins).cast("long"))
    return ranked.select(*released(names), "shard", "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """Writes the shards in slot order, one folder each."""
    placed = hilbert_shards(docs, n_shards)
    placed.repartitionByRange(n_shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    # The digest of a text is all that this query returns of it, so the rows to order are narrow.
    rows = documents(spark, sf_dir).select(
        "doc_id", "lang", "source",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = hilbert_shards(rows, size=F.col("size"), tie=F.xxhash64("doc_id", "text_crc32"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
