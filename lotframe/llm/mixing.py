"""Mixing sources to target weights by drawing fixed-length blocks.

The words of a source, its documents laid end to end, are packed into blocks of
``block_words``. Every source gets a number of output slots in proportion to its
target; pseudorandom permutations of slot numbers deal those slots to the output
shards, so the counts of sources in a shard are a multinomial draw given the
totals of the whole mix (free draws would leave a small source off its target by
the square root of its slots). Another permutation, one per source, maps the
source's slots to its blocks: each pass over the source takes every block once
before any is taken again, so nothing is taken more than three times.

Permutations are swap-or-not networks: bijections of any range, computed row by
row. Positions in a source are prefix sums over bounded chunks of its documents,
so a source may hold any share of the rows.

Defined results: a null source is a source of its own, last in order; documents
without words take part with nothing taken; repeated rows are documents of their
own; an empty table gives an empty mix. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.staging import stage
from .columns import documents, nullable_key, word_count, words

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
SEED = 20261
MAX_REPEATS = 3
ROUNDS = 14
CHUNK_ROWS = 4096
PAGE = 1 << 16


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per source (``source``, ``source_size``).

    Weights 1, 2, 3 repeat along the sources by code point, null last. Shares of
    the total stop at three times a source's size; what they leave is shared
    again by weight. That is the level at which ``min(level * weight, cap)`` adds
    up to the total, found by one pass over the sources in order of cap / weight.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sources.withColumn("weight", (F.row_number().over(ordered) - 1) % 3 + 1)
    weighted = weighted.withColumn("_cap", F.col("source_size") * F.lit(MAX_REPEATS))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped_before = F.coalesce(F.sum("_cap").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) - capped_before) / F.sum("weight").over(onward)
    levels = weighted.withColumn("_level", level)
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("weight"), F.col("_level"))
    final = levels.withColumn("_final", F.max(fits).over(everything))  # later rows only lower it
    target = F.least(F.col("_final") * F.col("weight"), F.col("_cap").cast("double"))
    return final.withColumn("target", F.coalesce(target, F.col("_cap").cast("double"))).drop("_cap", "_level", "_final")


def slot_quotas(sized: DataFrame, block_words: int) -> DataFrame:
    """One row per source with its target, blocks, slots and first slot."""
    sources = sized.groupBy("source", "src").agg(F.sum("size").alias("source_size"))
    goal = targets(sources).withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block_words)))
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size"))
    goal = goal.withColumn("_wanted", F.coalesce(wanted, F.lit(0.0)))
    goal = goal.withColumn("_least", F.floor("_wanted"))
    spare = F.round(F.sum(F.col("_wanted") - F.col("_least")).over(Window.partitionBy()))
    by_rest = Window.orderBy((F.col("_wanted") - F.col("_least")).desc(), "src")
    extra = (F.row_number().over(by_rest) <= spare).cast("long")
    goal = goal.withColumn("slots", F.least(F.col("_least") + extra, F.col("n_blocks") * MAX_REPEATS))
    before = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    goal = goal.withColumn("first_slot", F.coalesce(F.sum("slots").over(before), F.lit(0)).cast("long"))
    return goal.drop("_wanted", "_least")


def permuted(df: DataFrame, value: str, length: str, salts: list[Column], into: str) -> DataFrame:
    """``into``: a pseudorandom bijection of ``value`` within 0 .. ``length`` - 1.

    Each round pairs x with (key - x) mod length and swaps the pair or not by one
    hash bit of its larger member.
    """
    df = df.withColumn(into, F.col(value))
    for step in range(ROUNDS):
        key = F.pmod(F.xxhash64(*salts, F.lit(step)), F.col(length))
        df = df.withColumn("_mate", F.pmod(key - F.col(into), F.col(length)))
        coin = F.xxhash64(*salts, F.lit(step), F.greatest(into, "_mate")).bitwiseAND(F.lit(1)) == 1
        df = df.withColumn(into, F.when(coin, F.col("_mate")).otherwise(F.col(into)))
    return df.drop("_mate")


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", "text", *[name for name in ("lang",) if name in docs.columns],
        nullable_key("source").alias("src"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"),
    )


def placed_documents(sized: DataFrame, chunks: int) -> DataFrame:
    """Adds ``chunk``, ``row_no`` and ``start``, the word position within the source."""
    dealt = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "_tie"), F.lit(chunks)))
    totals = dealt.groupBy("src", "chunk").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("src", "chunk", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    order = ["doc_id", "_tie", "size"]
    inside = Window.partitionBy("src", "chunk").orderBy(*order)
    ranked = dealt.withColumn("row_no", F.row_number().over(inside))
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_inside", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    placed = ranked.join(offsets, ["src", "chunk"])
    return placed.withColumn("start", F.col("_inside") + F.col("_offset")).drop("_inside", "_offset", "_tie")


def drawn_slots(spark: SparkSession, quotas: DataFrame, n_slots: int, seed: int, shard_slots: int) -> DataFrame:
    """One row per output slot: ``shard``, ``slot``, ``src``, ``block``, ``pass_no``."""
    last = F.col("first_slot") + F.col("slots") - 1
    pages = quotas.where("slots > 0").withColumn(
        "page", F.explode(F.sequence(F.floor(F.col("first_slot") / PAGE), F.floor(last / PAGE)))
    )
    places = spark.range(n_slots).withColumn("page", F.floor(F.col("id") / F.lit(PAGE)))
    owned = places.join(pages, "page").where((F.col("id") >= F.col("first_slot")) & (F.col("id") <= last))
    owned = owned.withColumn("_n", F.lit(max(n_slots, 1)).cast("long"))
    owned = permuted(owned, "id", "_n", [F.lit(seed)], "_out")
    owned = owned.withColumn("_j", F.col("id") - F.col("first_slot"))
    owned = owned.withColumn("pass_no", F.floor(F.col("_j") / F.col("n_blocks")).cast("int"))
    owned = owned.withColumn("_i", F.pmod(F.col("_j"), F.col("n_blocks")))
    owned = permuted(owned, "_i", "n_blocks", [F.lit(seed + 1), F.col("src")], "block")
    return owned.select(
        F.floor(F.col("_out") / F.lit(shard_slots)).alias("shard"),
        F.pmod(F.col("_out"), F.lit(shard_slots)).alias("slot"),
        "src", "block", "pass_no",
    )


def block_pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """One row per document and block that it reaches into."""
    size = F.lit(block_words)
    end = F.col("start") + F.col("size")
    reach = F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size))
    pieces = placed.where("size > 0").withColumn("block", F.explode(reach))
    begin = F.greatest(F.col("start"), F.col("block") * size)
    stop = F.least(end, (F.col("block") + 1) * size)
    return pieces.select(
        "src", "chunk", "row_no", "doc_id", "source", "size", "block",
        (begin - F.col("start")).alias("first_word"), (stop - begin).alias("n_words"),
    )


class Mix:
    """A mix of ``docs`` (doc_id, text, source): quotas, drawn pieces and texts."""

    def __init__(
        self, docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED
    ):
        spark = docs.sparkSession
        self.sized = sized_documents(docs)
        slim = stage(self.sized.drop("text", "lang"), "mix-sizes")
        self.quotas = stage(slot_quotas(slim, block_words).coalesce(1), "mix-quotas")
        n_slots, n_rows = self.quotas.agg(F.sum("slots")).first()[0] or 0, slim.count()
        self.chunks = -(-n_rows // CHUNK_ROWS) or 1
        self.placed = placed_documents(slim, self.chunks)
        # Staged, since the optimizer would push filters on the block number down through
        # the rounds of the permutations and multiply their expressions.
        slots = stage(drawn_slots(spark, self.quotas, n_slots, seed, shard_slots), "mix-slots")
        #: What the mix holds: one row per slot and document piece in it.
        self.pieces = slots.join(block_pieces(self.placed, block_words), ["src", "block"])

    def taken(self) -> DataFrame:
        """One row per document with its source's figures and the words taken."""
        per_row = self.pieces.groupBy("src", "chunk", "row_no").agg(F.sum("n_words").alias("taken"))
        counted = self.placed.join(per_row, ["src", "chunk", "row_no"], "left")
        return counted.join(self.quotas.select("src", "source_size", "target", "weight"), "src").select(
            "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )

    def texts(self) -> DataFrame:
        """One row per document and pass: ``doc_id``, ``source``, ``lang`` if given, ``text`` of the words taken in that pass.

        A document taken whole keeps its text as it is; otherwise the taken words
        are joined by one space.
        """
        spans = F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("spans")
        keys = ["src", "chunk", "row_no"]
        drawn = self.pieces.groupBy(*keys, "pass_no").agg(spans, F.sum("n_words").alias("taken"))
        full = placed_documents(self.sized, self.chunks).join(drawn, keys)
        cut = F.flatten(F.transform("spans", lambda s: F.slice("_words", (s.first_word + 1).cast("int"), s.n_words.cast("int"))))
        full = full.withColumn("_words", F.when(F.col("taken") < F.col("size"), words(F.col("text"))))
        text = F.when(F.col("taken") < F.col("size"), F.array_join(cut, " ")).otherwise(F.col("text"))
        lang = ["lang"] if "lang" in self.sized.columns else []
        return full.select("doc_id", "source", *lang, "pass_no", text.alias("text"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(documents(spark, sf_dir)).taken()
