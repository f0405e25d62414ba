"""Benchmark decontamination by spaced-seed hashing.

A window of ``SPAN`` tokens is hashed under fixed masks that skip half of its
places. Of an item with at most a fifth of its tokens substituted, wherever they
are, some window has an equal hash under some mask (any length of ``SPAN`` tokens
and more splits into stretches of 12 to 23, one of which has at most a fifth
substituted, and for those every placing was tried). Of substitutions at random
places, up to the rate that the rule below accepts, over 0.95 are hit at every length
(measured in the tests). Hashes of all windows of all documents are joined with those of the
benchmark items. A hit gives an alignment, along which the whole item is compared
with the document token by token. A document is contaminated by an item if, near
one alignment, it has

* ``LEAST_EQUAL`` of its tokens that are at least ``LEAST_SHARE`` of the item, or
* ``LONG_RUN`` consecutive tokens of it, or
* ``LONG_OVERLAP`` equal tokens of it in windows that hit.

Items of fewer than ``SPAN`` tokens are matched whole, by a hash of all tokens.

Tokens are runs of letters and digits of the lower-cased text, and single letters
of the scripts written without spaces. Only hits leave the scan: the benchmark's
hashes are broadcast while there are at most ``BROADCAST_SEEDS`` of them, and
joined by a shuffle beyond; so are the keys of documents with hits, whose tokens
are then read again.

Defined results: null texts have no tokens, and texts of fewer tokens than
``SPAN`` match items as short only; an item without tokens matches nothing; null
item ids are items; repeated rows and items give each pair once; an empty table
on either side gives no pairs; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.staging import stage
from .columns import documents, held, released, row_key

SPAN = 12
#: Places of the window that count. Found by search, so that together they have the property stated above.
MASKS = (
    (0, 1, 2, 7, 10, 11),
    (0, 4, 6, 8, 9, 11),
    (0, 3, 4, 5, 7, 11),
    (1, 2, 4, 5, 9, 10),
    (3, 5, 6, 7, 8, 9),
    (1, 2, 3, 6, 8, 10),
)
LEAST_EQUAL, LEAST_SHARE, LONG_RUN, LONG_OVERLAP = 10, 0.77, 13, 24
BROADCAST_SEEDS = 2_000_000
_UNSPACED = "".join(rf"\p{{Is{script}}}" for script in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
_TOKEN = rf"[{_UNSPACED}&&[\p{{L}}\p{{N}}]]|[\p{{L}}\p{{N}}&&[^{_UNSPACED}]]+"


def token_hashes(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def windows(df: DataFrame, hashes: str, keep: list[str], short: list[int]) -> DataFrame:
    """One row per window: ``keep``, ``at`` (first token) and the tokens' hashes w0 .. w11, null beyond the text's end.

    Windows that reach beyond the end are needed for ``short`` items only.
    """
    beyond = F.array_repeat(F.lit(None).cast("long"), SPAN - min(short)) if short else None
    padded = F.concat(hashes, beyond) if short else F.col(hashes)
    room = F.size(hashes) - ((min(short) if short else SPAN) - 1)
    shifted = [F.slice(padded, F.lit(i + 1), room) for i in range(SPAN)]
    zipped = F.arrays_zip(F.sequence(F.lit(0), room - 1), *shifted)
    names = ["at", *[f"w{i}" for i in range(SPAN)]]
    # Outer, as the filter that Spark infers from the inner form would compute the hashes twice.
    every = df.select(*keep, F.inline_outer(F.when(room > 0, zipped))).toDF(*keep, *names)
    return every.where("at is not null")


def seeds(short: list[int]) -> Column:
    """Hashes of a window under the masks and, for lengths in ``short``, of its first tokens."""
    spaced = [F.xxhash64(F.lit(i), *[f"w{place}" for place in mask]) for i, mask in enumerate(MASKS)]
    if not short:
        return F.array(*spaced)
    whole = [F.xxhash64(F.lit(100 + n), *[f"w{place}" for place in range(n)]) for n in short]
    spaced = [F.when(F.col(f"w{SPAN - 1}").isNotNull(), seed) for seed in spaced]
    whole = [F.when(F.col(f"w{n - 1}").isNotNull(), seed) for n, seed in zip(short, whole)]
    return F.array_compact(F.array(*spaced, *whole))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("h"))
    return items.select("item_id", "h", F.size("h").alias("n_item"), F.xxhash64("item_id", "h").alias("item")).where("n_item > 0")


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """One row per mask and item window: ``seed``, ``item``, ``item_at``."""
    long = windows(items.where(F.col("n_item") >= SPAN), "h", ["item"], []).select(F.explode(seeds([])).alias("seed"), "item", "at")
    whole = F.coalesce(*[
        F.when(F.col("n_item") == n, F.xxhash64(F.lit(100 + n), *[F.col("h")[i] for i in range(n)])) for n in range(1, SPAN)
    ])
    whole = items.where(F.col("n_item") < SPAN).select(whole.alias("seed"), "item", F.lit(0).alias("at"))
    return long.unionByName(whole).withColumnRenamed("at", "item_at").distinct()


def _broadcast_if_few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SEEDS else df


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs ``doc_id``, ``item_id`` with ``n_equal``, ``n_item`` and ``share``; ``_row`` is the document's row key."""
    items = stage(benchmark_items(benchmark), "benchmark-items")
    short = sorted(r.n_item for r in items.where(F.col("n_item") < SPAN).select("n_item").distinct().collect())
    known = _broadcast_if_few(benchmark_seeds(items))
    hashed = docs.select("doc_id", row_key().alias("_row"), token_hashes(F.col("text")).alias("h"))
    every = windows(hashed, "h", ["_row"], short)
    hits = every.select("_row", "at", F.explode(seeds(short)).alias("seed")).join(known, "seed")
    hits = hits.groupBy("_row", "item", (F.col("at") - F.col("item_at")).alias("offset")).agg(F.collect_set("item_at").alias("ats"))
    hits = stage(hits, "alignments")

    # The documents with hits, once each, compared along every alignment.
    keys = _broadcast_if_few(hits.select("_row").distinct())
    found = docs.select("doc_id", "text", row_key().alias("_row")).join(keys, "_row", "left_semi").dropDuplicates(["_row"])
    found = found.select("doc_id", "_row", token_hashes(F.col("text")).alias("h"))
    once = items.dropDuplicates(["item"]).withColumnRenamed("h", "tokens")
    pairs = hits.join(once, "item").join(found, "_row")
    of_item = F.sequence(F.lit(0), F.col("n_item") - 1)
    equal = F.filter(of_item, lambda i: F.get(F.col("h"), i + F.col("offset")) == F.get(F.col("tokens"), i))
    in_window = F.array_distinct(F.flatten(F.transform("ats", lambda at: F.sequence(at, F.least(at + SPAN, F.col("n_item")) - 1))))
    # An insertion moves what follows it; alignments a few tokens apart count as one.
    near = F.floor(F.col("offset") / SPAN)
    aligned = pairs.select("doc_id", "_row", "item", "item_id", "n_item", equal.alias("equal"), in_window.alias("within"), near.alias("near"))
    longest = F.aggregate(
        "equal", F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda a, i: F.struct(
            i.alias("last"), F.when(i == a["last"] + 1, a["run"] + 1).otherwise(1).alias("run"),
            F.greatest(a["most"], F.when(i == a["last"] + 1, a["run"] + 1).otherwise(1)).alias("most"),
        ),
        lambda a: a["most"],
    )
    aligned = aligned.select("*", longest.alias("run"), F.array_intersect("equal", "within").alias("hit"))
    aligned = aligned.withColumn("near", F.explode(F.array("near", F.col("near") + 1)))
    keys = ["doc_id", "_row", "item", "item_id", "n_item"]
    union = {name: F.size(F.array_distinct(F.flatten(F.collect_set(name)))) for name in ("equal", "hit")}
    overlaps = aligned.groupBy(*keys, "near").agg(union["equal"].alias("n_equal"), union["hit"].alias("n_hit"), F.max("run").alias("run"))
    share = F.col("n_equal") / F.col("n_item")
    enough = (F.col("n_equal") >= LEAST_EQUAL) & (share >= LEAST_SHARE) | (F.col("run") >= LONG_RUN) | (F.col("n_hit") >= LONG_OVERLAP)
    enough = F.when(F.col("n_item") < SPAN, F.col("n_equal") == F.col("n_item")).otherwise(enough)
    best = overlaps.where(enough).groupBy(*keys).agg(F.max("n_equal").cast("long").alias("n_equal"))
    return best.select(
        "doc_id", "item_id", "n_equal", F.col("n_item").cast("long").alias("n_item"), F.round(share, 6).alias("share"), "_row"
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = contaminated(docs, benchmark).select("_row").distinct()
    keyed = docs.select(held(docs.columns), row_key().alias("_row"))
    return keyed.join(found, "_row", "left_anti").select(*released(docs.columns))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return pairs.drop("_row").distinct()
