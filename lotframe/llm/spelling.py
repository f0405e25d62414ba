"""Spelling variants, found by sorting permuterm rotations.

A word is closed by a terminator and written out in all its rotations. Where two
words differ in one replaced code point, the rotations that begin behind it agree
in all but their last code point; where one word has a code point more, its rotation
that begins behind it, without its last code point, is a whole rotation of the other.
So every rotation is sorted twice, as it is and without its last code point, and
neighbours are those that meet under equal text. Such a group holds words that
differ in one place only: its size is bounded by the alphabet, whatever the corpus.

A group is scanned once and gives each member the number of its neighbours there and
the most frequent of them (the first of the group, or the second for the first
itself), not the pairs. A pair that meets in several groups, since the additional code
point stands in a run of equal ones, is counted for the first place of the run alone.

Defined results: null and empty texts have no words; a null doc_id is written as
empty text before the colon; repeated rows count as often as they stand there; ties
go to the smallest word in code-point order; an empty table stays empty; extra
columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.staging import stage
from .columns import documents

LETTERS = "[A-Za-zÀ-ÿ]+"
#: No word holds it, and it sorts before all letters.
TERMINATOR = "$"
LEAST_CHARS, LEAST_COUNT = 7, 2
#: A word's form is this many times as frequent.
RATIO = 10
DELETED_SHARE = 31


def ascii_lower(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(text.rlike("[A-Z]"), lowered).otherwise(text)


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id`` and ``word``: longest runs of letters, A-Z lower-cased, a row each."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS})"), F.lit(1))).alias("word"))
    return runs.where(F.char_length("word") >= least_chars).withColumn("word", ascii_lower(F.col("word")))


def without_code_point(word: Column, at: Column) -> Column:
    """``word`` without its code point number ``at``, counted from 0."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def counted(words: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` for the words that are long and frequent enough."""
    counts = words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """``key``, ``word``, ``n`` and ``skips``: null for a whole rotation, else whether the code point
    that the key leaves out is the first of a run of equal ones."""
    closed = F.concat("word", F.lit(TERMINATOR))
    begin = F.col("begin")
    rotation = F.concat(F.substr("closed", begin + 1), F.substr("closed", F.lit(1), begin))
    last, before = F.substr("closed", begin, F.lit(1)), F.substr("closed", begin - 1, F.lit(1))
    turned = words.select(
        "word", "n", closed.alias("closed"), F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("begin")
    )
    turned = turned.select(
        "word",
        "n",
        rotation.alias("rotation"),
        F.when(begin > 0, (begin == 1) | (last != before)).alias("leads"),
    )
    whole = F.struct(F.col("rotation").alias("key"), F.lit(None).cast("boolean").alias("skips"))
    cut = F.struct(F.expr("left(rotation, char_length(rotation) - 1)").alias("key"), F.col("leads").alias("skips"))
    # The terminator is not skipped: the rotation that ends with it gives its whole text alone.
    keys = F.when(F.col("leads").isNull(), F.array(whole)).otherwise(F.array(whole, cut))
    return turned.select("word", "n", F.explode(keys).alias("_k")).select("_k.key", "word", "n", "_k.skips")


def neighbour_summaries(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and the most frequent neighbour ``near`` with its count ``near_n``.

    ``words``: distinct ``word`` without the terminator, and ``n``. Words without a neighbour are left out.
    """
    group = Window.partitionBy("key")
    along = group.orderBy(F.col("n").desc(), "word")
    all_along = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    skips = F.col("skips")
    member = F.struct("n", "word")
    scanned = rotations(words).select(
        "word",
        "skips",
        F.row_number().over(along).alias("_place"),
        F.first(member).over(all_along).alias("_first"),
        F.nth_value(member, 2).over(all_along).alias("_second"),
        F.count("skips").over(all_along).alias("_skipping"),
        F.count(F.when(skips, 1)).over(all_along).alias("_leading"),
        F.max(skips.isNull()).over(all_along).alias("_whole"),
    )
    replaced = F.col("_skipping") - 1
    longer_by_one = F.when(skips & F.col("_whole"), 1).otherwise(0)
    near = F.when(skips.isNull(), F.col("_leading")).otherwise(replaced + longer_by_one)
    best = F.when(F.col("_place") == 1, F.col("_second")).otherwise(F.col("_first"))
    found = scanned.where(F.col("_second").isNotNull()).select(
        "word", near.alias("near"), F.struct((-best["n"]).alias("less"), best["word"].alias("word")).alias("best")
    )
    summed = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return summed.select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: the end of the chain of forms that begins at ``word`` (``forms``: word, form).

    Chains double per round; a form is more frequent than its word, so there is no cycle.
    """
    links = stage(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = links.join(further, "root", "left")
        if jumped.where("_next is not null").isEmpty():
            return links
        links = stage(jumped.select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots")


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Each of ``words`` (word, n) with ``n_near``, ``form``, ``form_n`` and ``root``.

    ``form`` is the most frequent word at one inserted, deleted or replaced code point if it is at least
    ``ratio`` times as frequent, else null; ``root`` is where the chain of forms ends.
    """
    words = stage(words.select("word", "n"), "spelling-words")
    is_form = F.col("near_n") >= ratio * F.col("n")
    near = words.join(neighbour_summaries(words), "word", "left")
    near = near.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"),
        F.when(is_form, F.col("near_n")).alias("form_n"),
    )
    near = stage(near, "spelling-near")
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = occurrences(documents(spark, sf_dir))
    # The contract's planted misspellings: of one in 31 (document, word), a code point goes.
    label = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
    draw = F.crc32(label.cast("binary"))
    at = (draw % F.char_length("word")).cast("int")
    word = F.when(draw % DELETED_SHARE == 0, without_code_point(F.col("word"), at)).otherwise(F.col("word"))
    return spelling_groups(counted(found.select(word.alias("word")))).select("word", "form", "root", "n", "n_near", "form_n")
