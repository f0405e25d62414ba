"""Periodic runs of words, found by recursive frequency splitting and lag scans.

A run of period q is a longest stretch of words in which words q apart are equal; it
holds two periods at least, so each of its words occurs in it twice at least.

1. Splitting: a word that occurs once in its segment (at first, a document) is in no
   run, so it splits the segment. What is left is counted again, until nothing changes;
   segments that are too short for a run go.
2. For periods from g to 2g - 1 (g a power of two) the same is done with groups of g
   words: a run's words all lie in groups that occur again at a distance from g to
   2g - 1, so other words split the segment, again until nothing changes.
3. The surviving segments are scanned at lags. Of a run with smallest period q, some
   group of g words has its next occurrence, among those g or more further on, exactly
   q words on. (Were there a nearer one for each of the first q - g + 1 groups, the
   stretches between would have common smaller periods, and so the run itself would.)
   So only lags seen between such occurrences are scanned, and no run is lost.
4. A stretch found at a multiple of a smaller period lies within the run of that one and goes.

Work grows as words times the logarithm of the document's length, whatever the periods.
A document is held by one task; many short ones share the array operations.

Words are compared by 64-bit hashes. Defined results: null, empty and blank texts have no
runs and collapse to empty text; repeated rows are worked out each; extra columns are kept,
but those named ``runs`` or ``collapsed`` are replaced; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .columns import documents, held, released, words as words_of
from .tokens import Words, portions

LEAST_LENGTH = 12
BATCH_BYTES = 1 << 22
RESULT = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _positions(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the segments in order, and the segment of each."""
    sizes = end - begin
    segment = np.repeat(np.arange(len(begin)), sizes)
    return np.arange(len(segment)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes), segment


def _stretches(position: np.ndarray, segment: np.ndarray, keep: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of kept, consecutive positions of one segment, of ``least`` and more."""
    position, segment = position[keep], segment[keep]
    if not len(position):
        return position, position
    cut = np.flatnonzero((np.diff(position) != 1) | (np.diff(segment) != 0)) + 1
    begin, end = position[np.concatenate(([0], cut))], position[np.concatenate((cut - 1, [len(position) - 1]))] + 1
    long_enough = end - begin >= least
    return begin[long_enough], end[long_enough]


def split_by_frequency(word: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments in which every word (a number from 0) occurs twice at least, ascending; only changed ones are counted again."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    kinds = int(word.max()) + 1 if len(word) else 1
    long_enough = end - begin >= least
    begin, end = begin[long_enough], end[long_enough]
    while len(begin):
        position, segment = _positions(begin, end)
        _, at, counts = np.unique(segment * kinds + word[position], return_inverse=True, return_counts=True)
        keep = counts[at] > 1
        stable = np.bincount(segment[~keep], minlength=len(begin)) == 0
        done.append((begin[stable], end[stable]))
        changed = ~stable[segment]
        begin, end = _stretches(position[changed], segment[changed], keep[changed], least)
    begin, end = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
    order = np.argsort(begin)
    return begin[order], end[order]


def _recurrences(group: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Of groups of ``size`` words in the segments: position, the next one from ``size`` on if nearer than twice that (else -1),
    and whether there is such a one on either side."""
    position, segment = _positions(begin, np.maximum(end - size + 1, begin))
    number = group[position]
    known = number >= 0
    position, segment, number = position[known], segment[known], number[known]
    order = np.argsort(number, kind="stable")  # positions ascend within a group's number
    position, segment, number = position[order], segment[order], number[order]
    line = number * (len(group) + 2 * size) + position
    after, before = np.searchsorted(line, line + size), np.searchsorted(line, line - size, "right") - 1

    def within(other: np.ndarray) -> np.ndarray:
        at = np.clip(other, 0, max(len(line) - 1, 0))
        same = (other >= 0) & (other < len(line)) & (number[at] == number) & (segment[at] == segment)
        return same & (np.abs(position[at] - position) < 2 * size)

    has_after, has_before = within(after), within(before)
    partner = np.where(has_after, position[np.clip(after, 0, max(len(line) - 1, 0))], -1)
    return position, segment, partner, has_after | has_before


def _paired(group: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the groups of twice ``size`` words that occur more than once; -1 for others."""
    out = np.full(len(group), -1, np.int64)
    position, _ = _positions(begin, np.maximum(end - 2 * size + 1, begin))
    both = (group[position] >= 0) & (group[position + size] >= 0)
    position = position[both]
    if len(position):
        pair = group[position] * (int(group.max()) + 1) + group[position + size]
        _, at, counts = np.unique(pair, return_inverse=True, return_counts=True)
        out[position] = np.where(counts[at] > 1, at, -1)
    return out


def _scanned(word: np.ndarray, begin: int, end: int, lag: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, lag) of the longest stretches of the segment that repeat at the lag."""
    same = np.concatenate(([False], word[begin : end - lag] == word[begin + lag : end], [False]))
    edge = np.flatnonzero(same[1:] != same[:-1])
    for first, last in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if last - first + lag >= max(least, 2 * lag):
            yield begin + first, last - first + lag, lag


def _primitive(runs: np.ndarray) -> np.ndarray:
    """Of one document's stretches (start, length, period), those whose period is their smallest."""
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    begin, end, period = runs[:, 0], runs[:, 0] + runs[:, 1], runs[:, 2]
    keep = np.ones(len(runs), bool)
    for i in range(1, len(runs)):
        inside = (begin[:i] <= begin[i]) & (end[:i] >= end[i])
        keep[i] = not (inside & (period[:i] < period[i]) & (period[i] % period[:i] == 0)).any()
    runs = runs[keep]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find_runs(word: np.ndarray, first: np.ndarray, least: int = LEAST_LENGTH) -> dict[int, np.ndarray]:
    """Runs (start within the document, length, period) by document, sorted; documents without any are left out.

    ``word``: any keys of words, of all documents one after another; ``first``: where each document begins, and the end.
    """
    _, word = np.unique(word, return_inverse=True)
    begin, end = split_by_frequency(word, first[:-1], first[1:], least)
    group = np.full(len(word), -1, np.int64)
    position, segment = _positions(begin, end)
    # Groups are numbered per segment, so those of other documents never count.
    group[position] = np.unique(segment * (len(word) + 1) + word[position], return_inverse=True)[1]
    found: list[tuple[int, int, int]] = []
    size = 1
    while len(begin):
        least_here = max(least, 2 * size)
        wide = end - begin >= least_here
        b, e = begin[wide], end[wide]
        while len(b):
            position, segment, partner, recurs = _recurrences(group, b, e, size)
            marks = np.zeros(len(word) + 1, np.int64)
            np.add.at(marks, position[recurs], 1)
            np.add.at(marks, position[recurs] + size, -1)
            inside, of = _positions(b, e)
            keep = np.cumsum(marks)[inside] > 0
            if keep.all():
                ahead = partner >= 0
                lag = partner[ahead] - position[ahead]
                pairs = np.unique(segment[ahead] * (2 * size) + lag)
                for s, q in zip((pairs // (2 * size)).tolist(), (pairs % (2 * size)).tolist()):
                    found.extend(_scanned(word, int(b[s]), int(e[s]), q, least))
                break
            b, e = _stretches(inside, of, keep, least_here)
        wide = end - begin >= max(least, 4 * size)
        begin, end = begin[wide], end[wide]
        group = _paired(group, begin, end, size)
        size *= 2
    if not found:
        return {}
    runs = np.array(found, np.int64)
    doc = np.searchsorted(first, runs[:, 0], "right") - 1
    runs[:, 0] -= first[doc]
    order = np.argsort(doc, kind="stable")
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    return {int(doc[part[0]]): _primitive(runs[part]) for part in np.split(order, cuts)}


def kept_words(n_words: int, runs: np.ndarray) -> np.ndarray:
    """False for words that a run contains after its first period."""
    marks = np.zeros(n_words + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(marks[:-1]) == 0


def _analysed(texts: list[bytes], least: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs and collapsed text of each."""
    words = Words(texts)
    runs = find_runs(words.hashes(), np.concatenate((words.first_word, [len(words.start)])), least)
    none = np.zeros((0, 3), np.int64)
    collapsed = []
    for i, text in enumerate(texts):
        parts = text.split()
        if i in runs:
            keep = kept_words(len(parts), runs[i])
            parts = [part for part, kept in zip(parts, keep.tolist()) if kept]
        collapsed.append(b" ".join(parts))
    return [runs.get(i, none) for i in range(len(texts))], collapsed


def with_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``docs`` with ``runs`` (by start, then period) and ``collapsed``: the words that no run repeats, joined by one space."""

    def analyse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [text or b"" for text in batch.to_pylist()]
            runs: list[np.ndarray] = []
            collapsed: list[bytes] = []
            for a, b in portions([len(text) for text in texts], BATCH_BYTES):
                some_runs, some_texts = _analysed(texts[a:b], least)
                runs += some_runs
                collapsed += some_texts
            table = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            each = pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(3)], ["start", "length", "period"])
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), each)
            yield pa.StructArray.from_arrays([lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    kept = [name for name in docs.columns if name not in ("runs", "collapsed")]
    found = docs.select(held(kept), F.arrow_udf(analyse, RESULT)(F.col("text").cast("binary")).alias("_found"))
    return found.select(*released(kept), "_found.runs", "_found.collapsed")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """The contract's planted repeats: in one of ten documents, all words from some place on repeat a period."""
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.withColumns({"_draw": draw, "_words": F.when(draw % 10 == 0, words_of(F.col("text")))})
    n, share = F.size("_words"), F.floor(F.col("_draw") / 10)
    placed = chosen.withColumn("_begin", share % n)
    placed = placed.withColumn("_period", 1 + F.floor((n - F.col("_begin")) / (3 + share % 8)))
    begin = F.col("_begin")
    source = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get("_words", F.when(i < begin, i).otherwise(begin + (i - begin) % F.col("_period")).cast("int")),
    )
    text = F.when(F.col("_words").isNotNull() & (n > 0), F.array_join(source, " ")).otherwise(F.col("text"))
    return placed.withColumn("text", text).drop("_draw", "_words", "_begin", "_period")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(with_planted_repeats(documents(spark, sf_dir).select("doc_id", "text")))
    longest = F.array_min(
        F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    digest = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest.alias("best"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    length = -F.col("best.less")
    return digest.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
