"""Secret scans: patterns, and the cost of guessing a value that stands as a credential.

Three patterns give the base spans. Beyond them, a value in a credential context
(a key name with a colon, an equals sign or "is"; an authorization header; the
password of a connection string) is a secret if it would be hard to guess: the
cheapest way to write it as a sequence of dictionary words, dates, repeats,
keyboard walks and brute-force stretches, found by dynamic programming, must
take at least ``LEAST_GUESSES`` (as a power of ten) guesses. Prose and
placeholders after such a key are cheap and stay.

Words are ranked by their counts over the whole corpus, behind a short list that
guessers try first. The ``DICTIONARY`` commonest of those that occur ``LEAST_SEEN``
times are the dictionary (some 50,000 entries, broadcast); letters that are in no
word cost brute force. Letters that stand in the corpus often enough are a word,
whoever wrote them.

Defined results: null text has no spans; texts are scanned whole; repeated rows
give equal rows; an empty table stays empty; extra columns are kept, but those
named as the added ones are replaced. Words are counted in one pass with a shuffle of
counts; the scan is another without any.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import stage
from .columns import documents, held, released
from .spelling import ascii_lower

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The longest runs of the class of 32 or more; shorter ones count for nothing.
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Further names of credentials.
CONTEXT_WORDS = (
    "password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "apikey", "api-key",
    "access_key", "private_key", "client_secret", "credential", "credentials", "auth", "authorization", "bearer",
)
CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:" + "|".join(sorted(CONTEXT_WORDS, key=len, reverse=True)) + r")[\"']?"
    r"(?:\x20*(?::=|=>|[:=])\x20*(?:bearer\x20+|basic\x20+)?|\x20+is\x20+|\x20+bearer\x20+)[\"'`]?([^\s\"'`,;<>]+)",
    re.IGNORECASE | re.ASCII,
)
LOGIN_URL = re.compile(r"://[^\s:/@]+:([^\s/@]+)@")
LEAST_GUESSES = 10.0
#: Words of the corpus in the dictionary at most, how often they occur at least, and their letters.
DICTIONARY, LEAST_SEEN = 50_000, 10
BANDS_PER_OCTAVE = 16
SHORTEST_WORD, LONGEST_WORD = 3, 24

#: Words that guessers try first, the commonest first.
COMMON_WORDS = (
    "password", "123456", "qwerty", "admin", "welcome", "letmein", "secret", "login", "master", "dragon", "monkey",
    "football", "baseball", "sunshine", "princess", "shadow", "superman", "batman", "trustno", "hello", "freedom",
    "whatever", "changeme", "default", "example", "sample", "test", "testing", "user", "guest", "root", "access",
    "token", "your", "here", "none", "null", "true", "false", "value", "string", "insert", "replace", "placeholder",
    "redacted", "hidden", "summer", "winter", "spring", "autumn", "love", "michael", "jordan", "charlie", "thomas",
    "george", "daniel", "andrew", "jessica", "jennifer", "michelle", "computer", "internet", "service", "server",
    "database", "system", "public", "private", "company", "office", "family", "money", "flower", "cookie", "cheese",
    "coffee", "orange", "banana", "purple", "yellow", "silver", "golden", "black", "white", "green", "blue", "red",
    "the", "and", "for", "that", "this", "with", "not", "you", "have", "from", "was", "are", "key", "pass", "word",
    "api", "app", "dev", "prod", "stage", "local", "host", "name", "home", "work", "data", "file", "code", "open",
)
RANKS = {word: rank for rank, word in enumerate(COMMON_WORDS, 1)}
#: Rows of a keyboard.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEXT_KEYS = {a + b for row in KEY_ROWS for a, b in zip(row, row[1:])} | {b + a for row in KEY_ROWS for a, b in zip(row, row[1:])}
_LOOKALIKE = str.maketrans("4301578@$!", "aeoistbasi")
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?[01]?\d[-/._]?[0-3]?\d|[0-3]?\d[-/._]?[01]?\d[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
_DATE_COST = math.log10(365 * 120)


def _alphabet(text: str) -> int:
    size = 0
    for low, high, count in (("a", "z", 26), ("A", "Z", 26), ("0", "9", 10)):
        size += count * any(low <= c <= high for c in text)
    return (size + 33 * any(not (c.isascii() and c.isalnum()) for c in text)) or 1


def word_ranks(docs: DataFrame, most: int = DICTIONARY) -> dict[str, int]:
    """Rank by word: the common ones, then those of ``docs`` by their counts, ``most`` at most; collected by the driver.

    Words of about the same count (a sixteenth of an octave) are taken or left together.
    """
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("word"))
    runs = runs.where(F.char_length("word").between(SHORTEST_WORD, LONGEST_WORD))
    counts = runs.groupBy(ascii_lower(F.col("word")).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEN)
    counts = stage(counts.withColumn("band", F.floor(F.log2("n") * BANDS_PER_OCTAVE).cast("int")), "word-counts")
    # Some hundreds of bands, then the words of those that fit: nothing is ordered that is not kept.
    lowest, room = None, most
    for band in counts.groupBy("band").agg(F.count("*").alias("words")).orderBy(F.col("band").desc()).collect():
        room -= band.words
        if room < 0:
            break
        lowest = band.band
    kept = counts.where(F.col("band") >= lowest).select("word", "n").collect() if lowest is not None else []
    found = [row.word for row in sorted(kept, key=lambda row: (-row.n, row.word))]
    return RANKS | {word: rank for rank, word in enumerate((w for w in found if w not in RANKS), len(RANKS) + 1)}


def _word_cost(piece: str, ranks: dict[str, int]) -> float | None:
    low = piece.lower()
    plain = low.translate(_LOOKALIKE)
    rank = min(ranks.get(low, 10**9), ranks.get(plain, 10**9), ranks.get(low[::-1], 10**9))
    if rank == 10**9:
        return None
    changed = (piece != low) + (low not in ranks) + (piece not in (low, low.upper(), low.capitalize()))
    return math.log10(rank * 2**changed + 1)


def pieces(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 of guesses) of every stretch that can be one piece of a segmentation."""
    n, low = len(value), value.lower()
    per_char = math.log10(max(_alphabet(value), 10))
    for at in range(n):
        # A stretch of brute force is as many pieces as characters.
        yield at, at + 1, per_char
        for end in range(at + SHORTEST_WORD, min(n, at + LONGEST_WORD) + 1):
            word = _word_cost(value[at:end], ranks)
            if word is not None:
                yield at, end, word
        if value[at].isdigit() and (match := _DATE.match(value, at)):
            yield at, match.end(), _DATE_COST
        # Walks and repeats are taken from where they begin, so a long run costs linear time.
        end = at + 1 if at == 0 or low[at - 1 : at + 1] not in _NEXT_KEYS else n
        while end < n and low[end - 1] + low[end] in _NEXT_KEYS:
            end += 1
            if end - at >= 3:
                yield at, end, math.log10(47 * (end - at))
        for period in (1, 2, 3, 4):
            end = at + 2 * period if at < period or value[at - period : at] != value[at : at + period] else n + 1
            while end <= n and value[end - period : end] == value[at : at + period]:
                yield at, end, period * per_char + math.log10((end - at) // period)
                end += period


def guess_cost(value: str, ranks: dict[str, int] = RANKS) -> float:
    """Log10 of the guesses the cheapest segmentation of ``value`` needs."""
    best = [0.0] + [math.inf] * len(value)
    for start, end, cost in pieces(value, ranks):  # by start, so that best[start] is final
        best[end] = min(best[end], best[start] + cost)
    return best[-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, leftmost and not overlapping per kind."""
    found, low = [], text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guessed_spans(text: str, base: list[tuple[int, int, int]], ranks: dict[str, int] = RANKS) -> list[tuple[int, int, int]]:
    """Hard values in credential contexts outside the base spans."""
    low, found = text.lower(), []
    patterns = [CONTEXT] if any(word in low for word in CONTEXT_WORDS) else []
    patterns += [LOGIN_URL] if "://" in text else []
    for pattern in patterns:
        for match in pattern.finditer(text):
            value = match[1].rstrip(".!?)]}:")
            start, end = match.start(1), match.start(1) + len(value)
            inside = any(a < end and start < b for a, _, b in base)
            if value and not inside and guess_cost(value, ranks) >= LEAST_GUESSES:
                found.append((start, 3, end))
    return sorted(set(found))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scanned(docs: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with counts per kind, ``base`` and ``spans`` (kind:start:end, by start).

    ``ranks``: of words, by default those of ``docs`` themselves (:func:`word_ranks`).
    """
    fields = ("n_assign", "n_access", "n_hex", "n_guess", "base", "spans")
    known = docs.sparkSession.sparkContext.broadcast(word_ranks(docs) if ranks is None else ranks)

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                extra = guessed_spans(text, base, known.value)
                counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                rows.append((*counts, len(extra), _joined(base), _joined(sorted(base + extra))))
            yield pd.DataFrame(rows, columns=list(fields))

    found_by = F.pandas_udf(scan, "n_assign long, n_access long, n_hex long, n_guess long, base string, spans string")
    kept = [name for name in docs.columns if name not in fields]
    found = docs.select(held(kept), found_by(F.col("text")).alias("_found"))
    return found.select(*released(kept), *[F.col(f"_found.{name}") for name in fields])


def op4_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_guess"
    )
