"""Language ID with hyperdimensional profiles.

Every character has a pseudorandom vector of ``DIMENSIONS`` signs, made from its
code point. A trigram's vector binds its letters, each rotated by its place, by
multiplication; a document bundles (adds) the vectors of its trigrams; a language
prototype bundles its labelled documents. The prediction is the prototype with
the highest cosine after the mean of the prototypes is taken from both sides,
since all languages share their commonest trigrams.

Prototypes are sums, so they are aggregated by language and dimension and have
a fixed size whatever the corpus holds.

Defined results: null text or one without a letter is ``und`` with score 0, as is
everything if nothing was learned; rows with null language are not learned from;
ties go to the smallest language; repeated rows count as often as they stand
there; extra columns are kept, but those named ``lang_pred`` or ``score`` are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .columns import documents, held, released
from .tokens import mix64, portions

DIMENSIONS = 1024
GRAM = 3
FOLDS, HELD_OUT = 3, 1
#: Trigrams of a document are counted in portions, so a long text needs no more memory.
BATCH_CHARS = 1 << 19
#: A table of texts and grams is dense if it has at most so many cells for each gram that occurs: 4 million a portion.
DENSE_CELLS = 8
GRAMS_AT_ONCE = 4096
UNKNOWN = "und"
_GAP = np.uint32(32)
_BITS = 21  # of a code point


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    kinds, at = np.unique(codes, return_inverse=True)
    is_letter = np.fromiter((chr(c).isalpha() for c in kinds.tolist()), bool, len(kinds))[at]
    codes = np.where(is_letter, codes, _GAP)
    padded = np.concatenate(([_GAP], codes, [_GAP]))
    keep = np.concatenate(([True], (padded[1:] != _GAP) | (padded[:-1] != _GAP)))
    return padded[keep]


def _grams(codes: np.ndarray) -> np.ndarray:
    wide = codes.astype(np.uint64)
    shifts = [np.uint64(_BITS * (GRAM - 1 - i)) for i in range(GRAM)]
    n = max(len(wide) - GRAM + 1, 0)
    out = np.zeros(n, np.uint64)
    for i, shift in enumerate(shifts):
        out |= wide[i : i + n] << shift
    return out


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """One row of signs for each code point."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    noise = mix64(mix64(codes.astype(np.uint64))[:, None] + words * np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(noise.view(np.uint8).reshape(len(codes), -1), axis=1)
    return bits.astype(np.float32) * 2 - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound, rotated letter vectors of each gram."""
    mask = np.uint64((1 << _BITS) - 1)
    letters = np.stack([(grams >> np.uint64(_BITS * (GRAM - 1 - i))) & mask for i in range(GRAM)])
    kinds, at = np.unique(letters, return_inverse=True)
    vectors = letter_vectors(kinds)
    bound = np.ones((len(grams), DIMENSIONS), np.float32)
    for i, row in enumerate(at.reshape(letters.shape)):
        bound *= np.roll(vectors, i, axis=1)[row]
    return bound


def _bundles(texts: list[str], owner: np.ndarray, n_owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Bundled grams of the texts of each owner, and whether it has a letter."""
    codes = [_letters(text) for text in texts]
    has_letter = np.zeros(n_owners, bool)
    np.logical_or.at(has_letter, owner, [len(c) > 1 for c in codes])
    grams = [_grams(c) for c in codes]
    out = np.zeros((n_owners, DIMENSIONS), np.float32)
    for a, b in portions([len(g) for g in grams], BATCH_CHARS):
        kinds, at = np.unique(np.concatenate(grams[a:b]), return_inverse=True)
        whose = np.repeat(owner[a:b], [len(g) for g in grams[a:b]])
        rows, whose = np.unique(whose, return_inverse=True)
        if len(rows) * len(kinds) <= DENSE_CELLS * len(at):
            counts = np.bincount(whose * len(kinds) + at, minlength=len(rows) * len(kinds))
            counts = counts.reshape(len(rows), len(kinds)).astype(np.float32)
            for c in range(0, len(kinds), GRAMS_AT_ONCE):
                out[rows] += counts[:, c : c + GRAMS_AT_ONCE] @ gram_vectors(kinds[c : c + GRAMS_AT_ONCE])
        else:
            _add_sparse(out, rows, kinds, *np.unique(whose * len(kinds) + at, return_counts=True))
    return out, has_letter


def _add_sparse(out: np.ndarray, rows: np.ndarray, kinds: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> None:
    """Adds the grams of each (row, kind) pair to its row of ``out``; a table of all rows and kinds is never made."""
    for c in range(0, len(pairs), GRAMS_AT_ONCE):
        row, kind = np.divmod(pairs[c : c + GRAMS_AT_ONCE], len(kinds))
        vectors = gram_vectors(kinds[kind])
        vectors *= counts[c : c + GRAMS_AT_ONCE, None].astype(np.float32)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[rows[row[first]]] += np.add.reduceat(vectors, first, axis=0)


def learned_prototypes(labelled: DataFrame) -> DataFrame:
    """``lang`` and ``prototype`` (array of ``DIMENSIONS``) from ``text`` and ``lang``."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            langs, owner = np.unique(pdf.lang.to_numpy(str), return_inverse=True)
            texts = pdf.text.tolist()
            for a, b in portions([len(t) for t in texts], BATCH_CHARS):
                found, _ = _bundles(texts[a:b], owner[a:b], len(langs))
                for lang, row in zip(langs.tolist(), found):
                    sums[lang] = sums.get(lang, 0) + row.astype(np.float64)
        names = list(sums)
        yield pd.DataFrame({
            "lang": np.repeat(names, DIMENSIONS).astype(object), "place": np.tile(np.arange(DIMENSIONS), len(names)).astype("int32"),
            "value": np.concatenate([sums[n] for n in names]) if names else np.zeros(0),
        })

    usable = labelled.where("lang is not null and text is not null").select("lang", "text")
    parts = usable.mapInPandas(bundle, "lang string, place int, value double")
    summed = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x.value)
    return summed.groupBy("lang").agg(vector.alias("prototype"))


def _directions(prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit prototypes less their mean direction, and that mean."""
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    mean = unit.mean(axis=0) if len(unit) > 1 else np.zeros(DIMENSIONS)
    apart = unit - mean
    return (apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-9)).astype(np.float32), mean.astype(np.float32)


def predicted(docs: DataFrame, prototypes: DataFrame) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; one prototype vector per language is read by the driver."""
    rows = sorted((r.lang, r.prototype) for r in prototypes.collect())
    langs = np.array([lang for lang, _ in rows], dtype=object)
    toward, mean = _directions(np.array([p for _, p in rows]).reshape(len(rows), DIMENSIONS))

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for a, b in portions([len(t) for t in texts], BATCH_CHARS) if len(langs) else ():
                found, known = _bundles(texts[a:b], np.arange(b - a), b - a)
                found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
                found -= mean
                found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
                cosine = np.round(found @ toward.T, 6)
                best = cosine.argmax(axis=1)
                names[a:b] = np.where(known, langs[best], UNKNOWN)
                scores[a:b] = np.where(known, (cosine[np.arange(b - a), best] + 1) / 2, 0.0)
            yield pd.DataFrame({"lang_pred": names, "score": np.clip(scores, 0, 1)})

    result = F.pandas_udf(predict, "lang_pred string, score double")
    kept = [name for name in docs.columns if name not in ("lang_pred", "score")]
    found = docs.select(held(kept), result(F.col("text")).alias("_found"))
    return found.select(*released(kept), "_found.lang_pred", "_found.score")


def op10_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    )
    prototypes = learned_prototypes(docs.where(~F.col("held_out")))
    return predicted(docs.select("doc_id", "held_out", "text"), prototypes).drop("text")
