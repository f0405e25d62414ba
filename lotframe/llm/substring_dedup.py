"""Substring de-duplication by relative Lempel-Ziv parsing over reference blocks.

The corpus is its own reference. Documents are gathered into bounded blocks; a
block is indexed by its phrases of ``WINDOW`` words and its documents are parsed
against it. What a block can't resolve itself, it looks up in the index of every
other block: phrases are dealt to buckets by hash, each at most once per block, so
a passage that a third of all documents share gives one entry per block.

A look-up returns the phrase's earliest place. Parsing is greedy: consecutive
phrases whose earliest places are consecutive too form one factor. At the border
of two factors the phrases that straddle it have been looked up themselves, so
a word is removed exactly if some phrase covering it also starts earlier (a
smaller doc_id, or the same document at an earlier word).

Phrases are equal if their 64-bit hashes are.

Defined results: null text has no words; a text of fewer than ``WINDOW`` words
loses none; null doc_id counts as later than any other; rows that share a doc_id
and text are one document and neither is earlier than the other; rows that share
a doc_id, or have none, and differ in text are documents of their own, in the
order of a hash of their texts (``tag``, zero where a doc_id has one text); an
empty table stays empty; extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import stage
from .columns import LAST_ID, documents
from .tokens import Words, covered, mix64

WINDOW = 20
#: Text of one reference block, and of one bucket's or group's share.
BLOCK_BYTES = 2 << 20
SHARE_BYTES = 4 << 20
_PHRASES, _FOUND, _TEXTS = 0, 1, 2


def _planes(values: np.ndarray) -> bytes:
    """Integers by byte significance, which compresses well if the high bytes are mostly zero."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplaned(data: memoryview, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).view(kind).ravel()


def _in_order(start: np.ndarray, tag: np.ndarray, doc: np.ndarray, *before: np.ndarray) -> np.ndarray:
    return np.lexsort((start, tag, doc, *before) if tag.any() else (start, doc, *before))


def encoded(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, value: np.ndarray) -> bytes:
    """Rows sorted by doc, tag and start, as runs of docs, gaps between starts, and values."""
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))
    gaps = np.diff(start, prepend=0)
    gaps[new] = start[new]
    ids, tags = doc[new], tag[new]
    runs = np.diff(np.append(np.flatnonzero(new), len(doc)))
    head = np.array([len(doc), len(ids), value.dtype.itemsize, tags.any()], "<i8").tobytes()
    return b"".join([
        head, _planes(tags.astype("<i8")) if tags.any() else b"", _planes(np.diff(ids, prepend=0).astype("<i8")), _planes(runs.astype("<i4")), _planes(gaps.astype("<i8")), _planes(value),
    ])


def decoded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, n_ids, width, tagged = np.frombuffer(data, "<i8", 4).tolist()
    view, at, tags = memoryview(data), 32, np.zeros(n_ids, np.int64)
    if tagged:
        tags = _unplaned(view[at:], n_ids, "<i8")
        at += 8 * n_ids
    ids = np.cumsum(_unplaned(view[at:], n_ids, "<i8"))
    at += 8 * n_ids
    runs = _unplaned(view[at:], n_ids, "<i4")
    at += 4 * n_ids
    gaps = _unplaned(view[at:], n, "<i8")
    at += 8 * n
    value = _unplaned(view[at:], n, f"<u{width}")
    sums = np.cumsum(gaps)
    begins = np.cumsum(runs) - runs
    start = sums - np.repeat(sums[begins] - gaps[begins], runs)
    return np.repeat(ids, runs), np.repeat(tags, runs), start, value


def by_share(doc: np.ndarray, tag: np.ndarray, n_shares: int) -> np.ndarray:
    return (mix64((doc ^ tag).astype(np.uint64)) % np.uint64(n_shares)).astype(np.int32)


def parsed(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first of their phrase, and an alignment with the earliest place for all others.

    Rows that repeat the place of the first one are neither (alignment 0).
    """
    order = _in_order(start, tag, doc, phrase)
    d, t, s, p = doc[order], tag[order], start[order], phrase[order]
    new = np.concatenate(([True], p[1:] != p[:-1])) if len(p) else np.zeros(0, bool)
    source = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
    later = (d != d[source]) | (t != t[source]) | (s != s[source])
    places = d[source].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + t[source].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    aligned = mix64(places + (s[source] - s).astype(np.uint64))
    first, align = np.zeros(len(p), bool), np.zeros(len(p), np.uint32)
    first[order] = new
    align[order] = np.where(later, (aligned >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
    return first, align


def _dealt(key: np.ndarray, kind: int, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    """One payload per key; rows come sorted by doc, tag and start."""
    order = np.argsort(key, kind="stable")
    keys, begin = np.unique(key[order], return_index=True)
    end = np.append(begin[1:], len(key))
    parts = [order[a:b] for a, b in zip(begin, end)]
    payloads = [encoded(doc[p], tag[p], start[p], value[p]) for p in parts]
    return pd.DataFrame({"share": keys.astype(np.int32), "kind": np.int32(kind), "payload": payloads})


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Blocks of documents: ids (null as the last), tags and texts."""
    ids: list[int] = []
    tags: list[int] = []
    texts: list[bytes] = []
    size = 0
    for pdf in batches:
        for doc_id, tag, text in zip(pdf.doc_id, pdf.tag, pdf.text):
            raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
            if texts and size + len(raw) > BLOCK_BYTES:
                yield np.array(ids, np.int64), np.array(tags, np.int64), texts
                ids, tags, texts, size = [], [], [], 0
            ids.append(LAST_ID if pd.isna(doc_id) else int(doc_id))
            tags.append(int(tag))
            texts.append(raw)
            size += len(raw)
    if texts:
        yield np.array(ids, np.int64), np.array(tags, np.int64), texts


def _index_blocks(n_shares: int):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, tags, texts in _gathered(batches):
            order = np.lexsort((tags, ids))
            ids, tags, texts = ids[order], tags[order], [texts[i] for i in order]
            words = Words(texts)
            first_word, phrase = words.run_hashes(WINDOW)
            number = words.doc[first_word]
            doc, tag, start = ids[number], tags[number], first_word - words.first_word[number]
            if len(set(zip(ids.tolist(), tags.tolist()))) < len(ids):
                order = _in_order(start, tag, doc)
                doc, tag, start, phrase = doc[order], tag[order], start[order], phrase[order]
            is_first, align = parsed(doc, tag, start, phrase)
            bucket = (phrase % np.uint64(n_shares)).astype(np.int32)
            rest = (phrase // np.uint64(n_shares)).astype("<u8")
            yield _dealt(bucket[is_first], _PHRASES, doc[is_first], tag[is_first], start[is_first], rest[is_first])
            found = align > 0
            yield _dealt(by_share(doc[found], tag[found], n_shares), _FOUND, doc[found], tag[found], start[found], align[found])

    return index


def _look_up(n_shares: int):
    def look_up(pdf: pd.DataFrame) -> pd.DataFrame:
        """Resolves a bucket's phrases over all blocks; what blocks found themselves passes through."""
        known = pdf[pdf.kind == _FOUND]
        parts = [decoded(p) for p in pdf.payload[pdf.kind == _PHRASES]]
        if not parts:
            return known
        doc, tag, start, phrase = (np.concatenate(x) for x in zip(*parts))
        _, align = parsed(doc, tag, start, phrase)
        found = align > 0
        doc, tag, start, align = doc[found], tag[found], start[found], align[found]
        order = _in_order(start, tag, doc)
        doc, tag, start, align = doc[order], tag[order], start[order], align[order]
        return pd.concat([known, _dealt(by_share(doc, tag, n_shares), _FOUND, doc, tag, start, align)], ignore_index=True)

    return look_up


def _packed_texts(n_shares: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1)
        for ids, tags, texts in _gathered(batches):
            share = by_share(ids, tags, n_shares)
            rows = []
            for key in np.unique(share):
                at = np.flatnonzero(share == key)
                sizes = np.array([len(texts[i]) for i in at], "<i8")
                body = np.array([len(at)], "<i8").tobytes() + ids[at].astype("<i8").tobytes() + tags[at].astype("<i8").tobytes() + sizes.tobytes()
                rows.append((key, _TEXTS, press.compress(body + b"".join(texts[i] for i in at))))
            yield pd.DataFrame(rows, columns=["share", "kind", "payload"]).astype({"share": "int32", "kind": "int32"})

    return pack


def factors(start: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (words) of the factors that found phrases of one document form."""
    cut = np.concatenate(([True], (np.diff(start) != 1) | (align[1:] != align[:-1])))
    begin = start[cut]
    last = start[np.append(np.flatnonzero(cut)[1:] - 1, len(start) - 1)]
    return begin, last + WINDOW


def _remove(pdf: pd.DataFrame) -> pd.DataFrame:
    found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    parts = [decoded(p) for p in pdf.payload[pdf.kind == _FOUND]]
    if parts:
        doc, tag, start, align = (np.concatenate(x) for x in zip(*parts))
        order = _in_order(start, tag, doc)
        doc, tag, start, align = doc[order], tag[order], start[order], align[order]
        begin = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))) if len(doc) else np.zeros(0, np.int64)
        for a, b in zip(begin, np.append(begin[1:], len(doc))):
            found[int(doc[a]), int(tag[a])] = start[a:b], align[a:b]
    reader, rows = zstandard.ZstdDecompressor(), []
    for payload in pdf.payload[pdf.kind == _TEXTS]:
        body = reader.decompress(payload)
        n = int(np.frombuffer(body, "<i8", 1)[0])
        ids, tags, sizes = np.frombuffer(body, "<i8", 3 * n, 8).reshape(3, n).tolist()
        at = 8 + 24 * n
        for doc_id, tag, size in zip(ids, tags, sizes):
            words = body[at : at + size].split()
            at += size
            spans: list[tuple[int, int]] = []
            kept = words
            if (doc_id, tag) in found:
                start, align = found[doc_id, tag]
                gone = covered(len(words), start, WINDOW)
                kept = [word for word, out in zip(words, gone.tolist()) if not out]
                begin, end = factors(start, align)
                spans = list(zip(begin.tolist(), end.tolist()))
            text = b" ".join(kept).decode("utf-8", "replace")
            rows.append((None if doc_id == LAST_ID else doc_id, len(words), len(words) - len(kept), text, spans))
    out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_text", "spans"])
    return out.astype({"doc_id": "Int64", "n_words": "int64", "n_removed": "int64"})


def without_repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` and the factors' ``spans`` (words, end exclusive)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts_hash = F.xxhash64("text", F.col("text").isNull())
    several = docs.groupBy("doc_id").agg(F.min(texts_hash).alias("a"), F.max(texts_hash).alias("b")).where("a <> b")
    several = stage(several.select(F.col("doc_id").alias("_several"), F.lit(True).alias("_tagged")), "ids-of-several-texts")
    if several.isEmpty():
        docs = docs.withColumn("tag", F.lit(0).cast("long"))
    else:
        docs = docs.join(several, F.col("doc_id").eqNullSafe(F.col("_several")), "left")
        docs = docs.select("doc_id", "text", F.when(F.col("_tagged"), texts_hash).otherwise(F.lit(0)).cast("long").alias("tag"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shares = -(-total // SHARE_BYTES) or 1
    payload = "share int, kind int, payload binary"
    phrases = docs.mapInPandas(_index_blocks(n_shares), payload)
    found = phrases.groupBy("share").applyInPandas(_look_up(n_shares), payload)
    texts = docs.mapInPandas(_packed_texts(n_shares), payload)
    schema = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<begin: long, end: long>>"
    return found.unionByName(texts).groupBy("share").applyInPandas(_remove, schema)


def op3_relative_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = without_repeated_spans(documents(spark, sf_dir))
    return result.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").alias("n_factors")
    )
