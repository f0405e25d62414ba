"""Lines that many documents share, counted in a sharded minimal perfect hash.

A line's key is the line without white space at its ends, A-Z lower-cased; a line is
known by its key's 64-bit hash. The distinct hashes are cut into shards of about
``SHARD_KEYS`` by their high bits. A shard's minimal perfect hash gives each of its
keys a slot of its own: level after level, keys that are alone at their place in a
bit array stay there, and those that collide go on to the next; a key's slot is the
number of set bits before its own. Beside it are two arrays by slot: a fingerprint,
which tells keys that were never indexed (but one in 65,536), and the number of
documents that hold the key.

Documents probe the arrays. A portion (one batch of documents) sends each of its
distinct hashes once, packed by group of shards, so a line that is everywhere costs
one probe per portion; it never sends more rows than it has hashes. Groups meet
their probes sorted behind the shards, so a task holds one group's arrays and one
batch of probes. What comes back is the common hashes of each portion, which its
documents' hashes, staged once at eight bytes a line, are marked with. Only the
numbers of kept lines, of documents that lose any, are joined with the documents.

Defined results: null and empty texts are one empty line; empty keys are never
common; each row is a document, so repeated rows count as often as they stand there
and have equal results; extra columns are kept, but those named ``n_lines``,
``n_dropped`` or ``kept`` are replaced; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import stage
from .columns import documents, held, released, row_key
from .tokens import mix64

SPACE = b" \t\n\x0b\x0c\r"
MIN_DOCUMENTS, LEAST_CHARS = 10, 1
#: Keys of a shard and shards of a group, on average.
SHARD_KEYS, GROUP_SHARDS = 1 << 13, 16
#: Bits of a level for each key that it gets.
ROOM = 2
#: Hashes in one packed row.
PACKED = 1 << 10
#: What an empty or too short key has for a hash.
NO_KEY = 0
FINGERPRINT = np.uint16


def line_hashes(text: bytes | None, least_chars: int) -> np.ndarray:
    """Hash of each line's key, ``NO_KEY`` for keys under ``least_chars`` code points."""
    found = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(SPACE).lower()
        long_enough = len(key) >= 4 * least_chars or len(key.decode("utf-8", "replace")) >= least_chars
        found.append((xxhash.xxh3_64_intdigest(key) or 1) if key and long_enough else NO_KEY)
    return np.array(found, np.uint64)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys; other keys get a slot or -1."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        before = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        self.rank = np.concatenate(([0], before[:-1])) if len(words) else np.zeros(0, np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            size = -(-len(left) * ROOM // 64) * 64
            place = cls._place(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[place]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, first = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = first + self._place(keys[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.rank[at >> 6] + below)[hit]
            left = left[~hit]
            first += size
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(48)).astype(FINGERPRINT)


def shard_arrays(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, str, bytes]:
    """Level sizes, bits, fingerprints, and counts in the smallest type that holds them."""
    index = PerfectHash.of(keys)
    slots = index.slots(keys)
    kind = np.min_scalar_type(int(counts.max()))
    marks, numbers = np.empty(len(keys), FINGERPRINT), np.empty(len(keys), kind)
    marks[slots], numbers[slots] = fingerprints(keys), counts
    return np.array(index.sizes, np.int64).tobytes(), index.words.tobytes(), marks.tobytes(), numbers.dtype.str, numbers.tobytes()


class Shard:
    def __init__(self, sizes: bytes, bits: bytes, marks: bytes, kind: str, counts: bytes):
        self.index = PerfectHash(np.frombuffer(sizes, np.int64).tolist(), np.frombuffer(bits, np.uint64))
        self.marks, self.numbers = np.frombuffer(marks, FINGERPRINT), np.frombuffer(counts, kind)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Documents that hold each key; 0 for keys that were not indexed (as far as fingerprints tell)."""
        slots = self.index.slots(keys)
        known = slots >= 0
        known[known] = self.marks[slots[known]] == fingerprints(keys[known])
        out = np.zeros(len(keys), np.int64)
        out[known] = self.numbers[slots[known]]
        return out


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _distinct(blobs: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(blobs), np.uint64))


def hashed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``portion``, ``row_key`` and ``hashes`` (eight bytes a line) of each row of ``docs`` (doc_id, text), staged.

    Portions number the batches as they were read, so the table is only good as written.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        for number, pdf in enumerate(batches):
            blobs = [line_hashes(text, least_chars).tobytes() for text in pdf.text]
            yield pd.DataFrame({"portion": first + number, "row_key": pdf.row_key, "hashes": blobs})

    rows = docs.select(row_key().alias("row_key"), F.col("text").cast("binary").alias("text"))
    return stage(rows.mapInPandas(hashed, "portion long, row_key long, hashes binary"), "line-hashes")


def line_index(lines: DataFrame) -> tuple[DataFrame, int]:
    """One row of arrays per shard, staged, and the number of high bits that tell shards."""

    def per_portion(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = [np.zeros(0, np.uint64), *(_distinct([blob]) for blob in pdf.hashes)]
            keys, counts = np.unique(np.concatenate(each), return_counts=True)
            yield pd.DataFrame({"key": keys.view(np.int64), "n": counts})

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = shard_arrays(pdf.key.to_numpy(np.int64).view(np.uint64), pdf.n.to_numpy(np.int64))
        return pd.DataFrame([(pdf.shard[0], *arrays)], columns=["shard", "sizes", "bits", "marks", "kind", "counts"])

    counted = lines.select("hashes").mapInPandas(per_portion, "key long, n long").where(F.col("key") != NO_KEY)
    counted = stage(counted.groupBy("key").agg(F.sum("n").alias("n")), "line-counts")
    shards = -(-counted.count() // SHARD_KEYS)
    bits = max(shards - 1, 0).bit_length()
    shard = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    arrays = counted.withColumn("shard", shard).groupBy("shard")
    schema = "shard long, sizes binary, bits binary, marks binary, kind string, counts binary"
    return stage(arrays.applyInPandas(build, schema), "line-index"), bits


def common_keys(lines: DataFrame, index: DataFrame, bits: int, min_documents: int) -> DataFrame:
    """``portion`` and ``hashes``: packed hashes of the portion that ``min_documents`` hold at least."""
    group_bits = max(bits - (GROUP_SHARDS - 1).bit_length(), 0)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for portion, part in pdf.groupby("portion", sort=False):
                keys = _distinct(part.hashes.tolist())
                keys = keys[keys != NO_KEY]
                # The keys ascend, and so do their groups.
                cuts = np.flatnonzero(np.diff(shard_of(keys, group_bits))) + 1
                for some in np.split(keys, cuts) if len(keys) else ():
                    group = int(shard_of(some[:1], group_bits)[0])
                    out += [(group, portion, some[at : at + PACKED].tobytes()) for at in range(0, len(some), PACKED)]
            yield pd.DataFrame(out, columns=["group", "portion", "hashes"])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, shards = None, {}
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.group != group:
                    group, shards = row.group, {}
                if row.kind_of_row == 0:
                    shards[row.shard] = Shard(row.sizes, row.bits, row.marks, row.kind, row.counts)
                    continue
                keys = np.frombuffer(row.hashes, np.uint64)
                shard = shard_of(keys, bits)
                counts = np.zeros(len(keys), np.int64)
                for number in np.unique(shard).tolist():
                    if number in shards:
                        own = shard == number
                        counts[own] = shards[number].counts(keys[own])
                common = keys[counts >= min_documents]
                if len(common):
                    out.append((row.portion, common.tobytes()))
            yield pd.DataFrame(out, columns=["portion", "hashes"])

    probes = lines.select("portion", "hashes").mapInPandas(send, "group long, portion long, hashes binary")
    group = F.shiftright("shard", bits - group_bits)
    # No nulls in integers, which pandas would turn into floats.
    arrays = index.withColumns({"group": group, "portion": F.lit(0).cast("long"), "kind_of_row": F.lit(0)})
    sent = probes.withColumns({"shard": F.lit(0).cast("long"), "kind_of_row": F.lit(1)})
    both = arrays.unionByName(sent, allowMissingColumns=True)
    met = both.repartition("group").sortWithinPartitions("group", "kind_of_row")
    return met.mapInPandas(probe, "portion long, hashes binary")


def kept_lines(lines: DataFrame, common: DataFrame) -> DataFrame:
    """``row_key`` and ``keep`` (numbers of its lines from 0) of the rows that lose lines."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        portion, keys = None, np.zeros(0, np.uint64)
        for pdf in batches:
            out = []
            for number, part in pdf.groupby("portion", sort=False):
                if number != portion:
                    portion, keys = number, np.zeros(0, np.uint64)
                answers = part.row_key.isna().to_numpy()
                keys = _distinct([keys.tobytes(), *part.hashes[answers]])
                blobs = part.hashes[~answers].tolist()
                # The lines of all documents at once; most documents lose none.
                line = np.frombuffer(b"".join(blobs), np.uint64)
                at = np.minimum(np.searchsorted(keys, line), max(len(keys) - 1, 0))
                keep = keys[at] != line if len(keys) else np.ones(len(line), bool)
                ends = np.cumsum([len(blob) // 8 for blob in blobs])
                losing = np.unique(np.searchsorted(ends, np.flatnonzero(~keep), "right"))
                row_keys = part.row_key[~answers].tolist()
                for doc in losing.tolist():
                    begin = ends[doc] - len(blobs[doc]) // 8
                    out.append((int(row_keys[doc]), np.flatnonzero(keep[begin : ends[doc]]).astype(np.int32)))
            yield pd.DataFrame(out, columns=["row_key", "keep"])

    both = lines.select("portion", F.struct("row_key").alias("row"), "hashes").unionByName(
        common.select("portion", F.lit(None).cast("struct<row_key:long>").alias("row"), "hashes")
    )
    met = both.repartition("portion").sortWithinPartitions("portion", F.col("row").isNotNull())
    # As text, since pandas would turn a column of integers with nulls into floats.
    flat = met.select("portion", F.col("row.row_key").cast("string").alias("row_key"), "hashes")
    return flat.mapInPandas(mark, "row_key long, keep array<int>").dropDuplicates(["row_key"])


def without_common_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept``: the text without the lines whose key ``min_documents`` hold."""
    lines = hashed_lines(docs, least_chars)
    index, bits = line_index(lines)
    keep = kept_lines(lines, common_keys(lines, index, bits, min_documents))
    names = [name for name in docs.columns if name not in ("n_lines", "n_dropped", "kept")]
    joined = docs.select(held(names), row_key().alias("row_key"), F.coalesce("text", F.lit("")).alias("body")).join(keep, "row_key", "left")
    joined = joined.withColumn("lines", F.split("body", "\n", -1))
    left_over = F.array_join(F.transform("keep", lambda i: F.get("lines", i)), "\n")
    # Worked out apart from the caller's columns, which may have the same names.
    own = F.struct(
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("keep").isNull(), 0).otherwise(F.size("lines") - F.size("keep")).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("body")).otherwise(left_over).alias("kept"),
    )
    return joined.select("_doc", own.alias("_own")).select(*released(names), "_own.n_lines", "_own.n_dropped", "_own.kept")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_common_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT row_no, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM texts
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), common AS (
    SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT row_no) >= 10
), marked AS (
    SELECT keyed.*, common.key IS NOT NULL AS dropped FROM keyed LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id
"""
