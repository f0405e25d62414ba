"""SimHash near-duplicates, found with a vantage-point tree over fingerprints.

A fingerprint has a bit for each position at which over half of the hashes of a
text's shingles have one. Documents link if their fingerprints differ in few
bits; a component is what links reach.

Equal fingerprints are one point from the start. A tree built on a bounded sample
of points halves space again and again by the distance to a vantage point; every
point gets a home leaf. Two points within the radius differ by no more than the
radius in their distance to any vantage point, so a point goes as a guest to
those other leaves alone that it can have partners in. A leaf compares its homes
with each other and with its guests, splitting further by vantage points while
it is large, and gives back one star per local component, not all pairs. The
sample only shapes the leaves; every point is routed and every pair within the
radius meets.

Defined results: null, empty or blank text has fingerprint zero and links like
any other; the component of documents is named by their smallest non-null
doc_id; repeated rows share a fingerprint; an empty table stays empty; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import stage
from .columns import documents, held, released
from .components import components

SHINGLE_WORDS, RADIUS = 3, 2
SEED = 42
#: The tree is fitted on one in ``SAMPLE_SHARE`` points, within these bounds.
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST = 32, 2048, 1 << 18
LEAF_SAMPLE = 64
HASHES = 1 << 32
#: Pairs compared at once in a leaf.
BLOCK_PAIRS = 1 << 22
PORTION = 1 << 15


def fingerprint(text: str | None, shingle_words: int) -> bytes:
    """Eight bytes, the highest bit first."""
    words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    size, counts, n = min(shingle_words, len(words)), np.zeros(64, np.int64), len(words) - min(shingle_words, len(words)) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    begin, end = start[:n].tolist(), (start + lengths)[size - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, n, PORTION):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(begin[at : at + PORTION], end[at : at + PORTION])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def with_fingerprint(docs: DataFrame, shingle_words: int, into: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit integer."""

    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([int.from_bytes(fingerprint(t, shingle_words), "big", signed=True) for t in batch], dtype="int64")

    return docs.withColumn(into, F.pandas_udf(compute, "long")(F.col("text")))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Of a signed number, the bits of its absolute value would be counted.
    return np.bitwise_count((a ^ b).view(np.uint64))


def vantage_tree(points: np.ndarray, leaf_size: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, limit, near child, far child); a leaf is (0, -1, leaf number, 0)."""
    nodes: list[tuple[int, int, int, int]] = []
    n_leaves = 0
    todo: list[tuple[np.ndarray, int, bool]] = [(points, -1, True)]
    while todo:
        own, parent, near = todo.pop()
        at = len(nodes)
        if parent >= 0:
            point, limit, left, right = nodes[parent]
            nodes[parent] = (point, limit, at, right) if near else (point, limit, left, at)
        split = None
        if len(own) > leaf_size:
            # Of a few candidates, the one whose distances spread most.
            candidates = own[:: max(1, len(own) // 8)][:8]
            tables = [_apart(own, c) for c in candidates]
            best = int(np.argmax([t.std() for t in tables]))
            limit = int(np.median(tables[best]))
            inside = tables[best] <= limit
            if not inside.all():
                split = (int(candidates[best]), limit, inside)
        if split is None:
            nodes.append((0, -1, n_leaves, 0))
            n_leaves += 1
        else:
            nodes.append((split[0], split[1], -1, -1))
            todo.append((own[~split[2]], at, False))
            todo.append((own[split[2]], at, True))
    return nodes


def routed(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indices of points, whether at home) for every leaf that gets any.

    Of a pair that a node parts, the near point is sent on to the far side.
    """
    todo = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        at, index, home = todo.pop()
        point, limit, left, right = nodes[at]
        if limit < 0:
            yield left, index, home
            continue
        distance = _apart(points[index], np.int64(point)).astype(np.int64)
        # A guest's partners are homes on either side; a home's partner on the near side comes to it.
        near = np.where(home, distance <= limit, distance <= limit + radius)
        far = np.where(home, distance > limit - radius, distance > limit - radius)
        if near.any():
            todo.append((left, index[near], home[near]))
        if far.any():
            todo.append((right, index[far], (home & (distance > limit))[far]))


class _Forest:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, index: np.ndarray) -> np.ndarray:
        found = self.parent[index]
        while True:
            above = self.parent[found]
            if (above == found).all():
                return found
            found = above

    def join(self, index: np.ndarray) -> None:
        roots = np.unique(self.roots(index))
        self.parent[roots] = roots[0]


def _link(points: np.ndarray, homes: np.ndarray, others: np.ndarray, radius: int, forest: _Forest) -> None:
    """Joins every home with the homes and others within ``radius``, in bounded blocks."""
    todo = [(homes, others)]
    while todo:
        homes, others = todo.pop()
        if not len(homes) or not len(others):
            continue
        if len(homes) * len(others) > BLOCK_PAIRS and len(homes) > 64:
            pivot = points[homes[len(homes) // 2]]
            dh, do = _apart(points[homes], pivot), _apart(points[others], pivot).astype(np.int64)
            limit = int(np.median(dh))
            near = dh <= limit
            left, right = others[do <= limit + radius], others[do > limit - radius]
            if not near.all() and len(left) + len(right) < 1.6 * len(others):
                todo += [(homes[near], left), (homes[~near], right)]
                continue
        step = max(1, BLOCK_PAIRS // len(others))
        for at in range(0, len(homes), step):
            some = homes[at : at + step]
            close = _apart(points[some][:, None], points[others][None, :]) <= radius
            for row in np.flatnonzero(close.sum(axis=1) > 0):
                forest.join(np.append(others[close[row]], some[row]))


def leaf_stars(points: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, smallest point of its local component) for points that have a partner."""
    unique, at = np.unique(points, return_inverse=True)
    is_home = np.zeros(len(unique), bool)
    is_home[at[home]] = True
    forest = _Forest(len(unique))
    _link(unique, np.flatnonzero(is_home), np.arange(len(unique)), radius, forest)
    roots = forest.roots(np.arange(len(unique)))
    linked = roots != np.arange(len(unique))
    return unique[linked], unique[roots[linked]]


def fingerprint_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect what links within ``radius`` connect; ``points``: distinct ``fp``."""
    n = points.count()
    size = min(max(n // SAMPLE_SHARE, SAMPLE_LEAST), SAMPLE_MOST)
    # By a limit of the hash, so that no task or driver sees more than the sample; it is within a few per cent of ``size``.
    limit = min(size * HASHES // max(n, 1), HASHES)
    sample = points.where(F.pmod(F.xxhash64("fp"), F.lit(HASHES)) < limit).toPandas()
    nodes = vantage_tree(np.sort(sample.fp.to_numpy(np.int64)), LEAF_SAMPLE)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = pdf.fp.to_numpy(np.int64)
            for leaf, index, home in routed(values, nodes, radius):
                yield pd.DataFrame({"leaf": np.full(len(index), leaf, np.int32), "fp": values[index], "home": home})

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = leaf_stars(pdf.fp.to_numpy(np.int64), pdf.home.to_numpy(bool), radius)
        return pd.DataFrame({"u": u, "v": v})

    placed = points.select("fp").mapInPandas(route, "leaf int, fp long, home boolean")
    return placed.groupBy("leaf").applyInPandas(link, "u long, v long")


def near_duplicate_components(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` for every row of ``docs`` (doc_id, text)."""
    marked = stage(with_fingerprint(docs.select("doc_id", "text"), shingle_words).select("doc_id", "fp"), "fingerprints")
    points = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    roots = components(fingerprint_links(points, radius)).withColumnRenamed("node", "fp")
    return _named(marked, points, roots, "fp")


def _named(marked: DataFrame, points: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Every row of ``marked`` with the smallest doc_id of its component."""
    rooted = points.join(roots, key, "left").withColumn("root", F.coalesce("root", key))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_point = rooted.select(key, "root").join(named, "root").select(key, "component_id")
    return marked.join(by_point, key).select("doc_id", key, "component_id")


def one_per_component(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of ``found``; of rows that share its doc_id, one.

    Rows without doc_id can't name a component and stay as they are.
    """
    keepers = found.select(F.col("component_id").alias("_id")).where("_id is not null").distinct()
    rows = docs.select(held(docs.columns), F.col("doc_id").alias("_id"))
    named = rows.where("_id is not null").join(keepers, "_id", "left_semi").dropDuplicates(["_id"])
    return named.unionByName(rows.where("_id is null")).select(*released(docs.columns))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
