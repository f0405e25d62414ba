"""Words of many texts at once: positions and hashes as numpy arrays.

The texts of a batch are laid into one byte buffer; words, their hashes and the
hashes of runs of words come from a handful of array operations over it. Hashes
are polynomials over 64-bit integers, taken as differences of prefix sums and
mixed afterwards, so equal runs have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i < n."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        tables = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        known = _powers[base] = (tables[0], tables[1])
    return known[0][:n], known[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    powers, _ = _power_tables(base, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers, out=out[1:])
    return out


class Words:
    """Words of ``texts`` (bytes): ``start``/``end`` in ``buffer`` and the text's number ``doc``."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts)
        self.buffer = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(sizes[:-1] + 1))) if texts else np.zeros(0, np.int64)
        self.text_end = self.text_start + sizes
        inside = ~_SPACE[self.buffer]
        edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.inside = inside
        self.doc = np.searchsorted(self.text_start, self.start, "right") - 1
        self.first_word = np.searchsorted(self.doc, np.arange(len(texts)))
        self.n_words = np.bincount(self.doc, minlength=len(texts)) if texts else np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        sums = _sums(self.buffer.astype(np.uint64) + np.uint64(1), _BYTE_BASE)
        _, inverse = _power_tables(_BYTE_BASE, len(self.buffer))
        return mix64((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def run_hashes(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of ``n`` words within one text, and the runs' hashes."""
        hashes = self.hashes() if hashes is None else hashes
        if len(hashes) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[: len(hashes) - n + 1] == self.doc[n - 1 :])
        sums = _sums(hashes, _WORD_BASE)
        _, inverse = _power_tables(_WORD_BASE, len(hashes))
        return first, mix64((sums[first + n] - sums[first]) * inverse[first])


def covered(n_words: int, first: np.ndarray, length: int) -> np.ndarray:
    """Marks the words that a run of ``length`` words starting at one of ``first`` covers."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, np.minimum(first + length, n_words), -1)
    return np.cumsum(steps[:-1]) > 0


def portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive items of about ``most`` in total; an item beyond that stands alone."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, i
            begin = i
            total = 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)
