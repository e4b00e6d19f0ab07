"""Hashed words and character n-grams of many texts at once, on their UTF-8 bytes.

A batch's texts lie in one byte buffer, so hashes are a few numpy passes over it.
Words are runs of bytes other than the six ASCII white-space bytes; an n-gram is
n bytes that follow one another in one text.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Powers of an odd number: the weights of a byte's place in its word.
_ODD = 0x100000001B3
_PLACES = 256


def _powers() -> np.ndarray:
    out = np.empty(_PLACES, np.uint64)
    x = 1
    for i in range(_PLACES):
        out[i] = x
        x = x * _ODD & 0xFFFFFFFFFFFFFFFF
    return out


POWERS = _powers()


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column without nulls, and each text's bounds."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x * MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a buffer; bounds of texts must be white space or be cut later."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    solid = ~SPACE[data]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    return _hash_runs(data, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words(), parted where texts meet; and the number of words before each text's bounds."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    solid = ~SPACE[data]
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    before = np.concatenate([[False], solid[:-1]])
    before[inner] = False
    after = np.concatenate([solid[1:], [False]])
    after[inner - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    starts, ends, hashes = _hash_runs(data, starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, bounds, "left")


def _hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    sizes = ends - starts
    total = int(sizes.sum())
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    byte = data[place + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)
    if sizes.max() > _PLACES:  # beyond the table, places wrap and turn
        byte += np.uint64(7919) * (place // _PLACES).astype(np.uint64)
    byte *= POWERS[place % _PLACES]
    sums = np.add.reduceat(byte, np.cumsum(sizes) - sizes)
    return starts, ends, mixed(sums + sizes.astype(np.uint64))


def ngrams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n bytes (n is 3 or 4) that begin at each place but the last n - 1."""
    m = len(data) - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    x = data[:m].astype(np.uint32)
    for k in range(1, n):
        x |= data[k : m + k].astype(np.uint32) << np.uint32(8 * k)
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return (x >> np.uint32(32 - bits)).astype(np.int64)


class Features:
    """Buckets of words, of words that repeat the word before, and of n-grams, in one table of 3 << bits entries."""

    def __init__(self, bits: int, n: tuple[int, int] = (3, 4)):
        self.bits, self.n = bits, n
        self.size = 3 << bits
        #: One bucket for a word equal to the one before it: no hash is needed to see a repetition.
        self.repeat = 0

    def of(self, data: np.ndarray, bounds: np.ndarray):
        """(buckets, bounds by text) of words, then of each kind of n-gram."""
        _, _, hashes, cuts = words_of(data, bounds)
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        same[cuts[:-1][(cuts[:-1] < len(hashes))]] = False
        bucket[same] = self.repeat
        yield bucket, cuts
        for k, n in enumerate(self.n, 1):
            grams = ngrams(data, n, self.bits) + (k << self.bits)
            inside = np.ones(len(data), bool)
            for j in range(1, n):  # an n-gram lies in one text
                at = bounds[1:] - j
                inside[at[at >= 0]] = False
            ends = np.concatenate([[0], np.cumsum(inside)])[bounds]
            yield grams[inside[: len(grams)]], ends

    def averages(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
        """For each text the mean, over the kinds of feature, of the mean of the table's values.

        The table holds whole numbers (fixed point), so a sum does not depend on what else the batch holds.
        """
        out = np.zeros(len(bounds) - 1)
        for bucket, cuts in self.of(data, bounds):
            running = np.concatenate([[0], np.cumsum(table[bucket], dtype=np.int64)])
            out += (running[cuts[1:]] - running[cuts[:-1]]) / np.maximum(np.diff(cuts), 1)
        return out / (1 + len(self.n))

    def weights(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's buckets and their weights in averages()."""
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(bounds) - 1)]
        for bucket, cuts in self.of(data, bounds):
            for i in range(len(bounds) - 1):
                b, n = np.unique(bucket[cuts[i] : cuts[i + 1]], return_counts=True)
                parts[i].append((b.astype(np.int32), (n / (max(1, n.sum()) * (1 + len(self.n)))).astype(np.float32)))
        return [(np.concatenate([b for b, _ in p]), np.concatenate([w for _, w in p])) for p in parts]
