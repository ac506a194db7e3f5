"""Word positions and word hashes of Arrow string batches in numpy.

A word is a longest run of bytes other than space and 0x09-0x0D, which is the same in bytes and in code points of UTF-8. Words are named
by 64-bit hashes: two different words share one with chance 2^-64, and all comparisons of shingle sets are on such hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer document is handled alone, in pieces cut at white space.
PIECE_BYTES = 1 << 20
#: Bytes whose words are hashed at a time, so that the sums of their bytes stay in a processor's cache.
HASH_BYTES = 1 << 16

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 20)) | np.uint64(1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """Words of some documents: word w is bytes start[w]:end[w]; document d has words first[d]:first[d + 1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about `size` bytes, of one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        to = min(max(to, row + 1), n)
        yield row, to
        row = to


def _hash_run(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _tables(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the documents data[offsets[d]:offsets[d + 1]]; `lower` folds A-Z before hashing."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    solid = (data != 32) & (data - np.uint8(9) > 4)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), data)
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner] = solid[inner]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    closes[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    folded = data | ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)) if lower else data
    hashes = byte_hashes(folded, start, end, HASH_BYTES)
    return Words(hashes, start, end, np.searchsorted(start, offsets).astype(np.int64), data)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; runs over a document's end are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, factor in enumerate(seeds(k, 7)):
        total += hashes[i : i + n] * factor
    return mix(total)


def shingle_sets(found: Words, k: int) -> list[np.ndarray]:
    """Per document its sorted distinct k-word shingles; fewer words make one shingle, none make none."""
    runs = grams(found.hash, k)
    sets = []
    for low, high in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if high - low >= k:
            sets.append(np.unique(runs[low : high - k + 1]))
        elif high > low:
            sets.append(mix(grams(found.hash[low:high], high - low) + np.uint64(high - low)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def run_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word runs start:end of any lengths."""
    up, down = _tables(len(hashes) + 1)
    total = np.empty(len(hashes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int = PIECE_BYTES) -> np.ndarray:
    """Hashes of the byte runs start:end, which are in order if the data are more than about `size` bytes; the hash of a word's bytes is the word's hash."""
    if len(data) <= 2 * size or not len(start):
        return _hash_run(data, start, end)
    parts, at = [], 0
    while at < len(start):
        to = max(int(np.searchsorted(end, start[at] + size, "right")), at + 1)
        parts.append(_hash_run(data[start[at] : end[to - 1]], start[at:to] - start[at], end[at:to] - start[at]))
        at = to
    return np.concatenate(parts)
