"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted shingle similarity.

For every benchmark item of L words, windows of L consecutive words of each document are compared with it; a document of fewer words is its one
window, compared by shared shingles with every longer item that its size can match. A window and an item without a common shingle have similarity 0:
postings of shingles name the pairs that share one, and windows of these get a fingerprint. A shingle weighs as often as it occurs, in the fingerprint
and in the similarity. Fingerprints are cut into BLOCKS blocks: within RADIUS bits some block differs by at most RADIUS // BLOCKS bits, and an index per
block marks the items for each block value within that distance, so no item within the radius is missed. A pair has to stand in the postings and
in a block of the index; windows are taken WINDOWS and pairs about PAIRS at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .scratch import ship
from .whole import keep_rows

SHINGLE_WORDS = 5
#: 64-bit fingerprints of windows at a weighted Jaccard similarity of 0.8 differ in 9.7 bits on average with a deviation of 2.9, so a
#: pair at the limit lies outside this radius with a chance below 1e-5; equal windows have distance 0.
RADIUS, BLOCKS = 23, 8
#: Benchmark bytes that travel to the tasks at a time; a larger benchmark takes one pass over the documents for each such part.
PART_BYTES = 8 << 20
#: Windows of a document, and pairs of windows and items, that are held at a time.
WINDOWS, PAIRS = 1 << 14, 1 << 20


def _near_values() -> list[list[int]]:
    """For each 8-bit value, the values within RADIUS // BLOCKS bits."""
    flips = [sum(1 << i for i in c) for n in range(RADIUS // BLOCKS + 1) for c in itertools.combinations(range(64 // BLOCKS), n)]
    return [[v ^ f for f in flips] for v in range(1 << (64 // BLOCKS))]


def fingerprints(shingles: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the runs of `size` shingles that begin at `start`."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    total = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    return np.packbits(total[start + size] - total[start] > 0, axis=1).view(np.uint64)[:, 0]


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges low:high, one after the other."""
    n = high - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of things of these sizes, each of one thing or of at most `most` in all."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        to = max(int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")), at + 1)
        yield slice(at, to)
        at = to


def _sharing(postings: tuple, shingles: np.ndarray, hit: np.ndarray, size: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (window, item) that share a shingle at a position of `hit`, in parts; windows of `size` shingles that begin in low:high."""
    theirs, _, owner = postings
    left, right = (np.searchsorted(theirs, shingles[hit], side) for side in ("left", "right"))
    for part in _parts(right - left, PAIRS):
        item = owner[_ranges(left[part], right[part])]
        at = np.repeat(hit[part], (right - left)[part])
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        # A shingle brings the windows that begin after the one before it of the same item.
        begin = np.maximum(at - size + 1, low)
        begin[1:] = np.where(item[1:] == item[:-1], np.maximum(begin[1:], at[:-1] + 1), begin[1:])
        end = np.maximum(np.minimum(at + 1, high), begin)
        for few in _parts(end - begin, PAIRS):
            window = _ranges(begin[few], end[few])
            if len(window):
                yield window, np.repeat(item[few], (end - begin)[few])


class Index:
    """The items of one part, by their number of words."""

    def __init__(self, ids: list, texts: list[str]):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        found = tokens.words(np.frombuffer(b"".join(raw), np.uint8), offsets, lower=True)
        self.by_length: dict[int, dict] = {}
        near = _near_values()
        every = []
        for i, (low, high) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
            if high == low:
                continue
            k = min(SHINGLE_WORDS, high - low)
            shingles = tokens.grams(found.hash[low:high], k)
            of = self.by_length.setdefault(high - low, {"ids": [], "prints": [], "sets": []})
            of["ids"].append(ids[i])
            of["prints"].append(fingerprints(shingles, np.zeros(1, np.int64), len(shingles))[0])
            of["sets"].append(np.unique(shingles, return_counts=True))
            every.append((k, shingles))
        for of in self.by_length.values():
            owner = np.repeat(np.arange(len(of["sets"])), [len(s) for s, _ in of["sets"]])
            shingles, weights = (np.concatenate(c) for c in zip(*of["sets"], strict=True))
            order = np.argsort(shingles, kind="stable")
            of["postings"] = shingles[order], weights[order], owner[order]
            of["prints"] = np.array(of["prints"], np.uint64)
            of["blocks"] = []
            values = of["prints"].view(np.uint8).reshape(-1, 8)
            for b in range(BLOCKS):
                listed = np.zeros((256, len(of["ids"]) + 7 >> 3), np.uint8)
                for i, v in enumerate(values[:, b].tolist()):
                    listed[near[v], i >> 3] |= np.uint8(1 << (i & 7))
                of["blocks"].append(listed)
        #: For each shingle size the shingles in order, and where each one's item lengths are in a list of them.
        self.known: dict[int, np.ndarray] = {}
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.marked: dict[int, np.ndarray] = {}
        for k in {n for n, _ in every}:
            own = [(np.unique(of["postings"][0]), length) for length, of in self.by_length.items() if min(SHINGLE_WORDS, length) == k]
            shingles = np.concatenate([s for s, _ in own])
            order = np.argsort(shingles, kind="stable")
            self.known[k], first = np.unique(shingles[order], return_index=True)
            self.lengths[k] = np.append(first, len(order)), np.repeat([n for _, n in own], [len(s) for s, _ in own])[order]
            self.marked[k] = np.zeros(1 << 20, bool)
            self.marked[k][(self.known[k] >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, shingles: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that some item has, and the places of these among the known ones."""
        likely = np.flatnonzero(self.marked[k][(shingles >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.known[k], shingles[likely]), len(self.known[k]) - 1)
        sure = self.known[k][place] == shingles[likely]
        return likely[sure], place[sure]

    def lengths_of(self, k: int, known: np.ndarray) -> list[int]:
        """Lengths of the items that have one of these known shingles."""
        first, lengths = self.lengths[k]
        return np.unique(lengths[_ranges(first[known], first[known + 1])]).tolist()

    def matches(self, hashes: np.ndarray, of: dict, length: int, hit: np.ndarray, percent: int) -> Iterator[tuple]:
        """(item, similarity, first word, words, distance) for windows of one document's words that hold a shingle at `hit`."""
        k = min(SHINGLE_WORDS, length)
        size = length - k + 1
        last = len(hashes) - length
        if last < 0:
            if len(hit):
                yield from self.short_matches(hashes, of, k, size, percent)
            return
        shingles = tokens.grams(hashes, k)
        for low in range(0, last + 1, WINDOWS):
            high = min(low + WINDOWS, last + 1)
            inside = hit[np.searchsorted(hit, low) : np.searchsorted(hit, high + size - 1)]
            prints = None
            for window, item in _sharing(of["postings"], shingles, inside, size, low, high):
                if prints is None:
                    start = np.arange(high - low)
                    prints = fingerprints(shingles[low : high + size - 1], start, size)
                for w, i, d in self.close(of, prints, window - low, item):
                    at = low + w
                    own, count = np.unique(shingles[at : at + size], return_counts=True)
                    theirs, weights = of["sets"][i]
                    place = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
                    both = int(np.minimum(count, weights[place])[theirs[place] == own].sum())
                    if both * 100 >= percent * (2 * size - both):
                        yield of["ids"][i], both / (2 * size - both), at, length, d

    def close(self, of: dict, prints: np.ndarray, window: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) of the pairs that the block index lists and that lie within the radius."""
        values = prints.view(np.uint8).reshape(-1, 8)
        byte, bit = item >> 3, (item & 7).astype(np.uint8)
        listed = np.zeros(len(item), np.uint8)
        for b in range(BLOCKS):
            listed |= of["blocks"][b][values[window, b], byte] >> bit
        window, item = window[listed & 1 == 1], item[listed & 1 == 1]
        distance = np.bitwise_count(prints[window] ^ of["prints"][item])
        close = distance <= RADIUS
        yield from zip(window[close].tolist(), item[close].tolist(), distance[close].tolist(), strict=True)

    def short_matches(self, hashes: np.ndarray, of: dict, k: int, size: int, percent: int) -> Iterator[tuple]:
        """The same for a document of fewer words than the items, as one window. One window needs no search: all items that share a shingle are compared."""
        own_size = len(hashes) - k + 1
        if own_size * 100 < percent * size:  # all that it has is not enough
            return
        shingles = tokens.grams(hashes, k)
        own, count = np.unique(shingles, return_counts=True)
        theirs, weights, owner = of["postings"]
        low, high = np.searchsorted(theirs, own, "left"), np.searchsorted(theirs, own, "right")
        n = high - low
        place = _ranges(low, high)
        shared = np.bincount(owner[place], np.minimum(np.repeat(count, n), weights[place]), len(of["ids"])).astype(np.int64)
        near = np.flatnonzero((shared > 0) & (shared * 100 >= percent * (own_size + size - shared)))
        if len(near):
            prints = fingerprints(shingles, np.zeros(1, np.int64), own_size)
            distance = np.bitwise_count(prints[0] ^ of["prints"][near])
            for i, d in zip(near.tolist(), distance.tolist(), strict=True):
                both = int(shared[i])
                yield of["ids"][i], both / (own_size + size - both), 0, len(hashes), d


def _islands(hit: np.ndarray, reach: int) -> list[np.ndarray]:
    """Runs of hits with gaps below `reach`."""
    return np.split(hit, np.flatnonzero(np.diff(hit) > reach) + 1) if len(hit) else []


def _row_matches(index: Index, percent: int, column: pa.Array) -> Iterator[tuple]:
    """(row, item, similarity, first word, words, distance): the best window of each item for each text of a batch."""
    longest = max(index.by_length, default=0)
    data, offsets = tokens.string_bytes(column)
    for row, to in tokens.pieces(offsets):
        found = tokens.words(data, offsets[row : to + 1], lower=True)
        best: dict[tuple, tuple] = {}
        for k in index.known:
            hit, known = index.hits(tokens.grams(found.hash, k), k)
            doc = np.searchsorted(found.first, hit, "right") - 1
            inside = hit + k <= found.first[doc + 1]
            hit, known, doc = hit[inside], known[inside], doc[inside]
            ends = np.searchsorted(doc, np.arange(to - row + 1))
            for d in np.flatnonzero(np.diff(ends)).tolist():
                low, high = int(found.first[d]), int(found.first[d + 1])
                own = known[ends[d] : ends[d + 1]]
                for island in _islands(hit[ends[d] : ends[d + 1]] - low, longest):
                    left = max(0, int(island[0]) - longest)
                    part = found.hash[low + left : min(high, low + int(island[-1]) + longest + 1)]
                    for length in index.lengths_of(k, own[: len(island)]):
                        for item, like, at, words, bits in index.matches(part, index.by_length[length], length, island - left, percent):
                            best[d, item] = max(best.get((d, item), (0,)), (like, -(left + at), words, bits))
                    own = own[len(island) :]
        for (d, item), (like, at, length, bits) in best.items():
            yield row + d, item, like, -at, length, bits


def _search(index: Index, percent: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "similarity", "first_word", "n_words", "distance"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int32()]
        for batch in batches:
            ids = batch.column("doc_id")
            rows = [(ids[row].as_py(), *rest) for row, *rest in _row_matches(index, percent, batch.column("text"))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return of_batches


def _indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of parts of the benchmark of about PART_BYTES each; together they hold all items."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("trim(text) <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = -(-total // PART_BYTES)
    for part in range(n_parts):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(n_parts)) == part).orderBy("item_id", "text").collect()
        if own:
            yield Index([r["item_id"] for r in own], [r["text"] for r in own])


def contamination(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """Documents that hold a benchmark item: one row per (doc_id, item_id), with the most similar window.

    docs needs doc_id and text, items item_id and text; other columns are ignored. Result: doc_id, item_id, similarity, first_word, n_words (the
    window), distance (of the fingerprints). Words are lower-cased (A-Z); shingles have five words, items with fewer words are one shingle as a
    whole. A document of fewer words than an item is one window. A window matches when its weighted Jaccard similarity reaches percent / 100; of equal windows the first counts. Null, empty
    and blank texts and items match nothing, rows without doc_id are reported without it. Items that share an item_id are all searched; the
    best counts. Rows that repeat a doc_id give a row each. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words int, distance int"
    result = spark.createDataFrame([], schema)
    for index in _indexes(items):
        result = result.union(docs.mapInArrow(_search(index, percent), schema))
    return result


def clean(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found as `contamination` finds it."""
    for index in _indexes(items):
        docs = keep_rows(docs, partial(_without_matches, index, percent))
    return docs


def _without_matches(index: Index, percent: int, text: pa.Array) -> np.ndarray:
    keep = np.ones(len(text), bool)
    keep[[row for row, *_ in _row_matches(index, percent, text)]] = False
    return keep
