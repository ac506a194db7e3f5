"""Prefix-partitioned suffixes of token streams: the parts that the operators on repeated passages share.

A suffix, cut at `window` words, belongs to the group of its content-defined prefix: among the runs of `prefix_words` words inside it, the one with
the smallest hash. Equal suffixes have equal prefixes, so groups can be handled one by one; neighbouring suffixes mostly share theirs and
travel as one segment of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .scratch import written

#: Segments of a prefix group that one task sorts in memory; larger groups take the longest prefix, the whole window, instead.
GROUP_SEGMENTS = 4096
#: Segments sorted together, in whole groups.
BUFFER_SEGMENTS = 8192


class Segments:
    """Segments of some documents: rows of one document share `doc`; suffix starts are words low:high, the words are low:high + window - 1."""

    def __init__(self, found: tokens.Words, window: int, prefix_words: int):
        span = window - prefix_words + 1
        runs = tokens.grams(found.hash, prefix_words)
        lengths = np.diff(found.first)
        self.lengths = lengths
        self.codes = (found.hash >> np.uint64(32)).astype(np.uint32)
        empty = np.zeros(0, np.int64)
        self.doc = self.low = self.high = self.anchor = empty
        self.prefix = self.seg = np.zeros(0, np.uint64)
        if len(runs) < span:
            return
        value, place, width = runs, np.arange(len(runs)), 1
        while width < span:
            step = min(width, span - width)
            left, right = value[: len(value) - step], value[step:]
            later = right < left
            value = np.where(later, right, left)
            place = np.where(later, place[step:], place[: len(place) - step])
            width += step
        starts = np.repeat(found.first[:-1], np.maximum(lengths - window + 1, 0))
        if not len(starts):
            return
        counts = np.maximum(lengths - window + 1, 0)
        within = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
        suffix = starts + within
        doc = np.repeat(np.arange(len(lengths)), counts)
        anchor = place[suffix]
        opens = np.ones(len(suffix), bool)
        opens[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(opens)
        self.doc, self.low, self.anchor = doc[at], suffix[at], anchor[at]
        self.high = suffix[np.append(at[1:], len(suffix)) - 1] + 1
        self.prefix = runs[self.anchor]
        self.seg = tokens.mix(tokens.run_hashes(found.hash, self.low, self.high + window - 1) + (self.anchor - self.low).astype(np.uint64))


def code_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All word codes of a binary column and the first code of each row."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(np.uint32) if len(raw) else np.zeros(0, np.uint32), (offsets - offsets[0]) // 4


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole prefix groups from rows that come sorted by prefix."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < BUFFER_SEGMENTS:
            continue
        table = pa.Table.from_batches(held)
        prefixes = table.column("prefix").to_numpy()
        changes = np.flatnonzero(prefixes[1:] != prefixes[:-1]) + 1
        done = 0
        while len(changes) and changes[-1] > done:
            to = int(changes[max(np.searchsorted(changes, done + BUFFER_SEGMENTS, "right") - 1, np.searchsorted(changes, done, "right"))])
            yield table.slice(done, to - done).combine_chunks()
            done = to
        held = table.slice(done).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def deep_nodes(prefix: np.ndarray, codes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of some segments by the node that they reach at depth `window`: (position in codes, segment, node).

    codes[first[i]:first[i + 1]] are the words of segment i. Depths double, as in prefix doubling of suffix arrays: the rank of 2d words is
    that of the pair of ranks of d words. The ranks start from (prefix, word), so groups never mix; shorter suffixes are left out.
    """
    lengths = np.diff(first)
    segment = np.repeat(np.arange(len(lengths)), lengths)
    room = first[1:][segment] - np.arange(len(codes))
    _, group = np.unique(prefix, return_inverse=True)
    _, word = np.unique(codes, return_inverse=True)
    rank = group[segment].astype(np.int64) * (int(word.max(initial=0)) + 1) + word
    _, rank = np.unique(rank, return_inverse=True)
    depth = 1
    while depth < window:
        step = min(depth, window - depth)
        at = np.flatnonzero(room >= depth + step)
        _, deeper = np.unique(rank[at].astype(np.int64) * (int(rank.max(initial=0)) + 1) + rank[at + step], return_inverse=True)
        rank = np.zeros(len(codes), np.int64)
        rank[at] = deeper
        depth += step
    at = np.flatnonzero(room >= window)
    return at, segment[at], rank[at]


def _leaves(window: int, prefix_words: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.string_bytes(batch.column("text"))
            space = tokens.mix(batch.column("space").to_numpy().view(np.uint64))
            for row, to in tokens.pieces(offsets):
                found = tokens.words(data, offsets[row : to + 1])
                s = Segments(found, window, prefix_words)
                prefix = tokens.mix(s.prefix + space[row + s.doc]) if len(s.doc) else s.prefix
                raw = [s.codes[a : b + window - 1].tobytes() for a, b in zip(s.low.tolist(), s.high.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(s.doc + row)),
                        pa.array(prefix.view(np.int64)),
                        pa.array((s.low - found.first[s.doc]).astype(np.int32)),
                        pa.array(raw, pa.binary()),
                    ],
                    names=["id", "prefix", "low", "codes"],
                )

    return of_batches


def _on_many(window: int, pages: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            codes, first = code_rows(table.column("codes").combine_chunks())
            at, segment, node = deep_nodes(table.column("prefix").to_numpy(), codes, first, window)
            ids = table.column("id").to_numpy()[segment]
            order = np.lexsort((ids, node))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (node[order][1:] != node[order][:-1]) | (ids[order][1:] != ids[order][:-1])
            often = np.bincount(node[order][fresh], minlength=int(node.max(initial=0)) + 1)[node] >= pages
            low = table.column("low").to_numpy()[segment] + (at - first[segment])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[often]), pa.array(low[often].astype(np.int32)), pa.array((low[often] + window).astype(np.int32))], names=["id", "low", "high"]
            )

    return of_batches


def long_prefixes(window: int, keep: list[str]):
    """Every suffix of the segments of a batch with the hash of its prefix group and all its words, and its offset in the segment."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, first = code_rows(batch.column("codes"))
            counts = np.diff(first) - window + 1
            owner = np.repeat(np.arange(len(counts)), counts)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = first[:-1][owner] + offset
            group = batch.column("prefix").to_numpy().view(np.uint64)[owner]
            long = tokens.mix(tokens.run_hashes(tokens.mix(codes.astype(np.uint64)), start, start + window) + tokens.mix(group)).view(np.int64)
            for low in range(0, len(owner), 100_000):
                part = slice(low, low + 100_000)
                rows = pa.array(owner[part])
                columns = [batch.column(c).take(rows) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(long[part]), pa.array(offset[part].astype(np.int32))], names=[*keep, "long", "at"])

    return of_batches


def repeated(streams: DataFrame, window: int, prefix_words: int, pages: int) -> DataFrame:
    """(id, low, high): word ranges of streams (id, space, text) that lie on at least `pages` distinct ids of their space."""
    leaves = written(streams.mapInArrow(_leaves(window, prefix_words), "id long, prefix long, low int, codes binary"), "leaves")
    groups = leaves.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    groups = groups.filter((F.col("n") >= pages) & (F.col("a") < F.col("b"))).select("prefix", "n")
    leaves = written(leaves.join(written(groups, "groups"), "prefix"), "grouped")
    usual = leaves.filter(F.col("n") <= GROUP_SEGMENTS).drop("n").repartition("prefix").sortWithinPartitions("prefix")
    found = usual.mapInArrow(_on_many(window, pages), "id long, low int, high int")
    large = leaves.filter(F.col("n") > GROUP_SEGMENTS).mapInArrow(long_prefixes(window, ["id", "low"]), "id long, low int, long long, at int")
    large = written(large, "long")
    often = large.select("long", "id").distinct().groupBy("long").count().filter(F.col("count") >= pages).select("long")
    more = large.join(often, "long").select("id", (F.col("low") + F.col("at")).alias("low"), (F.col("low") + F.col("at") + window).alias("high"))
    return found.union(more)
