"""Word passages that repeat across documents, by prefix-partitioned suffix trees.

Suffixes of all documents, cut at WINDOW words, are the leaves. A suffix belongs to the group of its content-defined prefix: among the runs
of PREFIX_WORDS words inside its first WINDOW words, the one with the smallest hash. Equal suffixes have equal prefixes, so each group
can be handled alone; neighbouring suffixes mostly share theirs and travel as one segment of words. Only prefixes that occur in
more than one document go on, and of equal segments only the one in the smallest document does.

A group of usual size is sorted in memory by doubling depths (1, 2, 4, ... words), as a suffix tree is descended level by level: suffixes that
are alone in their class are leaves and leave; classes that reach WINDOW words are the deep internal nodes, the repeats. Groups above
GROUP_SEGMENTS segments are split by the longest prefix, all WINDOW words, and need only the smallest document of each, which Spark
combines before the shuffle. So neither a passage that a third of all documents hold nor its many variants meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffixes, tokens
from .scratch import semi, ship, written

WINDOW, PREFIX_WORDS = 50, 12


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tokens.string_bytes(batch.column("text"))
        ids, keys = batch.column("doc_id"), batch.column("key")
        for row, to in tokens.pieces(offsets):
            found = tokens.words(data, offsets[row : to + 1])
            s = suffixes.Segments(found, WINDOW, PREFIX_WORDS)
            rows = pa.array(s.doc + row)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(rows),
                    keys.take(rows),
                    pa.array(s.prefix.view(np.int64)),
                    pa.array(s.seg.view(np.int64)),
                    pa.array((s.low - found.first[s.doc]).astype(np.int32)),
                    pa.array((s.high - s.low).astype(np.int32)),
                ],
                names=["doc_id", "key", "prefix", "seg", "low", "n"],
            )


def _wanted_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of those segments that are listed with their document, as 32-bit word codes."""
    for batch in batches:
        data, offsets = tokens.string_bytes(batch.column("text"))
        lists = batch.column("segs")
        for row, to in tokens.pieces(offsets):
            part = lists.slice(row, to - row)
            values = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            s = suffixes.Segments(tokens.words(data, offsets[row : to + 1]), WINDOW, PREFIX_WORDS)
            # One document's list may name a segment that another has too: compare (document, segment).
            owner = np.repeat(np.arange(to - row), part.value_lengths().to_numpy(zero_copy_only=False))
            named = np.unique(tokens.mix(values + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            own = tokens.mix(s.seg + s.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, once = np.unique(own, return_index=True)
            keep = once[np.isin(own[once], named)]
            raw = [s.codes[a : b + WINDOW - 1].tobytes() for a, b in zip(s.low[keep].tolist(), s.high[keep].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(s.doc[keep] + row)),
                    pa.array(s.prefix[keep].view(np.int64)),
                    pa.array(s.seg[keep].view(np.int64)),
                    pa.array(raw, pa.binary()),
                ],
                names=["doc_id", "prefix", "seg", "codes"],
            )


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix ranges of segments whose words also begin in a smaller document; rows come sorted by prefix."""
    for table in suffixes.whole_groups(batches):
        codes, first = suffixes.code_rows(table.column("codes").combine_chunks())
        at, segment, node = suffixes.deep_nodes(table.column("prefix").to_numpy(), codes, first, WINDOW)
        doc = table.column("doc_id").to_numpy()[segment]
        lowest = np.full(int(node.max(initial=0)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, node, doc)
        again = doc > lowest[node]
        segment, offset = segment[again], at[again] - first[segment[again]]
        opens = np.ones(len(segment), bool)
        opens[1:] = (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1)
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], len(segment))[: len(begin)] - 1
        yield pa.RecordBatch.from_arrays(
            [
                table.column("seg").combine_chunks().take(pa.array(segment[begin])),
                pa.array(offset[begin].astype(np.int32)),
                pa.array((offset[end] + 1).astype(np.int32)),
            ],
            names=["seg", "from", "to"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, removed, texts = [], [], []
        for text, low, high in zip(batch.column("text").to_pylist(), batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
            found = (text or "").encode().split()
            total = len(found)
            if low:
                gone = np.zeros(total + 1, np.int32)
                np.add.at(gone, np.array(low), 1)
                np.add.at(gone, np.array(high), -1)
                gone = np.cumsum(gone[:-1]) > 0
                found = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
            n_words.append(total)
            removed.append(total - len(found))
            texts.append(b" ".join(found).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text"],
        )


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, key, low, high): word ranges covered by windows that also start in a document with a smaller doc_id. key is the text's hash."""
    ship(docs.sparkSession)
    docs = docs.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("key"))
    marks = written(docs.mapInArrow(_marks, "doc_id long, key long, prefix long, seg long, low int, n int"), "marks")
    groups = marks.groupBy("prefix").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("seg").alias("s"), F.max("seg").alias("t"))
    # Sides of joins on hot prefixes and windows are written first: Spark can then split the large side where it is skewed.
    groups = written(groups.filter("a < b").select("prefix", (F.col("s") != F.col("t")).alias("varied")), "groups")
    held = written(marks.join(groups, "prefix"), "held")
    firsts = written(held.groupBy("prefix", "seg", "varied").agg(F.min("doc_id").alias("doc_id")), "firsts")

    varied = firsts.filter("varied").select("prefix", "seg", "doc_id")
    asked = written(varied.groupBy("doc_id").agg(F.collect_set("seg").alias("segs")), "asked")
    texts = semi(docs.select("doc_id", "text"), asked.select("doc_id"), "doc_id").join(asked, "doc_id")
    leaves = texts.mapInArrow(_wanted_segments, "doc_id long, prefix long, seg long, codes binary")
    leaves = written(leaves, "leaves")
    large = leaves.groupBy("prefix").agg(F.count(F.lit(1)).alias("segments")).filter(F.col("segments") > suffixes.GROUP_SEGMENTS).select("prefix")
    usual = leaves.join(large, "prefix", "left_anti").repartition("prefix").sortWithinPartitions("prefix")
    repeats = usual.mapInArrow(_trees, "seg long, from int, to int")
    deep = written(leaves.join(large, "prefix", "left_semi").mapInArrow(suffixes.long_prefixes(WINDOW, ["doc_id", "seg"]), "doc_id long, seg long, long long, at int"), "deep")
    lowest = deep.groupBy("long").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("long", "low")
    lowest = written(lowest, "lowest")
    again = deep.join(lowest, "long").filter("doc_id > low").select("seg", F.col("at").alias("from"), (F.col("at") + 1).alias("to"))
    repeats = written(repeats.union(again), "repeats")

    placed = held.join(firsts.select("seg", F.col("doc_id").alias("first")), "seg")
    copies = placed.filter("doc_id > first").select("doc_id", "key", "low", (F.col("low") + F.col("n") + WINDOW - 1).alias("high"))
    own = placed.filter("doc_id = first").join(repeats, "seg")
    own = own.select("doc_id", "key", (F.col("low") + F.col("from")).alias("low"), (F.col("low") + F.col("to") + WINDOW - 1).alias("high"))
    return copies.union(own)


def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents without passages of WINDOW words that a document with a smaller doc_id holds too.

    docs needs doc_id (long) and text; other columns are ignored. Result, one row per row of docs: doc_id, n_words, n_removed, kept_text (kept
    words joined by one space). Every word of a window that also starts in a smaller document goes, windows being judged on the
    input. Null, empty and short texts lose nothing; rows without doc_id are neither cut nor a reason to cut; of equal doc_ids none is
    smaller, so rows that repeat one keep what they share. Equality of windows is equality of 50 32-bit word codes. An empty table gives an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = covered(docs).groupBy("doc_id", "key").agg(F.collect_list(F.struct("low", "high")).alias("r"))
    ranges = ranges.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), F.col("r.low").alias("low"), F.col("r.high").alias("high"))
    keyed = docs.withColumn("key", F.xxhash64("text"))
    joined = keyed.join(ranges, (F.col("doc_id") == F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    return joined.select("doc_id", "text", "low", "high").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")
