"""Ranked lexical search over documents with range-maximum sparse tables on posting lists.

One pass keeps, for the terms of all items, how often each document holds them; counts of documents and terms over all texts give weights and
length norms. Documents then come in shards, numbered by rising doc_id. A term's posting list holds its documents in a shard with their impacts and a sparse
table, which tells the position of the largest impact of any range of the list from two entries. An item's search keeps open intervals of
documents, best bound first: a bound sums, over the item's terms, the weighted largest impact within the interval, so no document of the
interval scores more. The interval with the highest bound gives up the document of its largest single contribution, which is scored exactly, and
falls into the intervals on either side. It ends when no bound can enter the best documents found so far, so results are exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .scratch import ship, written

BEST = 20
#: Documents and postings of a shard; a shard ends with the row that reaches either.
SHARD_ROWS, SHARD_POSTINGS = 16_384, 4_000_000
#: Bytes of items that travel to the tasks at a time; more items take one pass over the documents for each such part.
PART_BYTES = 8 << 20
#: Intervals taken from the queue at a time, at most; a search begins with one and doubles.
FRONT = 256
#: Length norm of a document of n terms: OFFSET + SLOPE * n / mean length, in hundredths.
OFFSET, SLOPE = 75, 25

# Letters and digits of ASCII and all bytes of other code points make terms; A-Z are folded, everything else separates.
_TERM = np.full(256, 32, np.uint8)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _TERM[_low:_high] = np.arange(_low, _high)
_TERM[65:91] += 32


def _terms(column: pa.Array) -> Iterator[tuple[int, tokens.Words]]:
    data, offsets = tokens.string_bytes(column)
    for row, to in tokens.pieces(offsets):
        yield row, tokens.words(_TERM[data[offsets[row] : offsets[to]]], offsets[row : to + 1] - offsets[row])


class Items:
    """The items of one part: their terms as places in one sorted list of term hashes, with repeats counted."""

    def __init__(self, ids: list, texts: list[str]):
        found = [f for _, f in _terms(pa.array(texts, pa.string()))]
        runs = [f.hash[a:b] for f in found for a, b in zip(f.first[:-1].tolist(), f.first[1:].tolist(), strict=True)]
        self.ids = ids
        self.terms = np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)
        each = [np.unique(r, return_counts=True) for r in runs]
        self.of_item = [(np.searchsorted(self.terms, t), n.astype(np.int64)) for t, n in each]
        self.marked = np.zeros(1 << 20, bool)
        self.marked[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are terms of an item, and their places."""
        likely = np.flatnonzero(self.marked[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(self.terms):
            return likely[:0], likely[:0]
        place = np.minimum(np.searchsorted(self.terms, hashes[likely]), len(self.terms) - 1)
        sure = self.terms[place] == hashes[likely]
        return likely[sure], place[sure]


def _postings(items: Items):
    """Per document: its number of terms, and the items' terms in it with their occurrences."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(len(items.terms), 1)
        for batch in batches:
            for row, found in _terms(batch.column("text")):
                n_docs = len(found.first) - 1
                at, place = items.places(found.hash)
                key, times = np.unique((np.searchsorted(found.first, at, "right") - 1) * width + place, return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(n_docs + 1) * width).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, n_docs),
                        pa.array(np.diff(found.first)),
                        pa.ListArray.from_arrays(ends, pa.array((key % width).astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "n", "terms", "times"],
                )

    return of_batches


class Shard:
    """Posting lists of some documents, one after another by term, with range-maximum sparse tables over their impacts."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int):
        order = np.lexsort((doc, term))
        self.n_docs = n_docs
        self.key = term[order].astype(np.int64) * n_docs + doc[order]
        self.doc, self.impact = doc[order], impact[order]
        # tables[k][i] is the position of the first largest impact among positions i to i + 2^k - 1.
        self.tables = [np.arange(len(order), dtype=np.int32)]
        longest = int(np.bincount(term).max()) if len(term) else 0
        while (2 << (len(self.tables) - 1)) <= longest:
            half = 1 << (len(self.tables) - 1)
            left, right = self.tables[-1][:-half], self.tables[-1][half:]
            self.tables.append(np.where(self.impact[right] > self.impact[left], right, left))
        self.table = np.zeros((len(self.tables), len(order)), np.int32)
        for k, own in enumerate(self.tables):
            self.table[k, : len(own)] = own

    def largest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the largest impacts in positions low:high, and the impacts; an empty range has impact 0."""
        some = high > low
        level = np.frexp(np.maximum(high - low, 1).astype(np.float64))[1] - 1
        low = np.where(some, low, 0)
        a, b = self.table[level, low], self.table[level, np.where(some, high - (1 << level), 0)]
        at = np.where(self.impact[b] > self.impact[a], b, a)
        return at, np.where(some, self.impact[at], 0)


class _Best:
    """The best documents found for an item: (score, doc_id) with equal scores by rising id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        worst = self.floor()[0]
        self.rows += [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if s >= worst and s > 0]
        self.rows = sorted(self.rows)[: self.k]

    def floor(self) -> tuple[int, float]:
        """The score and id that a further document has to beat."""
        return (-self.rows[-1][0], self.rows[-1][1]) if len(self.rows) >= self.k else (0, -math.inf)


def _search(shard: Shard, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: _Best) -> int:
    """Best-first search of one item in one shard; `ids` rise with the document number. Returns the number of documents scored."""
    low = np.searchsorted(shard.key, terms * shard.n_docs)
    high = np.searchsorted(shard.key, (terms + 1) * shard.n_docs)
    has = (high > low) & (weights > 0)
    terms, weights = terms[has], weights[has]
    if not len(terms):
        return 0
    lows, highs = low[has][None, :], high[has][None, :]
    firsts = np.zeros(1, np.int64)  # first document of each interval
    queue: list[tuple] = []
    ranges: list[tuple[np.ndarray, np.ndarray]] = []
    front, scored = 1, 0
    while True:
        # Bounds of new intervals, and the document at which each will be split: that of its largest contribution.
        at, impact = shard.largest(lows, highs)
        gain = impact * weights
        bound, split = gain.sum(1), shard.doc[at[np.arange(len(at)), gain.argmax(1)]]
        score, last = best.floor()
        open_ = np.flatnonzero((bound > score) | ((bound == score) & (bound > 0) & (ids[firsts] < last)))
        block = len(ranges)
        ranges.append((lows, highs))
        for i in open_.tolist():
            heapq.heappush(queue, (-int(bound[i]), int(firsts[i]), int(split[i]), block, i))
        taken = []
        while queue and len(taken) < front:
            b, first, cut, block, i = heapq.heappop(queue)
            if -b < score or (-b == score and ids[first] >= last):
                if -b < score:
                    queue.clear()
                    break
                continue
            taken.append((first, cut, block, i))
        if not taken:
            return scored
        front = min(2 * front, FRONT)
        scored += len(taken)
        low = np.stack([ranges[block][0][i] for _, _, block, i in taken])
        high = np.stack([ranges[block][1][i] for _, _, block, i in taken])
        cuts = np.array([cut for _, cut, _, _ in taken])
        place = np.searchsorted(shard.key, terms[None, :] * shard.n_docs + cuts[:, None])
        inside = place < high
        hit = inside & (shard.doc[np.minimum(place, len(shard.doc) - 1)] == cuts[:, None])
        scores = (np.where(hit, shard.impact[np.minimum(place, len(shard.doc) - 1)], 0) * weights).sum(1)
        best.add(scores, ids[cuts])
        lows, highs = np.concatenate([low, place + hit]), np.concatenate([np.minimum(place, high), high])
        firsts = np.concatenate([[first for first, _, _, _ in taken], np.minimum(cuts + 1, shard.n_docs - 1)])


class Ranker:
    """Weights of an item part's terms and the length norm, from counts over all documents."""

    def __init__(self, items: Items, n_docs: int, n_terms: int, df: np.ndarray, best: int = BEST):
        self.items, self.n_docs, self.n_terms, self.best = items, n_docs, n_terms, best
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def shard(self, n: np.ndarray, ends: np.ndarray, term: np.ndarray, times: np.ndarray) -> Shard:
        norm = OFFSET + (SLOPE * n * self.n_docs) // self.n_terms
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        tf = times.astype(np.int64)
        return Shard(doc, term, (1_000_000_000 * tf) // (1000 * tf + 12 * norm[doc]), len(n))

    def tasks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best documents of each item among a task's rows, shard by shard; what is found bounds the search of later shards."""
        best = [_Best(self.best) for _ in self.items.ids]
        held, rows, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(at, SHARD_ROWS)
                held.append(part)
                rows += part.num_rows
                postings += len(part.column("terms").flatten())
                if rows >= SHARD_ROWS or postings >= SHARD_POSTINGS:
                    self._search(pa.Table.from_batches(held), best)
                    held, rows, postings = [], 0, 0
        if held:
            self._search(pa.Table.from_batches(held), best)
        found = [(i, None if d == math.inf else int(d), -s) for i, b in enumerate(best) for s, d in b.rows]
        columns = list(zip(*found, strict=True)) if found else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    def _search(self, rows: pa.Table, best: list[_Best]) -> None:
        rows = rows.sort_by([("doc_id", "ascending")]).combine_chunks()
        ids = np.array([math.inf if d is None else d for d in rows.column("doc_id").to_pylist()], object)
        lists = [rows.column(c).chunk(0) if rows.column(c).num_chunks else pa.array([], pa.list_(pa.int32())) for c in ("terms", "times")]
        ends = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        shard = self.shard(rows.column("n").to_numpy(), ends, lists[0].flatten().to_numpy().astype(np.int64), lists[1].flatten().to_numpy())
        if len(shard.key):
            for i, (terms, repeats) in enumerate(self.items.of_item):
                _search(shard, ids, terms, self.weights[terms] * repeats, best[i])


def _parts(items: DataFrame) -> Iterator[Items]:
    """Parts of the items of about PART_BYTES each; together they hold all items with a text."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = -(-total // PART_BYTES)
    for part in range(n_parts):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(n_parts)) == part).orderBy("item_id", "text").collect()
        if own:
            yield Items([r["item_id"] for r in own], [r["text"] for r in own])


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the `best` highest-scoring documents of every item, score above 0, equal scores by rising doc_id.

    docs needs doc_id and text, items item_id and text; other columns are ignored. Terms are runs of ASCII letters and digits and of all code points
    beyond ASCII, A-Z lower-cased, of whole texts. Null and empty texts have no terms: such documents do not count and such items
    have no rows. Every row of items is an item of its own, ranked from 1, also if it shares an item_id; a null item_id stays null. Every row of
    docs is a document, also if it repeats a doc_id; a null doc_id ranks last among equal scores. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in _parts(items):
        index = docs.mapInArrow(_postings(part), "doc_id long, n long, terms array<int>, times array<int>").filter("n > 0")
        index = written(index, "postings")
        whole = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        df = np.zeros(len(part.terms), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        if not whole["docs"]:
            continue
        ranker = Ranker(part, whole["docs"], whole["terms"], df, best)
        found = index.filter(F.size("terms") > 0).mapInArrow(ranker.tasks, "item int, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
        names = spark.createDataFrame(list(enumerate(part.ids)), "item int, item_id long")
        result = result.union(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return result
