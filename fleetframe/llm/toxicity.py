"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

A bounded sample of labelled rows gives the examples. Terms are all their words (lower-cased letter runs), and beginnings of PREFIXES bytes of longer words where these go
with a label. A term weighs (1 + ln times) * ln(1 + documents / documents with it), counted over all documents, times its tie to the labels: from PLAIN
for a term without one to 1. So a rare toxic word that a few examples share counts, ordinary words count little but tell copies. A word that stands in no
example counts in the length of a text like an untied term of one document. The index keeps, per term and block of examples, the postings and their
maximum weight. A query adds the maxima into an upper bound per block; blocks whose bound cannot beat the k-th best cosine are not scored, so the neighbours are
exact. Neighbours vote by 1 / (1 - cosine + SOFT), weighted back to the label shares of all labelled rows; a logistic curve fitted on drawn rows that are no
examples turns votes into scores. A curve knows nothing of copies, so examples at cosine 1 add their own labels to it, SAME times each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .scratch import ship, written
from .whole import keep_rows

#: Labelled rows of each label that are drawn as examples (those with the smallest hash of doc_id): the bound of the fit.
EXAMPLES = 2000
#: One of so many drawn rows only calibrates: it is neither an example nor counted for the choice of terms.
CALIBRATE = 4
#: Weight of a term without a tie to the labels; the chi-square with the label from which a term counts in full, and that a beginning needs to be a term.
PLAIN, FULL_CHI, PREFIX_CHI = 0.1, 12.0, 6.0
#: Bytes of a word's beginning that are terms as well.
PREFIXES = (5, 7)
NEIGHBOURS, BLOCK, SOFT, RIDGE = 15, 64, 0.05, 1e-4
#: An example with the very terms of a text counts this many times as much as the calibrated vote.
SAME = 4.0

_LETTERS = np.full(256, 32, np.uint8)
for _low, _high in ((65, 91), (97, 123), (128, 256)):
    _LETTERS[_low:_high] = np.arange(_low, _high)
_LETTERS[65:91] += 32


def _terms(column: pa.Array) -> Iterator[tuple[int, tokens.Words]]:
    data, offsets = tokens.string_bytes(column)
    for row, to in tokens.pieces(offsets):
        yield row, tokens.words(_LETTERS[data[offsets[row] : offsets[to]]], offsets[row : to + 1] - offsets[row])


def _all_terms(found: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes and the words that they come from: every word, and the prefixes of longer ones."""
    terms, word = [found.hash], [np.arange(len(found.hash))]
    for n in PREFIXES:
        longer = np.flatnonzero(found.end - found.start > n)
        start = found.start[longer]
        terms.append(tokens.mix(tokens.byte_hashes(found.data, start, start + n) + np.uint64(n)))
        word.append(longer)
    return np.concatenate(terms), np.concatenate(word)


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: terms, the number of rows that hold them and how many of those are toxic."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for row, found in _terms(batch.column("text")):
            all_terms, word = _all_terms(found)
            terms, whole = np.unique(all_terms, return_inverse=True)
            inverse = whole
            n_docs = len(found.first) - 1
            pairs = np.unique(inverse * n_docs + np.searchsorted(found.first, word, "right") - 1) if n_docs else inverse
            inverse = pairs // max(n_docs, 1)
            bad = np.bincount(inverse, weights=toxic[row + pairs % max(n_docs, 1)], minlength=len(terms)).astype(np.int64)
            n = np.bincount(inverse, minlength=len(terms)).astype(np.int64)
            word = np.zeros(len(terms), bool)
            word[whole[: len(found.hash)]] = True
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n), pa.array(bad), pa.array(word)], names=["term", "n", "bad", "word"])


class Vocabulary:
    """Terms by hash; `counts` gives (document, term, times) of word runs."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms.astype(np.uint64))
        self.marked = np.zeros(1 << 22, bool)
        self.marked[(self.terms >> np.uint64(42)).astype(np.int64)] = True

    def counts(self, found: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, times), sorted."""
        return self._counts(found)[:3]

    def _counts(self, found: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hashes, word = _all_terms(found)
        n = len(self.terms)
        likely = np.flatnonzero(self.marked[(hashes >> np.uint64(42)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.terms, hashes[likely]), max(n - 1, 0))
        sure = self.terms[place] == hashes[likely] if n else np.zeros(len(likely), bool)
        likely, place = likely[sure], place[sure]
        key, times = np.unique((np.searchsorted(found.first, word[likely], "right") - 1) * max(n, 1) + place, return_counts=True)
        strange = np.ones(len(found.hash), bool)
        strange[likely[likely < len(found.hash)]] = False
        return key // max(n, 1), key % max(n, 1), times, np.flatnonzero(strange)

    def counts_and_strangers(self, found: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same, and per document the sum of (1 + ln times) squared over its words that are no terms."""
        doc, term, times, strange = self._counts(found)
        of = np.searchsorted(found.first, strange, "right") - 1
        _, first, n = np.unique(tokens.mix(found.hash[strange] ^ tokens.mix(of.astype(np.uint64))), return_index=True, return_counts=True)
        return doc, term, times, np.bincount(of[first], (1 + np.log(n)) ** 2, len(found.first) - 1).astype(float)


def _document_counts(vocabulary: Vocabulary):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(vocabulary.terms), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, found in _terms(batch.column("text")):
                total += np.bincount(vocabulary.counts(found)[1], minlength=len(total))
        # One row more, numbered -1, counts the documents.
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-1], seen), pa.int32()), pa.array(np.append([rows], total[seen]))], names=["term", "n"])

    return of_batches


def _vectors(vocabulary: Vocabulary):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found in _terms(batch.column("text")):
                doc, term, times, left = vocabulary.counts_and_strangers(found)
                n = len(found.first) - 1
                ends = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(row, n) for c in ("doc_id", "toxic", "tunes")),
                        pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                        pa.array(left),
                    ],
                    names=["doc_id", "toxic", "tunes", "terms", "times", "strangers"],
                )

    return of_batches


class Examples:
    """The block-max inverted index of labelled examples and the calibrated vote."""

    def __init__(self, vocabulary: Vocabulary, weight: np.ndarray, stranger: float, rows: list[tuple], tuning: list[tuple], shares: dict[int, float]):
        """weight: of each term; stranger: of a word that is none. rows: (doc_id, toxic, terms, times, strangers) of the examples; tuning: the same of
        calibration rows; shares: of each label in all labelled rows."""
        self.vocabulary, self.term_weight, self.stranger = vocabulary, weight, stranger
        vectors = [self.weigh(t, n, left) for _, _, t, n, left in rows]
        # Examples with the same heaviest term stand together, so that blocks differ in their maxima.
        heavy = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
        order = sorted((i for i in range(len(rows)) if len(vectors[i][0])), key=lambda i: (heavy[i], rows[i][0]))
        self.ids = np.array([rows[i][0] for i in order], np.int64)
        self.toxic = np.array([rows[i][1] for i in order], np.float64)
        labels = np.array([r[1] for r in rows], np.float64)
        self.weight = {y: shares.get(y, 0.0) / max(int((labels == y).sum()), 1) for y in (0, 1)}
        self.prior = shares.get(1, 0.0)
        self.row_weight = np.where(self.toxic == 1, self.weight[1], self.weight[0])
        # Postings by term, then example; an entry is a term's run of postings in one block of examples, with their largest weight.
        none = np.zeros(0)
        term = np.concatenate([vectors[i][0] for i in order] or [none]).astype(np.int64)
        place = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        by = np.lexsort((place, term))
        term, self.place = term[by], place[by].astype(np.int32)
        self.post = np.concatenate([vectors[i][1] for i in order] or [none])[by]
        self.n_blocks = -(-len(order) // BLOCK)
        block = self.place // BLOCK
        opens = np.ones(len(term), bool)
        opens[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.entry = np.append(np.flatnonzero(opens), len(term))
        self.entry_block = block[opens]
        self.peak = np.maximum.reduceat(self.post, self.entry[:-1]) if len(term) else none
        self.of_term = np.searchsorted(term[opens], np.arange(len(weight) + 1))
        self.curve = (1.0, 0.0)
        bare = [i for i in range(len(rows)) if not len(vectors[i][0])]
        mass = sum(self.weight[int(labels[i])] for i in bare)
        self.empty = sum(self.weight[1] for i in bare if labels[i] == 1) / mass if mass else self.prior
        if len(order) and tuning:
            self._calibrate(tuning)

    def weigh(self, terms: np.ndarray, times: np.ndarray, strangers: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """TF-IDF of one document, of length one together with the words that are no terms."""
        w = (1 + np.log(times)) * self.term_weight[terms]
        return terms, w / max(math.sqrt(float((w * w).sum()) + strangers * self.stranger**2), 1e-300)

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples, nearest first, ties to the smaller id. Exact: the blocks with the highest bounds are scored
        first, then all others whose bound reaches the k-th best cosine."""
        low, high = self.of_term[terms], self.of_term[terms + 1]
        n = high - low
        entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        factor = np.repeat(w, n)
        blocks = self.entry_block[entry]
        bound = np.bincount(blocks, self.peak[entry] * factor, self.n_blocks)
        like = np.zeros(len(self.ids))
        first = np.zeros(self.n_blocks, bool)
        first[np.argsort(-bound, kind="stable")[: max(4, -(-2 * k // BLOCK))]] = True
        self._add(like, entry, factor, first[blocks])
        best = np.partition(like, -k)[-k] if len(like) > k else 0.0
        self._add(like, entry, factor, (~first & (bound >= best - 1e-12))[blocks])
        some = np.flatnonzero(like > max(best - 1e-9, 0.0))
        some = some[np.lexsort((self.ids[some], -like[some]))[:k]]
        return some, like[some]

    def _add(self, like: np.ndarray, entry: np.ndarray, factor: np.ndarray, chosen: np.ndarray) -> None:
        """Add what the chosen entries give to the cosines."""
        entry, factor = entry[chosen], factor[chosen]
        low, n = self.entry[entry], self.entry[entry + 1] - self.entry[entry]
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        like += np.bincount(self.place[at], self.post[at] * np.repeat(factor, n), len(like))

    def vote(self, terms: np.ndarray, w: np.ndarray) -> tuple[float, float, float] | None:
        """The weighted share of toxic neighbours, the number of examples at cosine 1 and of toxic ones among them; None without neighbours."""
        place, like = self.nearest(terms, w, NEIGHBOURS)
        if not len(place):
            return None
        pull = self.row_weight[place] / (1 - np.minimum(like, 1) + SOFT)
        same = like > 1 - 1e-9
        return float((pull * self.toxic[place]).sum() / pull.sum()), float(same.sum()), float(self.toxic[place][same].sum())

    def _calibrate(self, tuning: list[tuple]) -> None:
        found = [(self.vote(*self.weigh(t, n, left)), y) for _, y, t, n, left in tuning if len(t)]
        x = _logit(np.array([v[0] for v, _ in found if v is not None]))
        y = np.array([y for v, y in found if v is not None], np.float64)
        if not len(x):
            return
        weight = np.where(y == 1, self.weight[1], self.weight[0])
        weight = weight / weight.sum()
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps of a logistic regression with a ridge towards the raw vote
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
            g = np.array([(weight * (p - y) * x).sum() + RIDGE * (a - 1), (weight * (p - y)).sum() + RIDGE * b])
            v = weight * p * (1 - p)
            h = np.array([[(v * x * x).sum() + RIDGE, (v * x).sum()], [(v * x).sum(), v.sum() + RIDGE]])
            step = np.clip(np.linalg.solve(h, g), -1, 1)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-10:
                break
        if a > 0:
            self.curve = (float(a), float(b))

    def score(self, terms: np.ndarray, times: np.ndarray, strangers: float = 0.0) -> float:
        terms, w = self.weigh(terms, times, strangers)
        vote = self.vote(terms, w) if len(terms) else None
        if vote is None:
            return self.empty
        (share, same, toxic), (a, b) = vote, self.curve
        chance = float(1 / (1 + np.exp(-np.clip(a * _logit(np.array([share]))[0] + b, -50, 50))))
        return (chance + SAME * toxic) / (1 + SAME * same)


def _logit(v: np.ndarray) -> np.ndarray:
    v = np.clip(v, 1e-3, 1 - 1e-3)
    return np.log(v / (1 - v))


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Examples:
    """The index of up to `examples` rows of each label; labels has doc_id and toxic, null and other values are ignored."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    labels = written(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    totals = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    drawn = None
    for y in (0, 1):
        part = labels.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        drawn = part if drawn is None else drawn.union(part)
    drawn = written(drawn, "drawn")
    sample = written(texts.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"]), "sample")
    tunes = F.pmod(F.xxhash64(F.lit("tune"), "doc_id"), F.lit(CALIBRATE)) == 0
    size = {r["toxic"]: r["count"] for r in sample.filter(~tunes).groupBy("toxic").count().collect()}
    all_n, bad_n = sum(size.values()), size.get(1, 0)
    counts = sample.filter(~tunes).mapInArrow(_label_counts, "term long, n long, bad long, word boolean")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("word").alias("word"))
    expected = F.col("n") * bad_n / F.lit(max(all_n, 1))
    chi = (F.col("bad") - expected) ** 2 / (expected * (1 - F.col("n") / F.lit(all_n + 1.0))) if 0 < bad_n < all_n else F.lit(0.0)
    # Bounded by the sample; every word of an example is a term.
    terms = counts.select("term", chi.alias("chi"), "word").filter(F.col("word") | (F.col("chi") >= PREFIX_CHI)).select("term", "chi").toArrow()
    vocabulary = Vocabulary(terms.column("term").to_numpy().view(np.uint64))
    tie = np.zeros(len(vocabulary.terms))
    tie[np.searchsorted(vocabulary.terms, terms.column("term").to_numpy().view(np.uint64))] = np.minimum(terms.column("chi").to_numpy() / FULL_CHI, 1) ** 2
    found = texts.select("text").mapInArrow(_document_counts(vocabulary), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, times = found.column("term").to_numpy(), found.column("n").to_numpy()
    n = int(times[term < 0].sum())
    df = np.ones(len(vocabulary.terms))
    df[term[term >= 0]] = times[term >= 0]
    weight = np.log(1 + n / df) * (PLAIN + (1 - PLAIN) * tie)
    schema = "doc_id long, toxic int, tunes boolean, terms array<int>, times array<int>, strangers double"
    rows = sample.withColumn("tunes", tunes).mapInArrow(_vectors(vocabulary), schema).orderBy("doc_id").toArrow()
    held: dict[bool, list[tuple]] = {False: [], True: []}
    for r in range(rows.num_rows):
        doc_id, toxic, tunes_, own, often, left = (rows.column(c)[r] for c in rows.column_names)
        held[tunes_.as_py()].append((doc_id.as_py(), toxic.as_py(), own.values.to_numpy().astype(np.int64), often.values.to_numpy().astype(np.float64), left.as_py()))
    whole = max(sum(totals.values()), 1)
    return Examples(vocabulary, weight, math.log(1 + n) * PLAIN, held[False], held[True], {y: c / whole for y, c in totals.items()})


def _queries(index: Examples, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(terms, times, strangers) of every text."""
    for _, found in _terms(column):
        doc, term, times, left = index.vocabulary.counts_and_strangers(found)
        ends = np.searchsorted(doc, np.arange(len(found.first))).tolist()
        for d, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            yield term[a:b], times[a:b], float(left[d])


def _batch_scores(index: Examples, column: pa.Array) -> np.ndarray:
    return np.array([index.score(*q) if len(q[0]) else index.empty for q in _queries(index, column)], np.float64)


def _scores(index: Examples):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _batch_scores(index, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return of_batches


def _evidence(index: Examples):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, likes = [], []
            for q in _queries(index, batch.column("text")):
                place, like = index.nearest(*index.weigh(*q), NEIGHBOURS)
                ids.append(index.ids[place].tolist())
                likes.append(like.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64())), pa.array(likes, pa.list_(pa.float64()))], names=["doc_id", "examples", "cosines"]
            )

    return of_batches


def _plain(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def score(docs: DataFrame, index: Examples) -> DataFrame:
    """doc_id, score, predicted of every row of docs (doc_id, text). Texts without any word of an example, null and empty ones too, get the
    share of toxic rows among such examples, or among all labelled rows if there are none. Without labelled rows that is 0."""
    return _plain(docs).mapInArrow(_scores(index), "doc_id long, score double, predicted int")


def evidence(docs: DataFrame, index: Examples) -> DataFrame:
    """doc_id, examples, cosines: the nearest labelled examples of every row of docs, nearest first, ties to the smaller id."""
    return _plain(docs).mapInArrow(_evidence(index), "doc_id long, examples array<long>, cosines array<double>")


def held_out(doc_id: str = "doc_id", folds: int = 5):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; learns from labels of rows that are not held out (crc32(doc_id as text) mod 5).

    Other columns are ignored. Rows without doc_id are scored and not held out. A doc_id labelled more than once counts as toxic if any label
    says so; one with several texts teaches by one of them. Empty tables give an empty result or, without labels, score 0.
    """
    index = train(docs, labels.filter(~held_out()))
    return score(docs, index).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, index: Examples) -> DataFrame:
    """The rows of docs, with all their columns, that score below one half. Null and empty texts score as in `score`; repeated rows go or stay together; an
    empty table stays empty."""
    return keep_rows(docs, lambda text: _batch_scores(index, text) < 0.5)
