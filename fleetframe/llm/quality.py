"""Document quality by hierarchical empirical Bayes: a classifier's evidence per document, with posteriors of its host and path.

The classifier is a logistic regression over binned text measures, fitted on a bounded sample of labelled rows. Every document then counts as
its known label, or as the classifier's chance where it has none. Grouped sums per path give host sums and the global mean. A host's
posterior is its mean drawn towards the global mean, a path's posterior its mean drawn towards its host's; how strongly follows from how much hosts, and
paths within hosts, really differ (method of moments). So sparse sites stand near the prior. A document's own share is taken out of its
site before the site's evidence joins its score, on the scale of log odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .scratch import BROADCAST_ROWS, ship, written

#: Labelled rows that the classifier is fitted on (smallest hash of doc_id), and bins of each measure.
SAMPLE, BINS = 20_000, 10
MEASURES = ("words", "word_length", "letters", "capitals", "digits", "marks", "odd", "repeated_words", "repeated_lines", "line_words", "commonest")
#: Bounds of the strength of a prior, in documents.
WEAKEST, STRONGEST = 1.0, 1e4

_CLASS = np.zeros((5, 256), bool)
_CLASS[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASS[1, 65:91] = True
_CLASS[2, 48:58] = True
_CLASS[3, [ord(c) for c in ".,;:!?'\"()-"]] = True
_CLASS[4, [ord(c) for c in "#$%&*|<>{}[]\\^~=+_/@"]] = True


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of MEASURES per text; empty texts have zeros."""
    found = tokens.words(data, offsets, lower=True)
    n = len(offsets) - 1
    size = np.diff(offsets)
    count = np.diff(found.first)
    out = np.zeros((n, len(MEASURES)))
    some = np.flatnonzero(size)
    if not len(some):
        return out
    shares = np.stack([np.add.reduceat(c[data].astype(np.int64), offsets[some]) for c in _CLASS], 1) / size[some, None]
    out[:, 0] = np.log1p(count)
    out[:, 1] = size / np.maximum(count, 1)
    out[some, 2:7] = shares
    doc = np.repeat(np.arange(n), count)
    order = np.lexsort((found.hash, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (found.hash[order][1:] != found.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][fresh], minlength=n)
    out[:, 7] = 1 - distinct / np.maximum(count, 1)
    if len(order):
        at = np.flatnonzero(fresh)
        times = np.diff(np.append(at, len(order)))
        most = np.zeros(n)
        np.maximum.at(most, doc[order][at], times)
        out[:, 10] = most / np.maximum(count, 1)
    # A line is known by the words in it.
    ends = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([np.searchsorted(found.start, ends), found.first[:-1]]))
    cuts = cuts[cuts < len(found.hash)]
    if len(cuts):
        lines = tokens.run_hashes(found.hash, cuts, np.append(cuts[1:], len(found.hash)))
        of = np.searchsorted(found.first, cuts, "right") - 1
        pairs = np.unique(np.stack([of.astype(np.uint64), lines], 1), axis=0)[:, 0].astype(np.int64)
        n_lines = np.bincount(of, minlength=n)
        out[:, 8] = 1 - np.bincount(pairs, minlength=n) / np.maximum(n_lines, 1)
        out[:, 9] = np.log1p(count / np.maximum(n_lines, 1))
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tokens.string_bytes(batch.column("text"))
        rows = [measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tokens.pieces(offsets)]
        values = np.concatenate(rows) if rows else np.zeros((0, len(MEASURES)))
        rest = [c for c in batch.schema.names if c != "text"]
        ends = pa.array((np.arange(len(values) + 1) * len(MEASURES)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.ListArray.from_arrays(ends, pa.array(values.reshape(-1)))], names=[*rest, "m"])


class Classifier:
    """Logistic regression over one-hot bins of the measures; bins are quantiles of the fitted rows."""

    def __init__(self, values: np.ndarray, labels: np.ndarray):
        self.cuts = [np.unique(np.quantile(values[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(values) else np.zeros(0) for j in range(len(MEASURES))]
        x, y = self.features(values), labels.astype(np.float64)
        self.weights = np.zeros(x.shape[1])
        ridge = np.full(x.shape[1], 1.0)
        ridge[0] = 1e-3
        for _ in range(30 if len(x) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * self.weights)
            self.weights -= step
            if np.abs(step).max() < 1e-9:
                break

    def features(self, values: np.ndarray) -> np.ndarray:
        columns = [np.ones((len(values), 1))]
        for j, cuts in enumerate(self.cuts):
            columns.append(np.eye(len(cuts) + 1)[np.searchsorted(cuts, values[:, j], "right")])
        return np.hstack(columns)

    def chance(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(values) @ self.weights, -30, 30)))


def _chances(model: Classifier):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "text"]
            data, offsets = tokens.string_bytes(batch.column("text"))
            rows = [model.chance(measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in tokens.pieces(offsets)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(np.concatenate(rows) if rows else np.zeros(0))], names=[*rest, "chance"])

    return of_batches


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """docs has doc_id and text, labels doc_id and quality (0 or 1)."""
    drawn = written(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", "quality"), "drawn")
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"])
    rows = rows.select("doc_id", "quality", "text").mapInArrow(_measured, "doc_id long, quality int, m array<double>").orderBy("doc_id").collect()
    return Classifier(np.array([r["m"] for r in rows]).reshape(-1, len(MEASURES)), np.array([r["quality"] for r in rows]))


def _strength(sites: DataFrame, mean: Column | float) -> float:
    """Documents that a prior is worth: from the variance of site means around `mean` beyond what chance gives. sites: n, good, mean."""
    p = F.col("good") / F.col("n")
    row = sites.filter("n > 1").agg(
        F.sum(F.col("n") * (p - mean) ** 2).alias("between"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"), F.sum(mean * (1 - mean)).alias("within")
    ).first()
    if not row["sites"]:
        return STRONGEST
    between = (row["between"] - row["within"]) / row["n"]
    within = row["within"] / row["sites"]
    return float(min(max(within / between - 1, WEAKEST), STRONGEST)) if between > 0 else STRONGEST


def _logit(c: Column) -> Column:
    bounded = F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(bounded / (1 - bounded))


def scored(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, held_out, classifier, host_posterior, path_posterior, score, predicted of every row of docs.

    docs needs doc_id, text and the columns that name its host and its path below the host; labels needs doc_id and quality. Other columns are
    ignored. Learns from labels of rows that are not held out (crc32(doc_id as text) mod 5 is not 0). Null hosts and paths are sites of
    their own. Null and empty texts are scored by their (zero) measures; rows without doc_id count without a label. A doc_id labelled more than once
    has the lowest label. Without labels every chance is one half. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path")
    )
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(~held)
    known = written(known.groupBy("doc_id").agg(F.min("quality").alias("quality")), "known")
    model = fit(docs, known)
    chances = docs.select("doc_id", "host", "path", "text").mapInArrow(_chances(model), "doc_id long, host string, path string, chance double")
    rows = chances.join(known, "doc_id", "left").withColumn("value", F.coalesce(F.col("quality").cast("double"), F.col("chance")))
    rows = written(rows.select("doc_id", "host", "path", "chance", "value"), "chances")

    paths = written(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("good")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = min(max(whole["good"] / whole["n"], 1e-4), 1 - 1e-4) if whole["n"] else 0.5
    host_prior = _strength(hosts, F.lit(mean))
    sites = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    paths = paths.join(sites, paths["host"].eqNullSafe(sites["h"])).drop("h")
    path_prior = _strength(paths, (F.col("host_good") + host_prior * mean) / (F.col("host_n") + host_prior))
    paths = paths.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "good", "host_n", "host_good")
    if paths.count() <= BROADCAST_ROWS:
        paths = F.broadcast(paths)
    rows = rows.join(paths, rows["host"].eqNullSafe(F.col("h")) & rows["path"].eqNullSafe(F.col("p")))
    of_host = (F.col("host_good") - F.col("value") + host_prior * mean) / (F.col("host_n") - 1 + host_prior)
    of_path = (F.col("good") - F.col("value") + path_prior * of_host) / (F.col("n") - 1 + path_prior)
    odds = _logit(F.col("chance")) + _logit(of_path) - float(np.log(mean / (1 - mean)))
    score = 1 / (1 + F.exp(-odds))
    return rows.select(
        "doc_id", held.alias("held_out"), F.col("chance").alias("classifier"), of_host.alias("host_posterior"), of_path.alias("path_posterior"),
        score.alias("score"), (score >= 0.5).cast("int").alias("predicted"),
    )
