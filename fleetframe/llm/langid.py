"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order context tree over bytes: a node is a context of up to ORDER bytes with the counts of the bytes seen after it. A
byte that a context has not seen costs an escape (method C: seen kinds against seen bytes plus kinds) and is coded in the next shorter
context, at the end by equal shares. Statistics are frozen after training, so the code length of every byte in every node can be worked out
beforehand; a text costs one table row per byte. The shortest code names the language.

Bytes are folded to symbols first: A-Z to a-z, white space to one symbol, every other byte seen in training to its own, bytes never seen there to
one symbol. Counting covers all training rows in Spark tasks; what reaches the driver is bounded by NODES for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .scratch import ship, written

ORDER = 3
#: Longest contexts kept for each language, those seen most in it; all shorter contexts are kept. The frozen table of a language has
#: (symbols ** 2 + NODES) * symbols numbers and symbols ** 3 node numbers, of 4 bytes each: 6 MB with 64 symbols, 91 MB if all bytes of UTF-8 occur.
NODES = 16_384
#: Symbols at least: one for white space, one for bytes never seen in training, the rest for single bytes; more if more bytes are seen.
SYMBOLS = 64
SPACE, REST = 0, 1
#: Symbols counted at a time; bounds the memory of a counting task.
CHUNK = 8 << 20

UNKNOWN = "und"


def _folded() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[[9, 10, 11, 12, 13]] = 32
    return fold


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, fold = np.zeros(256, np.int64), _folded()
    for batch in batches:
        total += np.bincount(fold[tokens.string_bytes(batch.column("text"))[0]], minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total)], names=["byte", "n"])


def _contexts(symbols: np.ndarray, offsets: np.ndarray, base: int) -> np.ndarray:
    """For each byte its ORDER bytes before it and itself as one number of digits below `base`; every text begins after white space."""
    key = symbols.astype(np.uint32)
    for back in range(1, ORDER + 1):
        shifted = np.zeros(len(symbols), np.uint32)
        shifted[back:] = symbols[:-back]
        for i in range(back):
            at = offsets[:-1] + i
            shifted[at[at < offsets[1:]]] = SPACE
        key += shifted * np.uint32(base**back)
    return key


def _count_grams(fold: np.ndarray, base: int):
    """Counts of (language, context and byte) over a task's rows."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def counted(lang: str) -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            sizes[lang] = 0
            langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(keys), np.int32)))
            return pa.RecordBatch.from_arrays([langs, pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            langs, codes = names.dictionary.to_pylist(), names.indices.to_numpy()
            data, offsets = tokens.string_bytes(batch.column("text"))
            for row, to in tokens.pieces(offsets):
                local = offsets[row : to + 1] - offsets[row]
                keys = _contexts(fold[data[offsets[row] : offsets[to]]], local, base)
                # Rows of one language lie together after one sort, however many languages there are.
                own = np.repeat(codes[row:to], np.diff(local))
                order = np.argsort(own, kind="stable")
                keys = keys[order]
                at = np.flatnonzero(np.append(True, np.diff(own[order]) != 0)) if len(own) else np.zeros(0, np.int64)
                for code, part in zip(own[order][at].tolist(), np.split(keys, at[1:]), strict=False):
                    lang = langs[code]
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sizes[lang] >= CHUNK:
                        yield counted(lang)
        for lang in list(held):
            yield counted(lang)

    return of_batches


class Trees:
    """Frozen trees of all languages: node of each context, and code lengths in bits of each symbol in each node by language."""

    def __init__(self, langs: list[str], fold: np.ndarray, grams: dict[str, tuple[np.ndarray, np.ndarray]], nodes: int = NODES, base: int = SYMBOLS):
        self.langs, self.fold, self.base = langs, fold, base
        short, far = base ** (ORDER - 1), base ** (ORDER + 1)
        # Nodes 0..short-1 are the contexts of ORDER - 1 bytes, the others the contexts of ORDER bytes that the language keeps.
        self.node = np.tile(np.arange(short, dtype=np.int32), (len(langs), base))
        tables = []
        for i, lang in enumerate(langs):
            keys, n = grams.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            seen_contexts, at = np.unique(keys[keys < far] // base, return_inverse=True)
            total = np.bincount(at, n[keys < far], len(seen_contexts))
            kept = np.sort(seen_contexts[np.argsort(-total, kind="stable")[:nodes]])
            self.node[i, kept] = short + np.arange(len(kept), dtype=np.int32)
            chance = np.full((1, base), 1.0 / base)
            for order in range(ORDER):
                seen = np.zeros((base**order, base))
                np.add.at(seen.reshape(-1), keys % base ** (order + 1), n)
                chance = _escaped(seen, np.tile(chance, (len(seen) // len(chance), 1)))
            deep = np.zeros((len(kept), base))
            place = np.searchsorted(kept, keys // base)
            inside = (place < len(kept)) & (kept[np.minimum(place, len(kept) - 1)] == keys // base) if len(kept) else np.zeros(len(keys), bool)
            np.add.at(deep, (place[inside], keys[inside] % base), n[inside])
            chance = np.vstack([chance, _escaped(deep, chance[kept % short])])
            tables.append((-np.log2(chance).reshape(-1)).astype(np.float32))
        self.bits = np.zeros((max(map(len, tables), default=0), len(langs)), np.float32, order="F")
        for i, table in enumerate(tables):
            self.bits[: len(table), i] = table

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language; empty texts cost nothing."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            context, symbol = np.divmod(_contexts(self.fold[data], offsets, self.base), np.uint32(self.base))
            for i in range(len(self.langs)):
                rows = self.node[i, context].astype(np.int64) * self.base + symbol
                out[some, i] = np.add.reduceat(self.bits[rows, i].astype(np.float64), offsets[some])
        return out


def _escaped(seen: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Chances of all symbols in contexts with counts `seen`, where `shorter` holds those of the contexts one byte shorter.

    Method C without exclusion, mixed so that the chances of each context sum to one: a context with n bytes of k kinds gives a symbol its
    count over n + k and leaves k over n + k to the shorter context. A context never seen is its shorter context.
    """
    n, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
    return np.where(n > 0, (seen + kinds * shorter) / np.maximum(n + kinds, 1), shorter)


def train(docs: DataFrame, nodes: int = NODES) -> Trees:
    """Trees of all non-null languages of docs (text, lang), from all their texts."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    common = docs.select("text").mapInArrow(_byte_counts, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    own = sorted(r["byte"] for r in common if r["n"] and r["byte"] != 32)
    base = max(SYMBOLS, len(own) + 2)
    symbol = np.full(256, REST, np.uint8)
    symbol[32] = SPACE
    for i, byte in enumerate(own):
        symbol[byte] = i + 2
    fold = symbol[_folded()]
    counts = written(docs.mapInArrow(_count_grams(fold, base), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    # Whole contexts of ORDER bytes beyond the `nodes` commonest of a language only matter through their shorter contexts: sum those in Spark. A language has
    # base ** ORDER contexts at most, so its window is bounded.
    contexts = counts.groupBy("lang", F.expr(f"gram div {base}").alias("context")).agg(F.sum("n").alias("all"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("all"), "context"))
    top = contexts.withColumn("place", place).filter(F.col("place") <= nodes).select("lang", "context", F.lit(True).alias("kept"))
    counts = counts.withColumn("context", F.expr(f"gram div {base}")).join(top, ["lang", "context"], "left")
    # A far gram is put under a context beyond all of ORDER bytes, so that only its shorter contexts count it.
    gram = F.when(F.col("kept"), F.col("gram")).otherwise(F.col("gram") % base**ORDER + base ** (ORDER + 1))
    whole = counts.groupBy("lang", gram.alias("gram")).agg(F.sum("n").alias("n")).toPandas()
    grams = {lang: (own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.int64)) for lang, own in whole.groupby("lang")}
    return Trees(langs, fold, grams, nodes, base)


def _predictions(trees: Trees):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*trees.langs, UNKNOWN])
        for batch in batches:
            column = batch.column("text")
            data, offsets = tokens.string_bytes(column)
            letter = batch.column("letter").fill_null(False).to_numpy(zero_copy_only=False)
            best, score = [], []
            for row, to in tokens.pieces(offsets):
                local = offsets[row : to + 1]
                cost = trees.lengths(data[local[0] : local[-1]], local - local[0])
                if cost.shape[1]:
                    order = cost.argmin(1)
                    # Share of the best code under equal priors; tempered by length, or every text of some words would score 1.
                    gap = (cost - cost.min(1, keepdims=True)) / np.maximum(np.sqrt(np.diff(local)), 1)[:, None]
                    share = 1 / np.exp2(-np.minimum(gap, 60)).sum(1)
                else:
                    order, share = np.zeros(to - row, np.int64), np.zeros(to - row)
                best.append(order)
                score.append(share)
            order = np.concatenate(best) if best else np.zeros(0, np.int64)
            share = np.concatenate(score) if score else np.zeros(0)
            known = letter & (len(trees.langs) > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), names.take(pa.array(np.where(known, order, len(trees.langs)))), pa.array(np.where(known, share, 0.0))],
                names=["doc_id", "lang_pred", "score"],
            )

    return of_batches


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text). Texts that are null or have no letter, and all texts where no language was
    learned, are `und` with score 0. Equal code lengths go to the first language by name."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("letter", F.col("text").rlike(r"\p{L}"))
    return docs.mapInArrow(_predictions(trees), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang).

    Learns only from rows whose crc32(doc_id as text) mod `folds` is not `held`, and there from text and non-null lang. Rows without doc_id are not
    learned from and not held out. Other columns are ignored; an empty table gives an empty result.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    trees = train(docs.filter(fold != held))
    out = predict(docs, trees)
    return out.withColumn("held_out", F.coalesce(fold == held, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")
