"""Near-duplicate documents by b-bit MinHash.

Per document the distinct word shingles give minima of many hash functions. Groups of minima (bands) are the keys under which candidates
meet; of each minimum only the low bits are kept, packed into bit planes, and the share of equal ones, corrected for chance collisions,
drops candidates that are far below the limit. All that remain are confirmed on the full shingle sets.

No hot group is compared pair by pair. Documents with the same set become one class first. In a bucket every member is compared with the
smallest one only. Buckets whose members are still in more than one component go to an exact prefix-filter join: two sets that reach
the limit must share one of each other's rarest shingles, so documents with many shingles of their own drop out and only real
neighbours meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .components import components
from .scratch import anti, semi, ship, written

#: Words of a shingle, minima of a band, bits kept of a minimum.
SHINGLE_WORDS, BAND_ROWS, LOW_BITS = 5, 4, 4
#: Chance that a pair exactly at the limit meets in no band; the number of bands follows from it.
MISS = 1e-6
#: Standard deviations below the limit at which an estimate drops a candidate.
SLACK = 5.0


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** BAND_ROWS))


def _signatures(percent: int):
    n_bands = bands_for(percent)
    n_hashes = n_bands * BAND_ROWS
    n_longs = -(-n_hashes // 64)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = (tokens.seeds(n_hashes, 11) >> np.uint64(20)).astype(np.uint32) | np.uint32(1)
        band_factors = tokens.seeds(n_bands * BAND_ROWS, 13).reshape(n_bands, BAND_ROWS)
        for batch in batches:
            data, offsets = tokens.string_bytes(batch.column("text"))
            for low, high in tokens.pieces(offsets):
                sets = tokens.shingle_sets(tokens.words(data, offsets[low : high + 1], lower=True), SHINGLE_WORDS)
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                minima = np.zeros((len(sets), n_hashes), np.uint32)
                one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(some):
                    joined = np.concatenate(sets)
                    starts = (np.cumsum(sizes) - sizes)[some]
                    short = (joined >> np.uint64(32)).astype(np.uint32)
                    for k in range(n_hashes):
                        values = short * factors[k]
                        values ^= values >> np.uint32(15)
                        values *= np.uint32(0x2C1B3C6D)
                        minima[some, k] = np.minimum.reduceat(values, starts)
                    one[some] = np.add.reduceat(tokens.mix(joined), starts)
                    two[some] = np.add.reduceat(tokens.mix(joined ^ np.uint64(0x5DEECE66D)), starts)
                keys = (minima.reshape(len(sets), n_bands, BAND_ROWS).astype(np.uint64) * band_factors).sum(2)
                keys = tokens.mix(keys + np.arange(n_bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                keys = np.where(sizes[:, None] > 0, keys, 0)
                planes = np.zeros((len(sets), LOW_BITS, n_longs * 64), np.uint8)
                for bit in range(LOW_BITS):
                    planes[:, bit, :n_hashes] = (minima >> np.uint32(bit + 8)) & np.uint32(1)
                packed = np.packbits(planes, axis=2).reshape(len(sets), -1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        pa.array(sizes),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        _lists(keys),
                        _lists(packed),
                    ],
                    names=["doc_id", "n_shingles", "one", "two", "keys", "bits"],
                )

    return of_batches, n_hashes, n_longs


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).reshape(-1)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tokens.string_bytes(batch.column("text"))
        for low, high in tokens.pieces(offsets):
            sets = tokens.shingle_sets(tokens.words(data, offsets[low : high + 1], lower=True), SHINGLE_WORDS)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, high - low), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "shingles"]
            )


def _estimate(a: str, b: str, n_hashes: int, n_longs: int) -> Column:
    """Similarity by the count of equal low bits, without the matches that chance gives."""
    unequal = F.lit(0)
    for i in range(n_longs):
        differ = None
        for bit in range(LOW_BITS):
            at = bit * n_longs + i
            x = F.col(a)[at].bitwiseXOR(F.col(b)[at])
            differ = x if differ is None else differ.bitwiseOR(x)
        unequal = unequal + F.bit_count(differ)
    chance = 2.0**-LOW_BITS
    return (1 - unequal / F.lit(float(n_hashes)) - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, n_hashes: int, n_longs: int) -> DataFrame:
    """Those of pairs (a, b) that reach the limit: first by packed bits, then on full sets."""
    limit = percent / 100
    match = limit + (1 - limit) * 2.0**-LOW_BITS
    floor = limit - SLACK * math.sqrt(match * (1 - match) / n_hashes) / (1 - 2.0**-LOW_BITS)
    side = lambda p: reps.select(F.col("doc_id").alias(p), F.col("bits").alias(f"bits_{p}"), F.col("n_shingles").alias(f"n_{p}"))
    near = (
        pairs.join(side("b"), "b")
        .join(side("a"), "a")
        .filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        .filter(_estimate("bits_a", "bits_b", n_hashes, n_longs) >= floor)
        .select("a", "b")
    )
    held = lambda p: sets.select(F.col("doc_id").alias(p), F.col("shingles").alias(f"set_{p}"))
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return (
        near.join(held("b"), "b")
        .join(held("a"), "a")
        .select("a", "b", shared.alias("i"), F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"))
        .filter(F.col("i") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("i")) * percent)
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets reach a similarity of percent / 100.

    docs needs doc_id (long) and text; other columns are ignored, whatever their names. Result, one row per row of docs: doc_id,
    n_shingles, component_id (smallest doc_id reachable over links, itself included), kept (doc_id = component_id). Null, empty and blank
    texts have no shingles and are linked with nothing; texts shorter than a shingle are one shingle as a whole. Rows that share a doc_id
    count as one document with all their texts' links; rows without doc_id keep a null component and kept = true. An empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sign, n_hashes, n_longs = _signatures(percent)
    schema = "doc_id long, n_shingles long, one long, two long, keys array<long>, bits array<long>"
    marks = written(docs.mapInArrow(sign, schema), "marks")
    solid = marks.filter("n_shingles > 0 and doc_id is not null")
    classes = written(solid.groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = (
        solid.join(classes.select("one", "two", "n_shingles", F.col("rep").alias("doc_id")), ["one", "two", "n_shingles", "doc_id"], "left_semi")
        .dropDuplicates(["doc_id", "one", "two"])
    )

    rows = reps.select("doc_id", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = written(rows.join(shared.select("key", "hub"), "key"), "buckets")
    wanted = written(met.select("doc_id").distinct(), "wanted")
    near_reps = written(semi(reps.select("doc_id", "n_shingles", "bits"), wanted, "doc_id"), "reps")
    sets = semi(docs.filter("doc_id is not null"), wanted, "doc_id").mapInArrow(_sets, "doc_id long, shingles array<long>")
    sets = written(sets, "sets")

    star = met.filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = written(_confirmed(star, near_reps, sets, percent, n_hashes, n_longs).distinct(), "links")
    first = components(links)

    placed = met.select("key", "doc_id").join(first, met["doc_id"] == first["node"], "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    rest = written(placed.join(open_keys, "key", "left_semi").select("doc_id", "component").distinct(), "rest")
    pairs = _prefix_pairs(rest, sets, percent)
    more = written(_confirmed(pairs, near_reps, sets, percent, n_hashes, n_longs).union(links).distinct(), "links")
    final = components(more)

    of_class = (
        classes.join(final, classes["rep"] == final["node"], "left")
        .select("one", "two", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component_id"))
    )
    marks = marks.select("doc_id", "n_shingles", "one", "two")
    return (
        marks.join(of_class, (marks["one"] == of_class["one"]) & (marks["two"] == of_class["two"]) & (marks["n_shingles"] == of_class["n"]), "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, without near-duplicates: of each component the smallest doc_id stays, once.

    Documents without words and rows without doc_id all stay; of rows that share a doc_id one stays.
    """
    found = written(near_duplicates(docs, percent), "components")
    order = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    gone = found.filter("not kept").select("doc_id").distinct()
    kept = anti(docs, written(gone, "gone"), "doc_id").select(*order)
    twice = written(found.filter("doc_id is not null and kept").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    if not twice.limit(1).count():
        return kept
    return anti(kept, twice, "doc_id").select(*order).unionByName(semi(kept, twice, "doc_id").select(*order).dropDuplicates(["doc_id"]))


def _prefix_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of documents of different components that share a shingle of both prefixes.

    The prefix of a set of n shingles is its n - ceil(limit * n) + 1 rarest ones. The first shingle that two sets share, in that order, leaves
    room for as many more as the shorter rest holds, which must suffice for the limit; so a document with many shingles of its own meets
    nobody, and no link is missed. Shingles found once are counted, not joined.
    """
    held = sets.join(rest, "doc_id").select("doc_id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    held = written(held, "held")
    counts = held.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("low"), F.max("component").alias("high")).filter("df > 1")
    common = held.join(counts, "s")
    own = common.groupBy("doc_id", "component", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "s", (F.col("low") != F.col("high")).alias("open")))).alias("shared")
    )
    own = own.withColumn("single", F.col("n") - F.size("shared"))
    length = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1 - F.col("single")
    prefix = (
        own.filter(length > 0)
        .select("doc_id", "component", "n", "single", F.posexplode(F.slice("shared", F.lit(1), length.cast("int"))).alias("pos", "x"))
        .filter("x.open")
        .select("doc_id", "component", F.col("x.s").alias("s"), "n", (F.col("n") - F.col("single") - F.col("pos")).alias("left"))
    )
    prefix = written(prefix, "prefix")
    a, b = prefix.toDF("a", "ca", "s", "na", "la"), prefix.toDF("b", "cb", "s", "nb", "lb")
    fits = F.least("la", "lb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return a.join(b, (a["s"] == b["s"]) & F.expr("a < b and ca <> cb") & fits).select("a", "b").distinct()
