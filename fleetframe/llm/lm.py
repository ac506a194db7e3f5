"""Language-model scores from a probabilistic suffix tree over words.

A state of the tree is a context of up to DEPTH tokens that stands in the training texts LEAST times at least and whose next tokens differ enough from
those of its longest shorter context: the code length that they save there, each token's own occurrence left out of its count, has to reach CUTOFF
nats. A state gives a token what it was seen beyond once, and shares the rest of its mass as the next shorter state does; the empty
context gives the base chances. A text is scored token by token in the longest state that its last tokens end with.

Nothing here has to fit one machine. Log chances add up over all word runs of a text: a run seen in a state carries what it has over the mass
shared out, a run that is a state carries the log of that mass for whatever follows it. So the model is one table of (run, value), as
large as the corpus makes it, and a score is a join and a sum. The most frequent runs, a bounded number, travel to the tasks and are looked up
there; of the others a text sends only those that the model may hold, told by bit maps of bounded size without false negatives. Runs of one token,
of two (the most, in two passes by their last bit, as numbers of common words) and of more are looked up in passes of their own, with their own frequent
runs and map; what a pass has shuffled is deleted before the next one. Texts travel in pieces, whose rows are named once: buckets send back the sums alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .scratch import drop, ship, shuffles_deleted, written

DEPTH = 3
LEAST, CUTOFF = 16, 4.0
#: Tokens that a task counts at a time.
CHUNK = 4 << 20
#: Rows of the model that travel to the tasks, and rows of a table that are joined by broadcast because many rows may meet them.
HOT, HOT_JOIN = 1 << 20, 1 << 14
#: Other rows of the model are cut by key into buckets of about so many, which meet the runs sent to them in one task.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 20, 8
#: The most frequent runs of a length, which are sent as numbers of three bytes when longer ones are counted, and words when runs of two are looked up.
COMMON = 1 << 18
#: Passes over the keys of runs of two tokens, and of suffixes whose chances are looked up, a power of 2.
PASSES = 2
#: Runs are counted in buckets of keys, one for so many training tokens.
BUCKET_TOKENS = 1 << 21
#: Bit maps have 2^MAP_BITS bits at most; fuller ones let more runs through to the join, which decides.
MAP_BITS = 28
#: Rows of the model of which one task makes the pages of a bit map.
MARKED_ROWS = 1 << 19

# Two tokens that no text holds: the beginning is a context only, the end is a token only.
BEGIN, END = (int(k) for k in tokens.mix(np.array([101, 102], np.uint64)))
_LEFT, _RIGHT = tokens.seeds(2, 11)


def longer(keys: np.ndarray) -> np.ndarray:
    """Keys of the runs one token longer, from those of the runs that begin with their first and with their second token."""
    return join_keys(keys[:-1], keys[1:])


def join_keys(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    return tokens.mix(context * _LEFT + suffix * _RIGHT)


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, tokens, row of each token, tokens left in its text from there on), with beginnings and ends."""
    data, offsets = tokens.string_bytes(column)
    for row, to in tokens.pieces(offsets):
        found = tokens.words(data, offsets[row : to + 1], lower=True)
        n = to - row
        size = np.diff(found.first) + 2
        last = np.cumsum(size)
        doc = np.repeat(np.arange(n), size)
        keys = np.empty(int(last[-1]), np.uint64)
        inner = np.ones(len(keys), bool)
        inner[last - 1] = inner[last - size] = False
        keys[inner] = found.hash
        keys[last - size], keys[last - 1] = BEGIN, END
        yield row, keys, doc, last[doc] - np.arange(len(keys))


class Marks:
    """A bit map of run keys with two probes: never a false no."""

    def __init__(self, bits: int, pages: list[tuple[int, bytes]]):
        self.bits = bits
        self.map = np.zeros((1 << bits) // 8, np.uint8)
        for page, content in pages:
            self.map[page * 4096 : page * 4096 + 4096] = np.frombuffer(content, np.uint8)[: len(self.map)]

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """Which positions of `keys` may be marked."""
        at = np.flatnonzero(self._probe(keys >> np.uint64(64 - self.bits)))
        return at[self._probe((keys[at] >> np.uint64(64 - 2 * self.bits)) & np.uint64((1 << self.bits) - 1))]

    def _probe(self, slot: np.ndarray) -> np.ndarray:
        return (self.map[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _order(keys: np.ndarray, exact: bool = True) -> np.ndarray:
    """Positions that sort keys. Upper bits are sorted with positions in place of the lower ones, which is several times faster than an argsort; where
    keys differ in lower bits alone, those that are the same may stand apart if not `exact`."""
    low = np.uint64(max(1, len(keys) - 1).bit_length())
    order = keys >> low << low | np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order &= (np.uint64(1) << low) - np.uint64(1)
    order = order.view(np.int64)
    if exact and len(keys):
        inside = keys[order]
        if (inside[1:] < inside[:-1]).any():
            return np.argsort(keys, kind="stable")
    return order


def marks(keys: DataFrame, n: int | None = None) -> Marks:
    """The bit map of the column `key`; Spark builds its pages. With the number n of keys a task makes them of many."""
    if n is None:
        n = keys.count()
    else:
        keys = keys.coalesce(-(-n // MARKED_ROWS) + 1)
    bits = max(15, min(MAP_BITS, int(16 * n).bit_length()))
    key = F.col("key")
    slots = F.array(F.shiftrightunsigned(key, 64 - bits), F.shiftrightunsigned(key, 64 - 2 * bits).bitwiseAND(F.lit((1 << bits) - 1)))
    slots = keys.select(F.explode(slots).alias("slot"))
    pages = slots.groupBy(F.shiftright("slot", 15).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767))).alias("bits"))
    return Marks(bits, [(r["page"], bytes(r["bits"])) for r in pages.collect()])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    counted = lambda: pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in np.unique(np.concatenate(held), return_counts=True)], names=["key", "n"])
    for batch in batches:
        for _, keys, _, _ in _texts(batch.column("text")):
            held.append(keys)
            size += len(keys)
            if size >= CHUNK:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


class _Places:
    """Where keys stand in a sorted array of distinct ones, by a table of first places for ranges of keys; only the keys travel, a task makes the table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.first = None
        self.often = False

    def _tabled(self) -> None:
        span = int(self.keys[-1] - self.keys[0]).bit_length()
        self.shift = np.uint64(max(0, span - min(22, (4 * len(self.keys)).bit_length())))
        ranges = self._range(self.keys, 1 << 23)
        self.first = np.append(np.int32(0), np.cumsum(np.bincount(ranges, minlength=int(ranges[-1]) + 2), dtype=np.int32))
        self.ended = np.append(self.keys, self.keys[:1])  # nothing that is looked up after the last key is the first

    def _range(self, keys: np.ndarray, last: int) -> np.ndarray:
        return np.minimum((keys - self.keys[0]) >> self.shift, np.uint64(last)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `keys` of those that are there, and their places; in any order."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        if len(self.keys):
            if self.first is None:
                self._tabled()
            own = self._range(keys, len(self.first) - 2)
            if self.often:
                place = self.first[own]
                same = self.ended[place] == keys
                found.append((np.flatnonzero(same), place[same]))
                at = np.flatnonzero(~same)
                place, end = place[at] + 1, self.first[own[at] + 1]
                on = np.flatnonzero(place < end)
                at, place, end = at[on], place[on], end[on]
            else:  # most ranges asked for are empty
                at = np.flatnonzero(self.first[own] < self.first[own + 1])
                place, end = self.first[own[at]], self.first[own[at] + 1]
            while len(at):
                same = self.keys[place] == keys[at]
                found.append((at[same], place[same]))
                on = np.flatnonzero(~same & (place + 1 < end))
                at, place, end = at[on], place[on] + 1, end[on]
            self.often = 3 * sum(len(x) for x, _ in found) > len(keys)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class _Names:
    """Keys as bytes: numbers of the `common` ones, cut in two, and the others after them as they are."""

    def __init__(self, common: np.ndarray):
        self.common = common
        self.places = None

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        if self.places is None:
            self.by_key = np.argsort(self.common).astype(np.uint32)
            self.places = _Places(self.common[self.by_key])
        of = np.full(len(keys), len(self.common), np.uint32)
        at, place = self.places.find(keys)
        of[at] = self.by_key[place]
        return of

    def packed(self, keys: np.ndarray, numbers: np.ndarray) -> bytes:
        low, high = numbers.astype(np.uint16).tobytes(), (numbers >> 16).astype(np.uint8).tobytes()
        return _packed(low + high) + keys[numbers == len(self.common)].tobytes()


def _packed(content: bytes) -> bytes:
    """The size of the compressed bytes, and these."""
    small = pa.compress(content, codec="zstd", asbytes=True)
    return len(small).to_bytes(8, "little") + small


def _unpacked(content: bytes, size: int) -> tuple[bytes, bytes]:
    """`size` bytes that were packed, and what follows them."""
    end = 8 + int.from_bytes(content[:8], "little")
    return pa.decompress(content[8:end], size, "zstd", asbytes=True), content[end:]


def _keys(common: np.ndarray, content: bytes, n: int) -> np.ndarray:
    """The n keys that `_Names` packed."""
    both, rest = _unpacked(content, 3 * n)
    numbers = np.frombuffer(both, np.uint16, n) | np.frombuffer(both, np.uint8, n, 2 * n).astype(np.uint32) << 16
    rare = numbers == len(common)
    keys = np.empty(n, np.uint64)
    keys[rare], keys[~rare] = np.frombuffer(rest, np.uint64), common[numbers[~rare]]
    return keys


_COUNTS = "bucket int, contexts binary, n_contexts int, runs binary, suffixes binary, ns binary, n_runs int"


def _run_counts(length: int, states: Marks, frequent: np.ndarray, common: np.ndarray, buckets: int):
    """Counts of runs of length + 1 tokens whose first `length` may be a state: for each bucket a row with the contexts in order, the number of runs of each,
    and their suffixes and counts. All runs of a context go to one bucket, unless it is one of the `frequent`, whose runs are dealt over all."""
    names, dealt = _Names(common), _Places(frequent)

    def counted(contexts: list[np.ndarray], suffixes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        context, suffix = np.concatenate(contexts), np.concatenate(suffixes)
        contexts.clear()
        suffixes.clear()
        key = join_keys(context, suffix)
        order = _order(key, exact=False)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(first, len(key)))
        key, first = key[first], order[first]
        context, suffix = context[first], suffix[first]
        hashed = tokens.mix(context)
        by = hashed.copy()
        often, _ = dealt.find(context)
        by[often] = key[often]
        bucket = _bucket(by, buckets)
        high = np.uint64(max(1, (buckets - 1).bit_length()))
        order = _order(bucket.astype(np.uint64) << (np.uint64(64) - high) | hashed >> high, exact=False)
        context, suffix, n = context[order], suffix[order], n[order]
        number = names.numbers(suffix)
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(ends)).tolist():
            own = slice(ends[b], ends[b + 1])
            each = np.flatnonzero(np.append(True, np.diff(context[own]) != 0))
            runs = np.diff(np.append(each, ends[b + 1] - ends[b]))
            each = context[own][each]
            packed = (names.packed(each, names.numbers(each)), len(each), _packed(runs.astype(np.int32).tobytes()),
                      names.packed(suffix[own], number[own]), _packed(n[own].astype(np.int32).tobytes()), len(n[own]))
            kinds = (pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), *(pa.array([c], kind) for c, kind in zip(packed, kinds, strict=True))],
                names=["bucket", "contexts", "n_contexts", "runs", "suffixes", "ns", "n_runs"],
            )

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, suffixes, size = [], [], 0
        for batch in batches:
            for _, keys, _, left in _texts(batch.column("text")):
                for _ in range(length - 1):
                    keys = longer(keys)
                inside = np.flatnonzero(left[: len(keys)] > length)
                inside = inside[states[keys[inside]]]
                contexts.append(keys[inside])
                suffixes.append(keys[inside + 1])
                size += len(inside)
                if size >= CHUNK:
                    yield from counted(contexts, suffixes)
                    size = 0
        if size:
            yield from counted(contexts, suffixes)

    return of_batches


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(48)).astype(np.int64) * buckets) >> 16


def _repeated_runs(common: np.ndarray):
    """The runs of one bucket that were seen twice at least, with their keys and whole counts."""

    def of_bucket(sent: pa.Table) -> pa.Table:
        contexts, suffixes, ns = [], [], []
        for r in sent.to_pylist():
            runs, _ = _unpacked(r["runs"], 4 * r["n_contexts"])
            contexts.append(np.repeat(_keys(common, r["contexts"], r["n_contexts"]), np.frombuffer(runs, np.int32)))
            suffixes.append(_keys(common, r["suffixes"], r["n_runs"]))
            ns.append(np.frombuffer(_unpacked(r["ns"], 4 * r["n_runs"])[0], np.int32))
        context, suffix, n = (np.concatenate(c) for c in (contexts, suffixes, ns))
        key = join_keys(context, suffix)
        order = _order(key)
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        whole = np.add.reduceat(n[order].astype(np.int64), first)
        own, whole = order[first[whole >= 2]], whole[whole >= 2]
        return pa.table({"key": key[own].view(np.int64), "context": context[own].view(np.int64), "suffix": suffix[own].view(np.int64), "n": whole})

    return of_bucket


def _split(table: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the most frequent runs, few enough for a broadcast, and the others."""
    return written(table.filter(F.col("n") >= least).drop("n"), "hot"), table.filter(F.col("n") < least).drop("n")


def _looked_up(rows: DataFrame, hot: DataFrame, others: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Inner joins on `key`, which is unique: of the rows whose key is one of the most frequent runs, which may be many for one key and meet it by
    broadcast, and of all others."""
    return rows.join(F.broadcast(hot), key), rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(others, key)


def _grouped(rows: DataFrame, **sums: Column) -> DataFrame:
    """Rows with aggregates of their context, for a bounded number of contexts of any size."""
    return rows.join(F.broadcast(written(rows.groupBy("context").agg(*[c.alias(name) for name, c in sums.items()]), "sums")), "context")


def _windowed(rows: DataFrame, **sums: Column) -> DataFrame:
    """The same for any number of contexts, each of bounded size."""
    own = Window.partitionBy("context")
    return rows.select("*", *[c.over(own).alias(name) for name, c in sums.items()])


def _weighed(rows: DataFrame, within: Callable[..., DataFrame]) -> DataFrame:
    """Runs with the chance of their last token; what a state adds to it in `value`, and on one run of each state the state itself as `of`."""
    rows = within(rows, beyond=F.sum(F.col("n") - 1), seen=F.sum("n"), lead=F.min("key"))
    rows = rows.withColumn("share", 1 - F.col("beyond") / F.col("all"))
    rows = rows.withColumn("own", (F.col("n") - 1) / F.col("all") + F.col("share") * F.col("shorter"))
    rows = within(rows, saved=F.sum(F.col("n") * F.log(F.col("own") / F.col("shorter"))))
    state = F.col("saved") + (F.col("all") - F.col("seen")) * F.log("share") >= CUTOFF
    led = state & (F.col("lead") == F.col("key"))
    return rows.select(
        "key", "n", "ends", F.when(state, F.col("own")).otherwise(F.col("shorter")).alias("chance"),
        F.when(state, F.log10(F.col("own") / (F.col("share") * F.col("shorter")))).alias("value"),
        F.when(led, F.col("context")).alias("of"), F.when(led, F.col("all")).alias("all"), F.when(led, F.log10("share")).alias("share"),
    )


@dataclass
class Tree:
    """The trained model: counts of the training texts, and tables of (key, n, known, base, value).

    `words` has a row per training token: base is its log10 chance less that of an unknown token. `runs` has a row per longer run with what it adds
    to a text that holds it, and a row per state with the log10 of the mass that it shares out; a run may have both.
    """

    n: int = 0
    kinds: int = 0
    words: DataFrame | None = None
    runs: list[DataFrame] = field(default_factory=list)

    @property
    def unknown(self) -> float:
        return float(np.log10(0.5 / (self.n + 0.5 * (self.kinds + 1))))

    @property
    def longest(self) -> int:
        return len(self.runs) // 2 + 1

    def rows(self, lengths: range) -> DataFrame:
        """What the model holds on runs of these lengths: `runs` has, for each length from 2, the runs and the states one token shorter."""
        tables = [self.words] * (1 in lengths) + [t for i, t in enumerate(self.runs) if i // 2 + 2 - i % 2 in lengths]
        return reduce(DataFrame.unionByName, tables)


class _Ranks:
    """How many rows reach each count n."""

    def __init__(self, rows: DataFrame):
        counts = rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).toArrow()  # some 100,000 rows for 5 billion tokens
        n, each = (counts.column(c).to_numpy() for c in ("n", "rows"))
        order = np.argsort(-n)
        self.n, self.reach = n[order], np.append(0, np.cumsum(each[order]))

    def least(self, most: int) -> int:
        """The least count that `most` rows reach at most, 0 if all may."""
        fits = int(np.searchsorted(self.reach[1:], most, "right"))
        return int(self.n[fits]) + 1 if fits < len(self.n) else 0

    def below(self, least: int) -> int:
        """How many rows do not reach a count."""
        return int(self.reach[-1] - self.reach[np.count_nonzero(self.n >= least)])


def _commonest(rows: DataFrame, ranks: _Ranks) -> np.ndarray:
    """Keys of the most frequent rows, COMMON at most, from the most frequent on."""
    common = rows.filter(F.col("n") >= ranks.least(COMMON)).select("key", "n").toArrow()
    return common.column("key").to_numpy().view(np.uint64)[np.argsort(-common.column("n").to_numpy(), kind="stable")]


def _signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


def train(docs: DataFrame, depth: int = DEPTH) -> Tree:
    """The tree of all texts of docs (text); null texts are empty."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("text").cast("string").alias("text"))
    level = written(docs.mapInArrow(_word_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    proper = level.filter(F.col("key") != _signed(BEGIN))
    whole = proper.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    tree = Tree(whole["n"], whole["kinds"])
    chance = (F.col("n") + 0.5) / F.lit(tree.n + 0.5 * (tree.kinds + 1))
    tree.words = proper.select("key", "n", F.lit(1).alias("known"), (F.log10(chance) - tree.unknown).alias("base"), F.lit(0.0).alias("value"))
    # Runs of one length: key, n, chance of the last token after the others, and whether that is the end of a text.
    level = level.select("key", "n", chance.alias("chance"), (F.col("key") == _signed(END)).alias("ends"))
    levels: list[DataFrame] = []
    for length in range(1, depth + 1):
        open_ = written(level.filter((F.col("n") >= LEAST) & ~F.col("ends")).select("key", "n"), "open")
        candidates = marks(open_)
        if not candidates.map.any():
            break
        ranks, opened = _Ranks(level), _Ranks(open_).least(HOT_JOIN)
        frequent = np.sort(open_.filter(F.col("n") >= opened).toArrow().column("key").to_numpy().view(np.uint64))
        common = _commonest(level, ranks)
        buckets = max(LEAST_BUCKETS, -(-tree.n // BUCKET_TOKENS))
        sent = docs.mapInArrow(_run_counts(length, candidates, frequent, common, buckets), _COUNTS)
        counts = sent.groupBy("bucket").applyInArrow(_repeated_runs(common), "key long, context long, suffix long, n long")
        counts = written(counts, "runs")
        suffixes = level.select(F.col("key").alias("suffix"), "n", F.col("chance").alias("shorter"), "ends")
        hot, seldom = _split(suffixes, ranks.least(HOT_JOIN))
        parts = []
        for part in range(PASSES):
            own = F.col("suffix").bitwiseAND(F.lit(PASSES - 1)) == part
            looked_up = _looked_up(counts.filter(own), hot.filter(own), seldom.filter(own), "suffix")
            parts.append(written(DataFrame.unionByName(*looked_up).drop("suffix"), "seen"))
        drop(counts)
        seen = reduce(DataFrame.unionByName, parts)
        often, seldom = _looked_up(seen, *_split(open_.select(F.col("key").alias("context"), "n", F.col("n").alias("all")), opened), "context")
        grown = _weighed(often, _grouped).unionByName(_weighed(seldom, _windowed))
        grown = written(grown if length < depth else _modelled(grown), "level")
        for part in (*parts, hot, open_):
            drop(part)
        if length > 1:  # its chances were for this length
            levels[-1] = written(_modelled(level), "level")
            drop(level)
        levels.append(grown)
        level = grown
    plain = [F.lit(0).alias("known"), F.lit(0.0).alias("base")]
    for level in levels:
        tree.runs.append(level.filter("value is not null").select("key", "n", *plain, "value"))
        tree.runs.append(level.filter("of is not null").select(F.col("of").alias("key"), F.col("all").alias("n"), *plain, F.col("share").alias("value")))
    return tree


def _modelled(level: DataFrame) -> DataFrame:
    """What the model keeps of runs of one length."""
    return level.filter("value is not null").select("key", "n", "value", "of", "all", "share")


class _Frequent(_Places):
    """Known counts, base and value sums of the most frequent runs, by key."""

    def __init__(self, rows: pa.Table):
        keys, at = np.unique(rows.column("key").to_numpy().view(np.uint64), return_inverse=True)
        super().__init__(keys)
        sums = [np.bincount(at, rows.column(c).to_numpy(), len(keys)) for c in ("known", "base", "value")]
        #: Those of the three that any run has.
        self.sums = {c: (own.astype(np.uint8) if c == 0 else own) for c, own in enumerate(sums) if own.any()}


_SENT = "piece long, n int, bucket int, counts binary, keys binary, ids array<long>, digests array<long>, sizes array<int>, sums binary"
_SUMS = "piece long, ids array<long>, digests array<long>, sizes array<int>, sums binary"
_PARTS = "doc_id long, digest long, rows long, n_tokens long, known double, base double, value double"


def _sent(lengths: range, part: int, passes: int, unknown: float, frequent: _Frequent, others: Marks, common: np.ndarray, buckets: int):
    """Per piece of texts a row that names them, with what their tokens, if runs of one are asked for, and frequent runs of these lengths add up to, and for
    each bucket of keys a row with the other runs that the model may hold: how many each text has, and the runs text by text, as their two words if of
    two, else as keys. Of `passes` over the keys this is `part`."""
    names = _Names(common)

    def row(piece: int, n: int, bucket: int, counts: bytes | None, keys: bytes | None, named: list[pa.Array], sums: bytes | None) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in named] or [pa.nulls(1, pa.list_(t)) for t in (pa.int64(), pa.int64(), pa.int32())]
        return pa.RecordBatch.from_arrays(
            [pa.array([piece], pa.int64()), pa.array([n], pa.int32()), pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in (counts, keys)), *lists, pa.array([sums], pa.binary())],
            names=["piece", "n", "bucket", "counts", "keys", "ids", "digests", "sizes", "sums"],
        )

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, pieces = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at_row, keys, doc, left in _texts(batch.column("text")):
                n = int(doc[-1]) + 1
                named = [batch.column(c).slice(at_row, n) for c in ("doc_id", "digest")]
                size = np.bincount(doc, minlength=n) - 1
                # A name of the place and of the texts: parts of pieces that were made anew from other rows do not meet.
                place = np.arange(n, dtype=np.uint64) + tokens.mix(np.array([made + pieces], np.uint64))
                piece = int(tokens.mix(named[1].to_numpy().view(np.uint64) + tokens.mix(place)).sum().view(np.int64))
                pieces += 1
                sums = np.zeros((3, n))
                if 1 in lengths:
                    sums[1] = size * unknown
                run_of, run_key, run_at = [], [], []
                words = keys
                for _ in range(1, lengths[0]):
                    keys = longer(keys)
                for length in lengths:
                    inside = left[: len(keys)] >= length
                    if passes > 1:
                        inside &= (keys & np.uint64(passes - 1)) == part
                    inside = np.flatnonzero(inside)
                    own = keys[inside]
                    at, place = frequent.find(own)
                    of = doc[inside[at]]
                    for c, values in frequent.sums.items():
                        sums[c] += np.bincount(of, values[place], n)
                    rest = np.ones(len(own), bool)
                    rest[at] = False
                    inside, own = inside[rest], own[rest]
                    may = others[own]
                    run_of.append(doc[inside[may]])
                    run_key.append(own[may])
                    run_at.append(inside[may])
                    keys = longer(keys)
                run_of, run_key, run_at = (np.concatenate(x) for x in (run_of, run_key, run_at))
                bucket = _bucket(run_key, buckets)
                order = np.argsort(bucket * n + run_of, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                run_of, run_key = run_of[order], run_key[order]
                if lengths == _PAIRS:
                    pairs = [(own, names.numbers(own)) for own in (words[run_at[order] + i] for i in range(2))]
                yield row(piece, n, at_row % buckets, None, None, [*named, pa.array(size.astype(np.int32))], sums.tobytes())
                for b in np.flatnonzero(np.diff(ends)).tolist():
                    own = slice(ends[b], ends[b + 1])
                    counts = np.bincount(run_of[own], minlength=n).astype(np.int32)
                    content = b"".join(_sized(names.packed(x[own], i[own])) for x, i in pairs) if lengths == _PAIRS else run_key[own].tobytes()
                    yield row(piece, n, b, _packed(counts.tobytes()), content, [], None)

    return of_batches


_PAIRS = range(2, 3)


def _sized(content: bytes) -> bytes:
    return len(content).to_bytes(8, "little") + content


def _pair_keys(common: np.ndarray, content: bytes, n: int) -> np.ndarray:
    """Keys of the n runs of two words that `_sent` packed."""
    end = 8 + int.from_bytes(content[:8], "little")
    return join_keys(_keys(common, content[8:end], n), _keys(common, content[end + 8 :], n))


def _bucket_sums(lengths: range, common: np.ndarray):
    """What the runs sent to one bucket add to the texts of their pieces; keys that the model does not hold add nothing."""

    def of_bucket(sent: pa.Table, model: pa.Table) -> pa.Table:
        known = _Frequent(model)
        packed = []
        for counts, keys, n, sums in zip(*(sent.column(c).to_pylist() for c in ("counts", "keys", "n", "sums")), strict=True):
            if sums is None:
                counts = np.frombuffer(_unpacked(counts, 4 * n)[0], np.int32)
                keys = _pair_keys(common, keys, int(counts.sum())) if lengths == _PAIRS else np.frombuffer(keys, np.uint64)
                at, place = known.find(keys)
                of = np.repeat(np.arange(n), counts)[at]
                own = np.zeros((3, n))
                for c, values in known.sums.items():
                    own[c] = np.bincount(of, values[place], n)
                sums = own.tobytes()
            packed.append(_packed(sums))
        return sent.select(["piece", "ids", "digests", "sizes"]).append_column("sums", pa.array(packed, pa.binary()))

    return of_bucket


def _piece_sums(parts: pa.Table) -> pa.Table:
    """The texts of one piece with all that buckets have added to them."""
    named = np.flatnonzero(parts.column("ids").is_valid().to_numpy())
    if len(named) != 1:
        raise ValueError("rows of a piece of texts changed while it was scored; write the table before")
    ids, digests, sizes = (parts.column(c)[int(named[0])].values for c in ("ids", "digests", "sizes"))
    n = len(ids)
    sums = np.zeros((3, n))
    for content in parts.column("sums").to_pylist():
        sums += np.frombuffer(_unpacked(content, 24 * n)[0], np.float64).reshape(3, n)
    return pa.table({"doc_id": ids, "digest": digests, "rows": np.ones(n, np.int64), "n_tokens": sizes.cast(pa.int64()), **dict(zip(("known", "base", "value"), sums, strict=True))})


def _sums(docs: DataFrame, tree: Tree, lengths: range, part: int, passes: int, hot: int) -> DataFrame:
    """What runs of these lengths add to the texts of docs (doc_id, digest, text); with runs of one token also how many rows and tokens there are."""
    model = tree.rows(lengths).filter(F.col("key").bitwiseAND(F.lit(passes - 1)) == part)
    ranks = _Ranks(model)
    least = ranks.least(hot // passes)
    others = ranks.below(least)
    frequent = _Frequent(model.filter(F.col("n") >= least).select("key", "known", "base", "value").toArrow())
    model = model.filter(F.col("n") < least).drop("n")
    buckets = max(LEAST_BUCKETS, -(-others // BUCKET_ROWS))
    common = _commonest(tree.words, _Ranks(tree.words)) if lengths == _PAIRS else np.zeros(0, np.uint64)
    sent = docs.mapInArrow(_sent(lengths, part, passes, tree.unknown, frequent, marks(model.select("key"), others), common, buckets), _SENT)
    model = model.withColumn("bucket", F.expr(f"cast(shiftrightunsigned(key, 48) * {buckets} div 65536 as int)"))
    sums = sent.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(_bucket_sums(lengths, common), _SUMS)
    whole = sums.groupBy("piece").applyInArrow(_piece_sums, _PARTS)
    if 1 not in lengths:
        whole = whole.withColumns({"rows": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")})
    return written(whole, "sums")


def score(docs: DataFrame, tree: Tree, hot: int = HOT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Rows with the same doc_id and text have the same score: they are added up together and dealt out again. Texts of one doc_id are told apart by a 64-bit hash.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.col("text").cast("string").alias("text"))
    passes = [(range(1, 2), 0, 1), *((range(2, 3), part, PASSES) for part in range(PASSES)), (range(3, tree.longest + 1), 0, 1)]
    parts = reduce(DataFrame.unionByName, [_sums(docs, tree, *each, hot) for each in passes if each[0] and each[0][-1] <= tree.longest])
    whole = parts.groupBy("doc_id", "digest").agg(*[F.sum(c).alias(c) for c in ("rows", "n_tokens", "known", "base", "value")])
    whole = whole.withColumn("each", F.explode(F.array_repeat("rows", F.col("rows").cast("int"))))
    base = F.col("base") / F.col("rows")
    return whole.select(
        "doc_id", (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"), F.round(F.col("known") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(tree.n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("value") / F.col("rows")).alias("score"),
    )


def modelled(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """Scores of every row of docs (doc_id, text) by the tree of those whose crc32(doc_id as text) mod `folds` is not `held`.

    Tokens are the words of the whole text, A-Z lower-cased, and one end. Null and empty texts are the end alone. Rows without doc_id are scored, not held out
    and not learned from. Repeated rows each count and each come back. Other columns are ignored. Words are told apart by 64-bit hashes.
    With nothing to learn from every token has chance 1; an empty table gives an empty result.
    """
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    with shuffles_deleted(docs.sparkSession):
        scores = score(docs, train(docs.filter(rest != held)))
    return scores.select("doc_id", F.coalesce(rest == held, F.lit(False)).alias("held_out"), *scores.columns[1:])
