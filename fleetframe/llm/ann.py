"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree searched best bin first.

Vectors get one more coordinate, sqrt(M - |x|^2) with M the largest squared length, and queries a zero there; then the nearest vector in Euclidean
distance has the largest inner product. The tree is fitted on a bounded sample; every row is put into a leaf. Leaves that get too many rows are split
again, each by a subtree that a task fits on a bounded sample of the leaf's own rows, until leaves are small or hold copies only. A query walks the tree through a
priority queue of nodes by distance and visits leaves in that order. How many leaves it visits is calibrated: some queries are answered by brute
force over all rows, and visits widen until those find the aimed share of their neighbours. A query whose leaves hold too few other rows for a full
answer visits more.

Rows and the queries that visit them meet in blocks of neighbouring leaves; a block gives each query its best rows once, however many of its leaves
the query visits. A leaf that holds a third of all rows is many blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, ship, written

#: Rows that the tree is fitted on (smallest hash of vec_id): the bound of the fit.
SAMPLE = 20_000
#: Children of a node, rows of the whole table meant for a leaf, sample rows that a leaf needs.
BRANCH, LEAF_ROWS, LEAF_SAMPLE = 8, 400, 12
#: Leaves that the tree, which travels to all tasks, is meant for: beyond MOST_LEAVES * LEAF_ROWS rows leaves get larger. Rounds of splitting.
MOST_LEAVES, ROUNDS = 1 << 16, 8
#: Queries answered by brute force, and the share of their neighbours that the visited leaves must hold.
CALIBRATION, RECALL = 200, 0.95
#: Rows, and queries, of one block: neighbouring leaves share blocks, large leaves are cut into several.
CHUNK = 4096
QUERIES_AT_ONCE = 256
KMEANS_ROUNDS = 8


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points * points).sum(1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(1)


class Tree:
    """Nodes with their children's centres; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaf_size: int, top: float):
        self.top = top
        self.children: list[np.ndarray | None] = []
        self.centres: list[np.ndarray | None] = []
        random = np.random.default_rng(7)
        stack = [(self._node(), self.lift(sample))]
        while stack:
            node, rows = stack.pop()
            if len(rows) > leaf_size:
                centres, of = self._split(rows, random)
                if len(centres) > 1:
                    kids = np.array([self._node() for _ in centres])
                    self.children[node], self.centres[node] = kids, centres
                    stack += [(int(k), rows[of == i]) for i, k in enumerate(kids)]
        self.number()

    def number(self) -> None:
        """Number the leaves so that neighbours have neighbouring numbers."""
        self.leaf, self.node_of = [-1] * len(self.children), []
        stack = [0]
        while stack:
            node = stack.pop()
            if self.children[node] is None:
                self.leaf[node] = len(self.node_of)
                self.node_of.append(node)
            else:
                stack += self.children[node].tolist()
        self.n_leaves = len(self.node_of)

    def graft(self, node: int, subtree: list[tuple[int, list[int], list[float]]]) -> None:
        """Put a subtree, (node, children, their centres) of its inner nodes, in the place of a leaf's node. Leaves have to be numbered anew."""
        own = {0: node}
        for at, kids, centres in sorted(subtree):
            for kid in kids:
                own[kid] = self._node()
            self.children[own[at]] = np.array([own[kid] for kid in kids])
            self.centres[own[at]] = np.array(centres, np.float64).reshape(len(kids), -1)

    def _node(self) -> int:
        self.children.append(None)
        self.centres.append(None)
        return len(self.children) - 1

    def lift(self, rows: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top - (rows * rows).sum(1), 0))
        return np.column_stack([rows, rest])

    @staticmethod
    def _split(rows: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        distinct = np.unique(rows, axis=0)
        centres = distinct[random.permutation(len(distinct))[:BRANCH]]
        of = np.zeros(len(rows), np.int64)
        for _ in range(KMEANS_ROUNDS):
            of = _distances(rows, centres).argmin(1)
            used = np.unique(of)
            centres = np.stack([rows[of == i].mean(0) for i in used])
        of = _distances(rows, centres).argmin(1)
        used, of = np.unique(of, return_inverse=True)
        return centres[used], of

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        lifted, out = self.lift(rows), np.zeros(len(rows), np.int64)
        stack = [(0, np.arange(len(rows)))]
        while stack:
            node, own = stack.pop()
            if self.children[node] is None:
                out[own] = self.leaf[node]
            elif len(own):
                of = _distances(lifted[own], self.centres[node]).argmin(1)
                stack += [(int(k), own[of == i]) for i, k in enumerate(self.children[node])]
        return out

    def order(self, query: np.ndarray, visits: int, counts: dict[int, int] | None = None, need: int = 0) -> list[int]:
        """The first `visits` leaves of a query, best bin first, and more until they hold `need` rows by `counts` or no leaf is left."""
        point = np.append(query, 0.0)[None, :]
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < visits or held < need):
            _, node = heapq.heappop(queue)
            if self.children[node] is None:
                found.append(self.leaf[node])
                held += counts.get(self.leaf[node], 0) if counts else 0
            else:
                for d, kid in zip(_distances(point, self.centres[node])[0].tolist(), self.children[node].tolist(), strict=True):
                    heapq.heappush(queue, (d, kid))
        return found


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, each summed from the first coordinate to the last, so that equal vectors have equal products."""
    total = np.zeros((len(queries), len(rows)))
    for d in range(rows.shape[1]):
        total += queries[:, d, None] * rows[None, :, d]
    return total


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, largest first, ties to the smaller id; minus infinity takes no part."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    at = at[np.lexsort((ids[at], -score[at]))][:k]
    return at[score[at] > -np.inf]


def _rows(found: list[tuple]) -> list[pa.Array]:
    n = [len(s) for _, _, s in found]
    query = np.repeat(np.array([q for q, _, _ in found], np.int64), n)
    ids = np.concatenate([i for _, i, _ in found]) if found else np.zeros(0, np.int64)
    score = np.concatenate([s for _, _, s in found]) if found else np.zeros(0)
    return [pa.array(query), pa.array(ids.astype(np.int64)), pa.array(score)]


def _assigned(tree: Tree, dim: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_matrix(batch.column("v"), dim))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf.astype(np.int32))], names=["vec_id", "v", "leaf"])

    return of_batches


_SUBTREE = pa.schema([("leaf", pa.int32()), ("node", pa.int32()), ("kids", pa.list_(pa.int32())), ("centres", pa.list_(pa.float64()))])


def _subtrees(top: float, dim: int):
    """The inner nodes of a tree fitted on the drawn rows of one leaf."""

    def of_leaf(drawn: pa.Table) -> pa.Table:
        drawn = drawn.sort_by("vec_id")
        leaf, leaves = drawn.column("leaf")[0].as_py(), drawn.column("leaves")[0].as_py()
        tree = Tree(_matrix(drawn.column("v"), dim), math.ceil(drawn.num_rows / leaves), top)
        inner = [n for n, kids in enumerate(tree.children) if kids is not None]
        rows = [[leaf] * len(inner), inner, [tree.children[n].tolist() for n in inner], [tree.centres[n].ravel().tolist() for n in inner]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(rows, _SUBTREE.types, strict=True)], schema=_SUBTREE)

    return of_leaf


def _placed(tree: Tree, rows: DataFrame, dim: int, total: int) -> tuple[DataFrame, dict[int, int]]:
    """Every row with its leaf, and the rows of each leaf; the tree grows where leaves hold more than twice the rows meant for them."""
    size = max(LEAF_ROWS, math.ceil(total / MOST_LEAVES))
    tried: set[int] = set()
    for turn in range(ROUNDS + 1):
        placed = written(rows.mapInArrow(_assigned(tree, dim), "vec_id long, v array<double>, leaf int"), "leaves")
        counts = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
        plan = []
        for leaf, n in counts.items():
            if n > 2 * size and tree.node_of[leaf] not in tried and turn < ROUNDS:
                drawn = min(SAMPLE, n, 2 * LEAF_SAMPLE * math.ceil(n / size))
                plan.append((leaf, drawn / n * (1 << 30), max(2, min(math.ceil(n / size), drawn // LEAF_SAMPLE))))
        if not plan:
            break
        large = F.broadcast(rows.sparkSession.createDataFrame(plan, "leaf int, below double, leaves int"))
        drawn = placed.join(large, "leaf").filter(F.pmod(F.xxhash64(F.lit("grow"), "vec_id"), F.lit(1 << 30)) < F.col("below"))
        drawn = drawn.dropDuplicates(["leaf", "vec_id"]).select("leaf", "vec_id", "v", "leaves")
        subtrees: dict[int, list] = {}
        for r in drawn.groupBy("leaf").applyInArrow(_subtrees(tree.top, dim), "leaf int, node int, kids array<int>, centres array<double>").collect():
            subtrees.setdefault(r["leaf"], []).append((r["node"], r["kids"], r["centres"]))
        tried |= {tree.node_of[leaf] for leaf, _, _ in plan}
        if not subtrees:
            break
        for leaf, subtree in sorted(subtrees.items()):
            tree.graft(tree.node_of[leaf], subtree)
        tree.number()
        drop(placed)
    return placed, counts


def _exact(ids: np.ndarray, queries: np.ndarray, k: int, dim: int):
    """The k best rows of a batch for each of a few queries, with their leaves."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            score = _products(queries, _matrix(batch.column("v"), dim))
            score[ids[:, None] == own[None, :]] = -np.inf
            best = [_top(row, own, k) for row in score]
            leaves = np.concatenate([leaf[at] for at in best]).astype(np.int32)
            arrays = _rows([(q, own[at], row[at]) for q, at, row in zip(ids.tolist(), best, score, strict=True)])
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(leaves)], names=["query_id", "vec_id", "score", "leaf"])

    return of_batches


def _visits(tree: Tree, visits: int, k: int, counts: dict[int, int], group_of: dict[int, int], chunks: dict[int, int], dim: int):
    """A row for each query, group of leaves that it visits and chunk of that group, with the leaves visited in it.

    Leaves are visited until they hold k rows besides the `own` rows of the query's id."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, own_rows = _matrix(batch.column("v"), dim), batch.column("own").to_pylist()
            for low in range(0, len(queries), 512):
                at, groups, parts, leaves = [], [], [], []
                for i in range(low, min(low + 512, len(queries))):
                    by: dict[int, list[int]] = {}
                    for leaf in tree.order(queries[i], visits, counts, k + own_rows[i]):
                        if leaf in group_of:
                            by.setdefault(group_of[leaf], []).append(leaf)
                    for group, own in by.items():
                        n = chunks[group]
                        at += [i] * n
                        groups += [group] * n
                        parts += range(n)
                        leaves += [own] * n
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(rows),
                        batch.column("v").take(rows),
                        pa.array(groups, pa.int32()),
                        pa.array(parts, pa.int32()),
                        pa.array(leaves, pa.list_(pa.int32())),
                    ],
                    names=["vec_id", "v", "group", "chunk", "leaves"],
                )

    return of_batches


def _block(k: int, dim: int):
    def of_group(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if queries.num_rows and rows.num_rows:
            ids, leaf, vectors = rows.column("vec_id").to_numpy(), rows.column("leaf").to_numpy(), _matrix(rows.column("v"), dim)
            own, points = queries.column("vec_id").to_numpy(), _matrix(queries.column("v"), dim)
            visited = [set(x) for x in queries.column("leaves").to_pylist()]
            at_leaf = {x: np.flatnonzero(leaf == x) for x in np.unique(leaf).tolist()}
            for low in range(0, len(own), QUERIES_AT_ONCE):
                part = range(low, min(low + QUERIES_AT_ONCE, len(own)))
                score = np.full((len(part), len(ids)), -np.inf)
                for x, cells in at_leaf.items():
                    asking = np.array([i - low for i in part if x in visited[i]], np.int64)
                    if len(asking):
                        score[asking[:, None], cells] = _products(points[low + asking], vectors[cells])
                score[own[part.start : part.stop, None] == ids[None, :]] = -np.inf
                for i in part:
                    best = _top(score[i - low], ids, k)
                    found.append((int(own[i]), ids[best], score[i - low][best]))
        return pa.Table.from_arrays(_rows(found), names=["query_id", "vec_id", "score"])

    return of_group


def _groups(counts: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """Leaves dealt to groups of about CHUNK rows, neighbours together; and the number of chunks of each group (a large leaf has several)."""
    group_of: dict[int, int] = {}
    rows: list[int] = []
    for leaf, n in sorted(counts.items()):
        if not rows or rows[-1] + n > CHUNK:
            rows.append(0)
        group_of[leaf] = len(rows) - 1
        rows[-1] += n
    return group_of, {g: -(-n // CHUNK) for g, n in enumerate(rows)}


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: no null id or vector, no null or non-finite coordinate, not all zero, of the commonest length."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(fine)


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k rows with the largest inner product found for each query row (vec_id divisible by `every`), its own id left out.

    vectors needs vec_id and embedding; other columns are ignored. Result: query_id, rank (from 1), vec_id, score (double, on the original
    vectors), nearest first, ties to the smaller vec_id. A query gets k rows, or all candidates if there are fewer. Null ids and vectors, zero vectors, null or non-finite coordinates and
    lengths other than the commonest one take no part. Rows that repeat a vec_id all are candidates, except for queries of that id. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = written(usable(vectors), "vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top"))
    common = sizes.orderBy(F.desc("n"), "dim").limit(1).collect()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total, top = common[0]["dim"], common[0]["n"], common[0]["top"]
    rows = rows.filter(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    drawn = np.array([r["v"] for r in sample.select("v").collect()], np.float64)
    leaves = max(1, min(math.ceil(total / LEAF_ROWS), len(drawn) // LEAF_SAMPLE))
    tree = Tree(drawn, math.ceil(len(drawn) / leaves), top)

    placed, counts = _placed(tree, rows, dim, total)
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    chosen = queries.orderBy(F.xxhash64(F.lit("calibrate"), "vec_id"), "vec_id").limit(CALIBRATION).collect()
    visits = _calibrated(tree, placed, chosen, k, dim) if tree.n_leaves > 1 else 1

    group_of, chunks = _groups(counts)
    of_leaf = spark.createDataFrame([(leaf, g, chunks[g]) for leaf, g in group_of.items()], "leaf int, group int, chunks int")
    repeats = written(queries.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own")).filter("own > 1"), "repeats")
    queries = queries.join(repeats, "vec_id", "left").select("vec_id", "v", F.coalesce("own", F.lit(1)).alias("own"))
    asked = queries.mapInArrow(_visits(tree, visits, k, counts, group_of, chunks, dim), "vec_id long, v array<double>, group int, chunk int, leaves array<int>")
    asked = written(asked, "visits")
    loads = {r["group"]: -(-r["n"] // CHUNK) for r in asked.filter("chunk = 0").groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    of_queries = spark.createDataFrame(sorted(loads.items()), "group int, parts int")

    left = asked.join(F.broadcast(of_queries), "group").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).drop("parts")
    right = placed.join(F.broadcast(of_leaf), "leaf").join(F.broadcast(of_queries), "group")
    right = right.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("vec_id", "v", "leaf", "group", "chunk", "part")
    key = ["group", "chunk", "part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_block(k, dim), "query_id long, vec_id long, score double")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score"))), 1, k)
    return (
        found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("pos", "x"))
        .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    )


def _calibrated(tree: Tree, placed: DataFrame, chosen: list, k: int, dim: int) -> int:
    """The number of leaves after which the chosen queries have met RECALL of their true neighbours."""
    if not chosen:
        return 1
    ids, queries = np.array([r["vec_id"] for r in chosen], np.int64), np.array([r["v"] for r in chosen], np.float64)
    best = placed.mapInArrow(_exact(ids, queries, k, dim), "query_id long, vec_id long, score double, leaf int")
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "leaf"))), 1, k)
    truth = {r["query_id"]: [x["leaf"] for x in r["best"]] for r in best.groupBy("query_id").agg(top.alias("best")).collect()}
    met = np.zeros(tree.n_leaves + 1, np.int64)
    for own, query in zip(ids.tolist(), queries, strict=True):
        place = {leaf: i for i, leaf in enumerate(tree.order(query, tree.n_leaves))}
        np.add.at(met, [place[leaf] + 1 for leaf in truth.get(own, [])], 1)
    share = np.cumsum(met) / max(met.sum(), 1)
    return max(1, int(np.searchsorted(share, RECALL)))
