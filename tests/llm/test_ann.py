import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetframe.llm import ann


def brute(rows, k, every=20):
    good = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            scored = []
            for i, w in good:
                if i != q:
                    total = 0.0
                    for a, b in zip(v, w):
                        total += a * b
                    scored.append((-total, i))
            out[q] = [(n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.fixture
def vectors(spark):
    def build(rows):
        return spark.createDataFrame([(i, v, 1, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, leaf int, v string")

    return build


def table(seed, n):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]) for i in range(n)]
    same = rows[0][1]
    rows += [(n + i, list(same)) for i in range(n // 3)]
    rows += [(5000, None), (5020, [0.0] * 8), (5040, [None, *[1.0] * 7]), (5060, [float("nan"), *[1.0] * 7]), (5080, [float("inf"), *[1.0] * 7]), (5100, [1.0] * 3), (None, [1.0] * 8)]
    return rows


def test_exact_when_all_leaves_are_visited(vectors):
    rows = table(1, 120)
    got = {}
    for r in ann.neighbours(vectors(rows), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == brute(rows, 5)


def test_recall_and_chunks(vectors, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 20)
    monkeypatch.setattr(ann, "CHUNK", 16)
    rows = table(2, 600)
    want, hits, total = brute(rows, 10), 0, 0
    found = {}
    for r in ann.neighbours(vectors(rows), k=10).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
        assert r.rank <= 10
    for q, best in want.items():
        hits += len({i for _, i, _ in best} & found[q].keys())
        total += len(best)
        assert all(found[q][i] == s for _, i, s in best if i in found[q])
    assert found.keys() == want.keys() and hits / total >= 0.9


def test_small_and_empty(vectors):
    assert ann.neighbours(vectors([])).collect() == []
    assert ann.neighbours(vectors([(0, None), (20, [0.0] * 4)])).collect() == []
    assert ann.neighbours(vectors([(0, [1.0] * 4)])).collect() == []
    few = ann.neighbours(vectors([(0, [1.0] * 4), (0, [2.0] * 4), (1, [1.0] * 4)])).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 1), (0, 1)] or sorted((r.query_id, r.vec_id) for r in few) == [(0, 1)]


def test_outliers_among_tight_clusters_get_k_rows(vectors, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 40)
    rng = random.Random(6)

    def around(centre, width):
        v = [x + rng.gauss(0, width) for x in centre]
        return [float(np.float32(10 * x / sum(y * y for y in v) ** 0.5)) for x in v]

    centres = [[abs(rng.gauss(0, 1)) for _ in range(8)] for _ in range(40)]
    rows = [(4 * i, around(centres[i % 40], 0.001)) for i in range(1600)]
    rows += [(9000 + 20 * n, around([-1.0 if d == n else 0.0 for d in range(8)], 0.0)) for n in range(5)]
    rows += [(9500 + 20 * g + j, around([0.0] * (5 + g) + [-1.0] * (3 - g), 0.001)) for g in range(3) for j in range(3)]
    found = {}
    for r in ann.neighbours(vectors(rows)).collect():
        found.setdefault(r.query_id, []).append(r)
    assert found.keys() == {i for i, _ in rows if i % 20 == 0}
    for q, own in found.items():
        assert sorted(r.rank for r in own) == list(range(1, 21)) and len({r.vec_id for r in own} - {q}) == 20


def test_leaves_are_visited_until_they_hold_enough_rows():
    rows = np.random.default_rng(1).normal(size=(300, 8))
    tree = ann.Tree(rows, 10, float((rows * rows).sum(1).max()))
    counts = dict(enumerate(np.bincount(tree.assign(rows), minlength=tree.n_leaves).tolist()))
    for query in rows[:20]:
        every = tree.order(query, tree.n_leaves)
        assert tree.order(query, 2, counts, 1) == every[:2]
        got = tree.order(query, 2, counts, 120)
        assert got == every[: len(got)] and sum(counts[x] for x in got) >= 120 > sum(counts[x] for x in got[:-1])
        assert tree.order(query, 2, counts, 1000) == every


def test_large_leaves_are_split_on_samples_of_their_own_rows(spark, vectors, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 120)
    monkeypatch.setattr(ann, "LEAF_ROWS", 20)
    rng = random.Random(12)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.3))) for x in centres[i % 30]]) for i in range(4000)]
    rows += [(4000 + i, rows[3][1]) for i in range(300)] + [(7, rows[7][1])] * 200
    table = ann.usable(vectors(rows))
    top = max(sum(x * x for x in v) for _, v in rows)
    tree = ann.Tree(np.array([v for _, v in rows[:120]]), 12, top)
    before = tree.n_leaves
    placed, counts = ann._placed(tree, table, 8, len(rows))
    assert before < 4000 / 40 < tree.n_leaves
    assert sum(counts.values()) == len(rows) == placed.count()
    leaf = {r.vec_id: r.leaf for r in placed.distinct().collect()}
    own = tree.assign(np.array([v for _, v in rows]))
    assert all(leaf[i] == at for (i, _), at in zip(rows, own.tolist(), strict=True))
    # What is still large holds one vector many times.
    kinds = {r.leaf: (r.n, r.kinds) for r in placed.groupBy("leaf").agg(F.count("v").alias("n"), F.countDistinct("v").alias("kinds")).collect()}
    assert all(n <= 40 or n - kinds <= 500 and kinds <= 40 for n, kinds in kinds.values())
    assert sum(n > 40 for n, _ in kinds.values()) <= 2
    found, want, hits = {}, brute(rows, 10), 0
    for r in ann.neighbours(vectors(rows), k=10).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    for q, best in want.items():
        assert len(found[q]) >= 1
        # Copies share a score, so neighbours are told by their scores.
        got = sorted(found[q].values(), reverse=True)
        hits += sum(s in got for _, _, s in best)
    assert found.keys() == want.keys() and hits / sum(map(len, want.values())) >= 0.9


def test_bounded_number_of_leaves(vectors, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 5)
    monkeypatch.setattr(ann, "MOST_LEAVES", 10)
    rows = table(3, 900)
    good = [v for i, v in rows if i is not None and i < 5000 and v]
    tree = ann.Tree(np.array(good[:100]), 100, max(sum(x * x for x in v) for v in good))
    _, counts = ann._placed(tree, ann.usable(vectors(rows)).filter("size(v) = 8"), 8, 1200)
    assert 5 < tree.n_leaves < 60 and max(counts.values()) <= 300 + 240
