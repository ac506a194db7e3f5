import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetframe.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, best=20):
    """Rows by the formulas, all documents scored for all items."""
    counts = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    rows = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, math.inf if d is None else d))
        rows += [(item, rank, None if d == math.inf else d, -s) for rank, (s, d) in enumerate(sorted(found)[:best], 1)]
    return sorted(rows, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "item_id long, text string, doc_id int, `a.b` string")


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["Éa", "ñ", "A1", "x_y", "don't", " "]
    weight = [1 / (i + 1) for i in range(len(words))]
    docs = []
    for i in range(n):
        text = " ".join(rng.choices(words, weight, k=rng.choice([0, 1, 3, 20, 80])))
        docs.append((i if rng.random() < 0.97 else None, text if rng.random() < 0.97 else None))
    docs += docs[5:25] * 3 + [(n + 1, "w1 " * 5000), (n + 2, "...")]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(words, weight, k=rng.choice([1, 4, 30])))) for k in range(25)]
    return docs, items + [(30, "w1 w1 w1"), (31, ""), (32, None), (33, "!?"), (34, "nowhere"), (None, "w3 W3"), (5, "w0 again"), (35, docs[3][1])]


@pytest.mark.parametrize(("rows", "best"), [(16_384, 20), (37, 20), (50, 3)])
def test_equals_brute_force(spark, docs_of, monkeypatch, rows, best):
    rng = random.Random(rows)
    docs, items = corpus(rng, 400)
    monkeypatch.setattr(ranking, "SHARD_ROWS", rows)
    got = ranking.ranked(docs_of(docs), items_of(spark, items), best).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == brute(docs, items, best)


def test_parts_of_items(spark, docs_of, monkeypatch):
    docs, items = corpus(random.Random(9), 120)
    monkeypatch.setattr(ranking, "PART_BYTES", 300)
    got = ranking.ranked(docs_of(docs), items_of(spark, items)).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == brute(docs, items)


def test_range_maximum_tables():
    rng = np.random.default_rng(1)
    doc, term = np.divmod(np.sort(rng.choice(900, 300, replace=False)), 9)
    shard = ranking.Shard(doc, term, rng.integers(1, 50, 300), 100)
    for _ in range(300):
        t = rng.integers(9)
        a, b = np.searchsorted(shard.key, [t * 100, (t + 1) * 100])
        low, high = sorted(rng.integers(a, b + 1, 2).tolist())
        at, impact = shard.largest(np.array([low]), np.array([high]))
        assert impact[0] == (shard.impact[low:high].max() if high > low else 0)
        assert high == low or (low <= at[0] < high and shard.impact[at[0]] == impact[0])


def test_search_leaves_most_documents_unscored():
    """A few documents hold an item's rare terms; the rest is ruled out by bounds."""
    rng = np.random.default_rng(2)
    n = 4000
    term = np.concatenate([np.zeros(n, np.int64), np.ones(40, np.int64)])
    doc = np.concatenate([np.arange(n), rng.choice(n, 40, replace=False)])
    shard = ranking.Shard(doc, term, rng.integers(500, 900, len(doc)), n)
    best = ranking._Best(20)
    ids = np.arange(n).astype(object)
    scored = ranking._search(shard, ids, np.array([0, 1]), np.array([3, 500]), best)
    score = np.zeros(n, np.int64)
    np.add.at(score, shard.doc, shard.impact * np.where(shard.key < n, 3, 500))
    assert best.rows == sorted((-int(s), int(i)) for i, s in enumerate(score))[:20]
    assert scored < 400


def test_odd_tables(spark, docs_of):
    some = items_of(spark, [(1, "a b")])
    assert ranking.ranked(docs_of([]), some).collect() == []
    assert ranking.ranked(docs_of(["a b", None]), items_of(spark, [])).collect() == []
    assert ranking.ranked(docs_of([None, "", "?"]), some).collect() == []
    assert [(r.doc_id, r["rank"]) for r in ranking.ranked(docs_of(["A b", "c"]), some).collect()] == [(0, 1)]
