import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleetframe.llm import decontam


def brute(docs, items, percent=80):
    def bag(words):
        k = min(5, len(words))
        out = {}
        for i in range(len(words) - k + 1):
            out[tuple(words[i : i + k])] = out.get(tuple(words[i : i + k]), 0) + 1
        return out

    found = {}
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            target = (item or "").lower().split()
            n = len(target)
            for s in range(len(words) - n + 1 if n else 0):
                a, b = bag(words[s : s + n]), bag(target)
                both = sum(min(c, b.get(x, 0)) for x, c in a.items())
                like = both / (sum(a.values()) + sum(b.values()) - both)
                if like * 100 >= percent and like > found.get((d, i), (0,))[0]:
                    found[d, i] = (like, s)
    return found


def test_matches_brute_force(spark, docs_of, monkeypatch):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijkl") + rng.choice("xyz") + rng.choice("pqrs")
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 16, 24, 40, 60])))) for i in range(25)]
    docs = []
    for d in range(60):
        words = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.randrange(len(part))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((d, " ".join(words)))
    docs += [(100, None), (101, ""), (102, items[3][1].upper())]
    table = spark.createDataFrame([*items, (30, None), (31, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontam.contamination(docs_of(docs), table).collect()}
    want = brute(docs, items)
    # At the limit a fingerprint may lie outside the radius with a chance below 1e-5: none of these does.
    assert got.keys() == want.keys() and len(want) > 15
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)
    clean = {r.doc_id for r in decontam.clean(docs_of(docs), table).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}
    # The same a few windows and pairs at a time, which task memory bounds.
    monkeypatch.setattr(decontam, "WINDOWS", 7)
    monkeypatch.setattr(decontam, "PAIRS", 5)
    index = decontam.Index(*map(list, zip(*items)))
    parts = {(docs[r][0], i): (like, at) for r, i, like, at, *_ in decontam._row_matches(index, 80, pa.array([t for _, t in docs]))}
    assert parts == got


def test_every_fingerprint_within_the_radius_is_listed():
    rng = np.random.default_rng(1)
    near = decontam._near_values()
    for _ in range(300):
        flips = rng.choice(64, rng.integers(0, decontam.RADIUS + 1), replace=False)
        a = np.array([rng.integers(0, 2**63)], np.uint64)
        b = a ^ np.uint64(sum(1 << int(i) for i in flips))
        assert any(x in near[y] for x, y in zip(a.view(np.uint8).tolist(), b.view(np.uint8).tolist()))


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs_of(["a b c d e"]), items).collect() == []
    assert decontam.clean(docs_of(["a b c d e"]), items).count() == 1
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.contamination(docs_of([]), some).collect() == []
    assert [r.item_id for r in decontam.contamination(docs_of([(None, "x a b c d e f"), (5, None)]), some).collect()] == [1]


def likeness(words, target):
    """Weighted Jaccard similarity of two word lists of any lengths."""
    bags = []
    for own in (words, target):
        k = min(5, len(own))
        bags.append(Counter(tuple(own[i : i + k]) for i in range(len(own) - k + 1)))
    return (bags[0] & bags[1]).total() / (bags[0] | bags[1]).total()


def test_documents_shorter_than_an_item(spark, docs_of):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghijkl") + rng.choice("xyz") + rng.choice("pqrs")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 4, 5, 6, 9, 16, 40, 59, 59, 300])]
    items += [(10, "la " * 30 + "end"), (11, items[7][1] + " more words here"), (7, items[7][1])]
    docs = []
    for _, text in items:
        words = text.split()
        for cut in (1, 2, 3, 8, 12):
            for part in (words[:-cut], words[cut:], words[: len(words) // 2] + words[len(words) // 2 + cut :]):
                docs.append((len(docs), " ".join(part).title()))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contamination(docs_of(docs), table).collect()}
    want = brute(docs, items)
    for d, text in docs:
        words = text.lower().split()
        for i, item in items:
            target = item.split()
            if 0 < len(words) < len(target) and (like := likeness(words, target)) >= 0.8 and like > want.get((d, i), (0,))[0]:
                want[d, i] = (like, 0)
    assert got.keys() == want.keys() and len(want) > 40
    assert all(abs(got[k].similarity - want[k][0]) < 1e-12 and got[k].first_word == want[k][1] for k in want)
    short = [r for r in got.values() if r.item_id == 8]
    assert short and all(r.n_words == len(docs[r.doc_id][1].split()) for r in short)
    assert abs(next(r.similarity for r in short if r.n_words == 58) - 54 / 55) < 1e-12
    clean = {r.doc_id for r in decontam.clean(docs_of(docs), table).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


@pytest.mark.parametrize("pairs", [1 << 20, 9])
def test_pairs_are_those_that_share_a_shingle(monkeypatch, pairs):
    monkeypatch.setattr(decontam, "PAIRS", pairs)
    rng = np.random.default_rng(4)
    size = 6
    items = [rng.integers(0, 40, size).astype(np.uint64) for _ in range(9)]
    own = [np.unique(i) for i in items]
    shingles, owner = np.concatenate(own), np.repeat(np.arange(9), [len(s) for s in own])
    order = np.argsort(shingles, kind="stable")
    text = rng.integers(0, 80, 200).astype(np.uint64)
    hit = np.flatnonzero(np.isin(text, shingles))
    low, high = 20, 120
    inside = hit[(hit >= low) & (hit < high + size - 1)]
    got = [(w, i) for ws, its in decontam._sharing((shingles[order], None, owner[order]), text, inside, size, low, high) for w, i in zip(ws.tolist(), its.tolist())]
    want = {(w, i) for w in range(low, high) for i in range(9) if np.isin(text[w : w + size], items[i]).any()}
    assert set(got) == want and 0 < len(want) < 900
    assert pairs == 9 or len(got) == len(want)


def test_few_pairs_are_compared(monkeypatch):
    """Of windows and items that share nothing none is compared, however many items there are."""
    rng = random.Random(6)
    items = [" ".join(f"w{rng.randrange(3000)}" for _ in range(30)) for _ in range(400)]
    text = " ".join([f"w{rng.randrange(3000)}" for _ in range(2000)] + items[7].split() + ["x"] * 50)
    seen = []
    close = decontam.Index.close
    monkeypatch.setattr(decontam.Index, "close", lambda self, of, prints, window, item: seen.extend(window) or close(self, of, prints, window, item))
    found = list(decontam._row_matches(decontam.Index(list(range(400)), items), 80, pa.array([text])))
    assert [(r[1], r[2], r[3]) for r in found] == [(7, 1.0, 2000)]
    assert 0 < len(seen) < 0.001 * 2051 * 400
