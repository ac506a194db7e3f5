import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetframe.llm import toxicity


def corpus(seed, n=400):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("the", "and", "win", "ter", "lak") for b in ("er", "on", "ing", "ly", "es", "ou")]
    bad = ["wretch", "scoundrel", "vermin"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 1
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_scores(spark, docs_of):
    rows, labels = corpus(1)
    got = toxicity.classify(docs_of([*rows, (900, None), (901, ""), (None, "some wretch vermin here")]), labelled(spark, labels)).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    known = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert len(held) > 40 and sum(r.predicted == known[r.doc_id] for r in held) / len(held) > 0.97
    assert next(r for r in got if r.doc_id is None).predicted == 1
    assert next(r for r in got if r.doc_id == 900).predicted == 0


def bag(text):
    """Terms with their occurrences: words, and beginnings marked by their length. Own tokeniser, on bytes."""
    found = Counter()
    for word in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
        word = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
        found[0, word] += 1
        for n in (5, 7):
            if len(word) > n:
                found[n, word[:n]] += 1
    return found


class Plain:
    """Everything by the definitions, all documents against all examples, no index."""

    def __init__(self, rows, labels, tunes):
        texts = dict(rows)
        known = {i: t for i, _, t in labels}
        self.bags = {i: bag(t) for i, t in rows}
        fit = [i for i in known if i in texts and not tunes[i]]
        bad = sum(known[i] for i in fit)
        n, toxic = Counter(), Counter()
        for i in fit:
            n.update(set(self.bags[i]))
            toxic.update({t: known[i] for t in self.bags[i]})
        def chi(t):
            expected = n[t] * bad / len(fit)
            return (toxic[t] - expected) ** 2 / (expected * (1 - n[t] / (len(fit) + 1)))
        terms = {t: chi(t) for t in n if t[0] == 0 or chi(t) >= 6}
        df = Counter(t for _, text in rows for t in bag(text))
        self.weight = {t: math.log(1 + len(rows) / df[t]) * (0.1 + 0.9 * min(c / 12, 1) ** 2) for t, c in terms.items()}
        self.stranger = math.log(1 + len(rows)) * 0.1
        self.examples = {i: self.vector(self.bags[i])[0] for i in fit}
        self.toxic = {i: known[i] for i in fit}
        share = sum(known.values()) / len(known)
        self.mass = {1: share / bad, 0: (1 - share) / (len(fit) - bad)}
        self.curve = self.fitted([(self.vote(self.bags[i]), known[i]) for i in sorted(known) if i in texts and tunes[i]])

    def vector(self, counts):
        w = {t: (1 + math.log(c)) * self.weight[t] for t, c in counts.items() if t in self.weight}
        rest = sum((1 + math.log(c)) ** 2 for t, c in counts.items() if t not in self.weight and t[0] == 0) * self.stranger**2
        norm = math.sqrt(sum(v * v for v in w.values()) + rest)
        return {t: v / norm for t, v in w.items()}, bool(w)

    def nearest(self, counts, k=15):
        own, _ = self.vector(counts)
        like = [(-sum(v * e.get(t, 0.0) for t, v in own.items()), i) for i, e in self.examples.items()]
        return [(i, -s) for s, i in sorted(like)[:k] if s < 0]

    def vote(self, counts):
        pull = [(self.mass[self.toxic[i]] / (1 - min(s, 1) + 0.05), self.toxic[i]) for i, s in self.nearest(counts)]
        return sum(p * t for p, t in pull) / sum(p for p, _ in pull) if pull else None

    def fitted(self, votes):
        x = toxicity._logit(np.array([v for v, _ in votes if v is not None]))
        y = np.array([t for v, t in votes if v is not None], float)
        weight = np.where(y == 1, self.mass[1], self.mass[0])
        weight /= weight.sum()
        a, b = 1.0, 0.0
        for _ in range(20000):  # plain descent to the same minimum
            p = 1 / (1 + np.exp(-(a * x + b)))
            da, db = (weight * (p - y) * x).sum() + 1e-4 * (a - 1), (weight * (p - y)).sum() + 1e-4 * b
            a, b = a - 0.3 * da, b - 0.3 * db
        return a, b

    def score(self, counts):
        a, b = self.curve
        chance = 1 / (1 + math.exp(-(a * float(toxicity._logit(np.array([self.vote(counts)]))[0]) + b)))
        same = [self.toxic[i] for i, s in self.nearest(counts) if s > 1 - 1e-9]
        return (chance + 4 * sum(same)) / (1 + 4 * len(same))


def tunes_of(spark, labels):
    ids = spark.createDataFrame([(i,) for i, _, _ in labels], "doc_id long")
    return {r.doc_id: r.t for r in ids.selectExpr("doc_id", f"pmod(xxhash64('tune', doc_id), {toxicity.CALIBRATE}) = 0 AS t").collect()}


@pytest.mark.parametrize("block", [4, 64])
def test_equals_brute_force(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rows, labels = corpus(2)
    rows += [(1000 + i, f"{rows[i][1]} Ünheard wörds {i} of") for i in range(20)] + [(1100, rows[6][1])]
    plain = Plain(rows, labels, tunes_of(spark, labels))
    index = toxicity.train(docs_of(rows), labelled(spark, labels))
    assert dict(zip(index.ids.tolist(), index.toxic.tolist(), strict=True)) == plain.toxic and len(index.vocabulary.terms) == len(plain.weight)
    for r in toxicity.evidence(docs_of(rows), index).collect():
        want = plain.nearest(plain.bags[r.doc_id])
        assert np.allclose(r.cosines, [s for _, s in want], atol=1e-9)
        assert [i for i, s in zip(r.examples, r.cosines) if s > r.cosines[-1] + 1e-9] == [i for i, s in want if s > want[-1][1] + 1e-9]
    a, b = index.curve
    assert np.allclose((a, b), plain.curve, rtol=0.1, atol=0.05)
    plain.curve = (a, b)
    for r in toxicity.score(docs_of(rows), index).collect():
        assert abs(r.score - plain.score(plain.bags[r.doc_id])) < 1e-6 and r.predicted == int(r.score >= 0.5)


@pytest.mark.parametrize("held_by", [1, 2, 8])
def test_rare_toxic_words(spark, docs_of, held_by):
    """Toxic rows by words that stand in a few of them each and nowhere else; exact copies of labelled rows, and texts with one of the words."""
    rng = random.Random(held_by)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rare = ["".join(rng.choices("bcdfghklmnprstvz", k=9)) for _ in range(400 // held_by)]
    rows, labels = [], []
    for i in range(1200):
        words = rng.choices(plain, k=30)
        if i < 400:
            words[rng.randrange(30)] = rare[i % len(rare)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i < 400)))
    copies = [(5000 + i, rows[i][1]) for i in range(1200)]
    docs = docs_of(rows + copies)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, labelled(spark, labels))).collect()}
    tunes = tunes_of(spark, labels)
    assert all(got[5000 + i] == 1 for i in range(400) if not tunes[i])
    assert sum(got[5000 + i] for i in range(400, 1200)) <= 8


def test_texts_without_a_word_of_an_example(spark, docs_of):
    rows, labels = corpus(4)
    index = toxicity.train(docs_of(rows), labelled(spark, labels))
    got = toxicity.score(docs_of([(1, None), (2, ""), (3, "12 34 !"), (4, "zzzz")]), index).collect()
    assert {r.score for r in got} == {index.empty} and index.empty == index.prior
    assert all(r.examples == [] for r in toxicity.evidence(docs_of([(1, None), (4, "zzzz")]), index).collect())


def test_without_labels_and_rows(spark, docs_of):
    none = labelled(spark, [])
    assert [(r.score, r.predicted) for r in toxicity.classify(docs_of(["a b", None]), none).collect()] == [(0.0, 0)] * 2
    assert toxicity.classify(docs_of([]), none).collect() == []
    one_sided = labelled(spark, [(i, 1, 0) for i in range(30)] + [(None, None, None), (3, 1, None)])
    assert all(not math.isnan(r.score) and r.predicted == 0 for r in toxicity.classify(docs_of(["a b"] * 30), one_sided).collect())
    rows, labels = corpus(3)
    index = toxicity.train(docs_of(rows), labelled(spark, labels))
    left = toxicity.without_toxic(docs_of(rows), index)
    bad = {i for i, _, t in labels if t}
    assert "n_chars" in left.columns and len(bad & {r.doc_id for r in left.collect()}) <= 2
    assert left.count() >= 315
