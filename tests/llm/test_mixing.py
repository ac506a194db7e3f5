import random

from fleetframe.llm import mixing


def fill(sizes, share=1.5, weights=(3, 1, 2), most=2):
    """Targets by the definition: share out, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total, given = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            take = min(left * weight[s] / total, most * sizes[s] - target[s])
            target[s] += take
            given += take
            if target[s] >= most * sizes[s] - 1e-9:
                open_.discard(s)
        left -= given
    return target


def test_targets_and_taken_words(docs_of, monkeypatch):
    rng = random.Random(5)
    for limit in (20_000, 7):
        monkeypatch.setattr(mixing, "RANGE_ROWS", limit)
        sources = ["é", "a", "B", None, "", "zz", "big"]
        rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 400])), "en", rng.choice(sources + ["big"] * 4)) for i in range(300)]
        got = mixing.mixture(docs_of(rows)).collect()
        sizes = {}
        for _, t, _, s in rows:
            sizes[s] = sizes.get(s, 0) + len(t.split())
        want, taken = fill(sizes), dict.fromkeys(sizes, 0)
        assert len(got) == 300
        for r in got:
            assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixture(docs_of(rows)).collect()), key=repr)


def test_mixed_rows_hold_the_taken_words(docs_of):
    rows = [(i, " ".join(f"w{i}-{j}" for j in range(5 + i)), "en", "ab"[i % 2]) for i in range(20)] + [(30, None, "en", "a"), (31, "", None, None)]
    docs = docs_of(rows)
    taken = {r.doc_id: r.taken for r in mixing.mixture(docs).collect()}
    got, words = mixing.mixed(docs).collect(), {}
    texts = dict((r[0], r[1]) for r in rows)
    for r in got:
        assert r.n_words == len(r.text.split()) and texts[r.doc_id].startswith(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
    assert {i: n for i, n in taken.items() if n} == words
    assert mixing.mixed(docs_of([])).collect() == [] and mixing.mixture(docs_of([])).collect() == []
    twice = docs_of([(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "c", "en", None)])
    assert sum(r.taken for r in mixing.mixture(twice).collect()) in (7, 8)
