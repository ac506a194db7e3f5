import random

from fleetframe.llm import substrings, suffixes


def brute(rows):
    first = {}
    words = [(i, (t or "").split()) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words:
        gone = set()
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone |= set(range(s, s + 50))
        out[i] = (len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc") for _ in range(3))
    passages = [[word() for _ in range(rng.randint(45, 140))] for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            passage = rng.choice(passages)
            if rng.random() < 0.3:
                passage = list(passage)
                passage[rng.randrange(len(passage))] = word()
            parts += passage if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(parts))
    texts += ["z " * 130, "z " * 70, "", None, "  ", "short text", texts[0], " ".join(["a", "b"] * 60)]
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


def found(docs):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.without_repeats(docs).collect()}


def test_removed_words_match_brute_force(docs_of, monkeypatch):
    rows = corpus(4)
    expected = brute(rows)
    assert found(docs_of(rows)) == expected and sum(r[1] for r in expected.values()) > 1000
    # The same with every group above the limit, and with small buffers.
    monkeypatch.setattr(suffixes, "GROUP_SEGMENTS", 1)
    assert found(docs_of(rows)) == expected


def test_odd_rows(docs_of):
    assert substrings.without_repeats(docs_of([])).collect() == []
    text = " ".join(f"w{i}" for i in range(60))
    got = substrings.without_repeats(docs_of([(1, text), (1, text), (None, text), (2, "x " + text + " y")])).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 60, 0), (1, 60, 0), (1, 60, 0), (2, 62, 60)]
