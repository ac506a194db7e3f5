import random

from fleetframe.llm import minhash


def shingles(text):
    words = (text or "").lower().split() if text and text.isascii() else (text or "").split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([("short", *words)])


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed):
    """Copies, chains of small edits, a large group of near copies, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(6):
        text = [word() for _ in range(rng.randint(8, 120))]
        for _ in range(8):
            texts.append(" ".join(text))
            text = list(text)
            text[rng.randrange(len(text))] = word()
    base = [word() for _ in range(100)]
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(100)] = word()
        texts.append(" ".join(copy))
    texts += ["a b c", "A  b\tC", "a b", "", "   \n", None, "one two three four five", texts[3].upper()]
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


def test_components_match_brute_force(docs_of):
    for percent, seed in ((85, 1), (80, 2)):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(rows), percent).collect()}
        assert got == brute(rows, percent)


def test_odd_rows(docs_of):
    assert minhash.near_duplicates(docs_of([]), 85).collect() == []
    text = "one two three four five six seven"
    found = minhash.near_duplicates(docs_of([(3, text), (1, text), (1, text), (None, text), (None, None)]), 85).collect()
    assert sorted(((r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in found) == [
        (0, 0, None, True), (0, 3, None, True), (1, 3, 1, True), (1, 3, 1, True), (3, 3, 1, False)]
    kept = minhash.one_of_each(docs_of([(3, text), (1, text), (1, text), (2, None), (2, "")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and "n_chars" in kept.columns


def test_very_long_words_and_texts(docs_of):
    long = "w" * 3_000_000 + " " + " ".join(f"x{i}" for i in range(200_000))
    found = minhash.near_duplicates(docs_of([(1, long), (2, long + " end"), (3, "q " * 100_000)]), 85).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3}
