import math
import random

import numpy as np
from fleetframe.llm import langid, tokens

import pyarrow as pa


def corpus(seed, n=300):
    rng = random.Random(seed)
    parts = {"aa": ["the", "tion", "er", "and", "ing"], "bb": ["schö", "keit", "ung", "ein", "ver"], "cc": ["ción", "que", "mente", "ñas", "el"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40)))
        rows.append((i, text.capitalize(), lang, "s"))
    return rows


def test_held_out_accuracy(docs_of):
    rows = corpus(1)
    odd = [(1000, None, "aa", "s"), (1001, "12 ,.!", "bb", "s"), (1002, "", None, None), (None, "the tion and", "zz", "s"), (1003, "the", None, "s")]
    got = langid.identify(docs_of(rows + odd)).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
    of = {r.doc_id: r for r in got}
    held = [(of[i], lang) for i, _, lang, _ in rows if of[i].held_out]
    assert len(held) > 60 and sum(r.lang_pred == lang for r, lang in held) / len(held) > 0.98
    assert {of[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and of[None].lang_pred == "aa"


def slow_length(trees_of, text, fold, symbols=langid.SYMBOLS, order=langid.ORDER):
    """Bits of a text under nested counts, byte by byte; trees_of: context length -> {context: {symbol: count}}."""
    s = [langid.SPACE] * order + [int(fold[b]) for b in text]
    bits = 0.0
    for i in range(order, len(s)):
        chance = 1 / symbols
        for k in range(order + 1):
            seen = trees_of[k].get(tuple(s[i - k : i]), {})
            n, kinds = sum(seen.values()), len(seen)
            if n:
                chance = (seen.get(s[i], 0) + kinds * chance) / (n + kinds)
        bits -= math.log2(chance)
    return bits


def test_code_lengths_match_a_plain_tree(docs_of):
    rows = corpus(2, 60)
    trees = langid.train(docs_of(rows))
    for lang_at, lang in enumerate(trees.langs):
        plain = [{} for _ in range(langid.ORDER + 1)]
        for _, text, own, _ in rows:
            if own == lang:
                s = [langid.SPACE] * langid.ORDER + [int(trees.fold[b]) for b in text.encode()]
                for i in range(langid.ORDER, len(s)):
                    for k in range(langid.ORDER + 1):
                        at = plain[k].setdefault(tuple(s[i - k : i]), {})
                        at[s[i]] = at.get(s[i], 0) + 1
        texts = [r[1] for r in rows[:20]] + ["zq!", ""]
        data, offsets = tokens.string_bytes(pa.array(texts))
        got = trees.lengths(data, offsets)[:, lang_at]
        want = [slow_length(plain, t.encode(), trees.fold) for t in texts]
        assert np.allclose(got, want, rtol=1e-5)


def test_few_nodes_fall_back_to_shorter_contexts(docs_of):
    rows = corpus(3)
    trees = langid.train(docs_of(rows), nodes=10)
    assert len(trees.bits) == (64 * 64 + 10) * 64
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs_of(rows), trees).collect()}
    assert sum(got[i] == lang for i, _, lang, _ in rows) / len(rows) > 0.98


def test_nothing_to_learn(docs_of):
    assert langid.identify(docs_of([])).collect() == []
    assert {(r.lang_pred, r.score) for r in langid.identify(docs_of([(i, "abc", None, "s") for i in range(9)])).collect()} == {("und", 0.0)}


def test_rare_languages_keep_their_bytes_and_contexts(docs_of):
    rng = random.Random(7)
    latin = [chr(b) for b in range(33, 127) if not 65 <= b <= 90]
    scripts = {"he": [chr(c) for c in range(0x5D0, 0x5EA)], "hy": [chr(c) for c in range(0x561, 0x57B)]}
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(20))
    rows = [(i, text(latin), "en", "s") for i in range(900)]
    rows += [(1000 + i, text(scripts[lang]), lang, "s") for i in range(60) for lang in ["he" if i % 2 else "hy"]]
    got = {r.doc_id: r for r in langid.identify(docs_of(rows)).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in rows if lang != "en" and got[i].held_out]
    assert len(held) > 10 and all(a == b for a, b in held)
    trees = langid.train(docs_of(rows), nodes=30)
    assert trees.base > langid.SYMBOLS and len(set(trees.fold[list(rows[-1][1].replace(" ", "").encode())])) > 20
    assert (trees.node >= trees.base ** (langid.ORDER - 1)).sum(1).tolist() == [30] * 3
