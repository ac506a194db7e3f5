import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fleetframe.llm import lm

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sequence(text):
    return ["<", *(text or "").translate(FOLD).split(" "), ">"] if (text or "").strip(" ") else ["<", ">"]


def brute(rows, depth=3, least=16, cutoff=4.0):
    """The tree by its definition, as nested contexts, and each token scored in its longest state."""
    learn = [sequence(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for s in learn for w in s[1:])
    n, kinds = sum(count.values()), len(count)
    base = lambda w: (count[w] + 0.5) / (n + 0.5 * (kinds + 1))
    states = {}

    def chance(context, w):
        while context and context not in states:
            context = context[1:]
        if not context:
            return base(w)
        seen, total, share = states[context]
        return max(seen[w] - 1, 0) / total + share * chance(context[1:], w)

    for length in range(1, depth + 1):
        nexts = defaultdict(Counter)
        for s in learn:
            for i in range(len(s) - length):
                nexts[tuple(s[i : i + length])][s[i + length]] += 1
        grown = {}
        for context, seen in nexts.items():
            total = sum(seen.values())
            if total >= least:
                share = 1 - sum(c - 1 for c in seen.values()) / total
                gain = 0.0
                for w, c in seen.items():
                    old = chance(context[1:], w)
                    gain += c * math.log((max(c - 1, 0) / total + share * old) / old) if c >= 2 else c * math.log(share)
                if gain >= cutoff and any(c >= 2 for c in seen.values()):
                    grown[context] = (seen, total, share)
        states.update(grown)
    out = []
    for i, t in rows:
        s = sequence(t)
        logs = [math.log10(chance(tuple(s[max(0, k - depth) : k]), s[k])) for k in range(1, len(s))]
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(s) - 1, sum(count[w] > 0 for w in s[1:]), n, sum(math.log10(base(w)) for w in s[1:]), sum(logs)))
    return out, states, chance, count


def corpus(seed=4, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    phrases = [" ".join(rng.choices(words, k=6)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=5)) for _ in range(rng.choice([0, 1, 4, 9]))]
        rows.append((i, " ".join(parts) + (f" Rare{i} É" if i % 7 == 0 and parts else "")))
    return rows + [(None, rows[3][1]), (3, rows[3][1]), (5, None), (n, "Öl " * 3000 + "x")]


def key(r):
    return (r[0] is None, r[0], r[2], r[6])


@pytest.mark.parametrize(("hot", "bits", "chunk"), [(lm.HOT, 28, 1 << 22), (10, 15, 500), (0, 15, 50)])
def test_equals_brute_force(spark, docs_of, monkeypatch, hot, bits, chunk):
    monkeypatch.setattr(lm, "MAP_BITS", bits)
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "HOT_JOIN", max(min(hot, 1 << 16), 3))
    monkeypatch.setattr(lm.score, "__defaults__", (hot,))
    monkeypatch.setattr(lm, "BUCKET_TOKENS", max(hot, 700))
    monkeypatch.setattr(lm, "BUCKET_ROWS", max(min(hot, 1 << 20), 30))
    rows = corpus()
    want, states, _, _ = brute(rows)
    assert {len(s) for s in states} == {1, 2, 3}
    got = [tuple(r) for r in lm.modelled(docs_of(rows)).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], rtol=1e-10)


def test_chances_sum_to_one_and_beat_the_base():
    rows = corpus(8)
    out, states, chance, count = brute(rows)
    for context in [(), *list(states)[:20]]:
        assert abs(sum(chance(context, w) for w in [*count, "never seen"]) - 1) < 1e-9
    held = [r for r in out if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_odd_tables(docs_of):
    assert lm.modelled(docs_of([])).collect() == []
    only_held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = lm.modelled(docs_of([(i, "a b") for i in only_held])).collect()
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(True, 3, 0, 0, 0.0, 0.0)}
    got = lm.modelled(docs_of([(0, None), (2, ""), (None, " \t")])).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(1, 1, 2)}


def test_marks_have_no_false_no(spark):
    keys = np.random.default_rng(0).integers(0, 1 << 64, 5000, dtype=np.uint64)
    found = lm.marks(spark.createDataFrame([(int(k),) for k in keys[:1000].view(np.int64)], "key long"))[keys]
    assert set(range(1000)) <= set(found.tolist()) and len(found) < 1200


def test_packed_keys_come_back():
    common = np.random.default_rng(1).permutation(lm.tokens.seeds(70000, 3))
    rare = lm.tokens.seeds(50, 4)
    names = lm._Names(common)
    for keys in (common[:0], rare, common[::-1], np.concatenate([common[::7], rare, common[:5]])):
        packed = names.packed(keys, names.numbers(keys))
        assert (lm._keys(common, packed, len(keys)) == keys).all()
        assert (lm._keys(common[:0], lm._Names(common[:0]).packed(keys, np.zeros(len(keys), np.uint32)), len(keys)) == keys).all()
    assert len(names.packed(common, names.numbers(common))) < 3 * len(common)


def test_places_are_those_of_a_search():
    rng = np.random.default_rng(2)
    for low, high, n in ((0, 1 << 64, 3000), (5, 9, 4), (1 << 63, (1 << 63) + 40000, 9000), (7, 8, 1), (0, 1, 0)):
        own = np.unique(rng.integers(low, high, n, dtype=np.uint64))
        keys = np.concatenate([own, rng.integers(0, 1 << 64, 500, dtype=np.uint64), np.array([0, low, (1 << 64) - 1], np.uint64)])
        at, place = lm._Places(own).find(keys)
        assert sorted(at.tolist()) == np.flatnonzero(np.isin(keys, own)).tolist() and (own[place] == keys[at]).all()


@pytest.mark.parametrize("most", [0, 40])
def test_few_runs_have_numbers(docs_of, monkeypatch, most):
    monkeypatch.setattr(lm, "COMMON", most)
    monkeypatch.setattr(lm, "PASSES", 4)
    rows = corpus(5, 150)
    want = brute(rows)[0]
    got = [tuple(r) for r in lm.modelled(docs_of(rows)).collect()]
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], rtol=1e-10)


def test_shuffles_are_deleted_as_jobs_end(spark, docs_of):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(" ")))
    docs = docs_of(corpus(6, 100))
    old = shuffled()
    lm.modelled(docs)
    for _ in range(50):
        if len(shuffled() - old) <= lm.DEPTH:
            break
        time.sleep(0.2)
    assert len(shuffled() - old) <= lm.DEPTH  # those of toArrow() stay until their frames go
    assert spark.conf.get(name, None) == before


def test_runs_of_two_travel_as_numbers_and_texts_are_named_once(docs_of):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(400))) for i in range(200)]
    docs = docs_of(rows).coalesce(1).selectExpr("doc_id", "xxhash64(text) digest", "text")
    tokens = [lm.tokens.words(*lm.tokens.string_bytes(lm.pa.array([t]))).hash for _, t in rows]
    common = np.unique(np.concatenate(tokens))
    pairs = np.concatenate([lm.longer(t) for t in tokens])
    marked = lm.Marks(15, [(0, b"\xff" * 4096)])
    none = lm._Frequent(lm.pa.table({"key": [0], "known": [0], "base": [0.0], "value": [0.0]}).slice(0, 0).cast(lm.pa.schema([("key", "int64"), ("known", "int64"), ("base", "float64"), ("value", "float64")])))
    sent = docs.mapInArrow(lm._sent(range(2, 3), 0, 1, -1.0, none, marked, common, 3), lm._SENT).collect()
    assert sum(len(r.ids) for r in sent if r.ids is not None) == len(rows) and len(sent) > len({r.piece for r in sent})
    runs = [r for r in sent if r.keys is not None]
    keys = np.concatenate([lm._pair_keys(common, r.keys, sum(np.frombuffer(lm._unpacked(r.counts, 4 * r.n)[0], np.int32))) for r in runs])
    assert len(keys) == len(pairs) + 2 * len(rows) and set(pairs.tolist()) <= set(keys.tolist())
    assert sum(len(r.keys) + len(r.counts) for r in runs) < 6 * len(keys)


def test_a_trained_tree_holds_no_chances(spark, docs_of):
    tree = lm.train(docs_of(corpus(9, 200)))
    tables = [spark.read.parquet(f) for rows in tree.runs for f in rows.inputFiles()]
    assert len(tree.runs) == 6 and tables
    assert not any({"chance", "ends"} & set(t.columns) for t in tables)


def test_order_and_ranks(spark):
    rng = np.random.default_rng(3)
    for keys in (rng.integers(0, 1 << 64, 5000, dtype=np.uint64), rng.integers(0, 40, 3000, dtype=np.uint64), np.zeros(0, np.uint64), np.array([7], np.uint64)):
        assert (keys[lm._order(keys)] == np.sort(keys)).all()
        assert sorted(lm._order(keys, exact=False).tolist()) == list(range(len(keys)))
    ns = [5, 9, 9, 1, 2, 2, 2, 30]
    ranks = lm._Ranks(spark.createDataFrame([(n,) for n in ns], "n long"))
    for most in range(10):
        least = ranks.least(most)
        fit = [n for n in ns if n >= least]
        assert len(fit) <= most and ranks.below(least) == len(ns) - len(fit)
        assert most >= len(ns) or len([n for n in ns if n >= least - 1]) > most
    assert lm._Ranks(spark.createDataFrame([], "n long")).least(3) == 0
