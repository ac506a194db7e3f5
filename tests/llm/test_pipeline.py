import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline

from .test_decontam import brute as item_windows, likeness
from .test_lm import FOLD
from .test_mixing import fill
from .test_pii import brute as patterns
from .test_toxicity import Plain, bag, corpus, labelled, tunes_of

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF_DIR)
        if i < 4:
            assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        docs = spark.createDataFrame(after.collect(), after.schema)
        counts.append(docs.count())
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] <= counts[2] and counts[4] == counts[3]
    assert {"epoch", "n_words"} < set(docs.columns) and counts[5] > 0
    assert corpus_pipeline.run(spark, SF_DIR).count() == counts[5]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def first_of_each(rows):
    """All pairs compared; of each component the row with the smallest doc_id."""
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [r for r in rows if r[0] is None or find(r[0]) == r[0]]


def holds_item(text, items):
    words = (text or "").translate(FOLD).split()
    short = any(0 < len(words) < len(t.split()) and likeness(words, t.split()) >= 0.8 for _, t in items)
    return short or bool(item_windows([(0, text)], items))


def masked(text):
    parts, done = [], 0
    for kind, start, end in sorted(patterns(text or ""), key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return text and "".join([*parts, text[done:]])


def mix(rows):
    """(row, epoch, words) of the mix: whole epochs, then documents by md5 up to the budget."""
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    out = []
    for source, target in fill(sizes).items():
        budget = math.floor(target + 0.5)
        epochs, rest = divmod(budget, sizes[source]) if sizes[source] else (0, 0)
        own = [r for r in rows if r[3] == source]
        for r in sorted(own, key=lambda r: hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest()):
            words = (r[1] or "").split()
            cut = min(rest, len(words))
            rest -= cut
            for epoch in range(1, epochs + 1 + (cut > 0)):
                n = len(words) if epoch <= epochs else cut
                if n:
                    out.append((r[0], r[1] if n == len(words) else " ".join(words[:n]), r[2], r[3], epoch, n))
    return out


def planted():
    """Documents with toxic words, exact and near copies in chains, benchmark passages, personal data, and clean ones; labels; items."""
    rng = random.Random(11)
    texts, labels = corpus(7, 240)
    texts = [t for _, t in texts]
    items = [(i, " ".join(f"item{rng.randrange(400)}" for _ in range(n))) for i, n in enumerate([4, 18, 30, 45])]
    clean = [i for i, _, toxic in labels if not toxic]
    for i in clean[:12]:
        words = texts[i].split() + rng.choices(texts[clean[20]].split(), k=60)
        texts[i] = " ".join(words)
        for _ in range(3):  # each differs in one more word from the one before
            words[rng.randrange(len(words))] = rng.choice(["river", "stone", "cloud"])
            texts.append(" ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
        texts.append(texts[i])
    for n, i in enumerate(clean[30:50]):
        words, part = texts[i].split(), items[n % 4][1].split()
        if n % 3 == 1 and len(part) > 10:
            part[rng.randrange(len(part))] = "other"
        if n % 3 == 2:
            part = part[: len(part) // 2]
        at = rng.randrange(len(words))
        texts[i] = " ".join(words[:at] + part + words[at:])
    texts += [items[3][1].rsplit(" ", 1)[0], items[2][1].title(), items[1][1].rsplit(" ", 9)[0]]
    for n, i in enumerate(clean[60:90]):
        texts[i] += " " + ["mail ann.lee@mail.example.org now", "from 10.20.30.40 there", "card 4111 1111 1111 1111 ok", "call +49 30 1234567 soon"][n % 4]
    texts += [None, "", " \n\t", "a b c", texts[clean[95]]]
    rows = [(i, t, "en", ["a", "B", None, "é", "a", "a"][i % 6]) for i, t in enumerate(texts)]
    return [*rows, (None, texts[clean[99]], None, "B")], labels, items


def test_rows_equal_a_plain_pipeline(spark, docs_of, tmp_path):
    rows, labels, items = planted()
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, labels).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = Plain([(i, t) for i, t, *_ in rows], labels, tunes_of(spark, labels))
    known = lambda t: any(w in plain.weight for w in bag(t))
    scores = [plain.score(bag(r[1])) if known(r[1]) else 0.0 for r in rows]
    assert not any(0.45 < s < 0.55 for s in scores)
    kept = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]
    one = first_of_each(kept)
    free = [r for r in one if not holds_item(r[1], items)]
    hidden = [(i, masked(t), *rest) for i, t, *rest in free]
    assert 30 < len(rows) - len(kept) < 80 and len(kept) - len(one) > 40 and 10 < len(one) - len(free) < 25
    assert sum(a != b for a, b in zip(free, hidden, strict=True)) >= 0.8 * 30
    got = Counter((r.doc_id, r.text, r.lang, r.source, r.epoch, r.n_words) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter(mix(hidden))
