import random

from fleetframe.llm import quality


def corpus(seed, n=500):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        source = f"s{i % 12}"
        good = rng.random() < (0.95 if i % 12 < 9 else 0.3)
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:10] * 4)
        rows.append((i, text, rng.choice(["en", "de"]), source))
        labels.append((i, int(good), 0))
    return rows, labels


def test_scores(spark, docs_of):
    rows, labels = corpus(1)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.scored(docs_of([*rows, (900, None, None, None), (901, "", "en", "s1"), (None, "abc def", "en", "new")]), table).collect()
    assert len(got) == len(rows) + 3 and all(0 <= x <= 1 for r in got for x in (r.score, r.classifier, r.path_posterior))
    known = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) / len(held) > 0.97
    # A site's evidence: posteriors of good sites stand above those of bad ones, a site of one document at the prior.
    by = {}
    for r in got:
        if r.doc_id is not None and r.doc_id < 500:
            by.setdefault(r.doc_id % 12 >= 9, []).append(r.host_posterior)
    assert min(by[False]) > max(by[True])
    lone = next(r for r in got if r.doc_id is None)
    mean = sum(q for _, q, _ in labels) / len(labels)
    assert abs(lone.host_posterior - mean) < 0.05


def test_posteriors_by_hand(spark, docs_of):
    # With labels for all rows the values are the labels, and sums can be checked.
    rows = [(i, "same words here", "en", "a" if i < 6 else "b") for i in range(12)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0 or i < 6), 0) for i in range(12)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs_of(rows), labels).collect()
    assert len({round(r.classifier, 9) for r in got}) == 1
    assert {r.host_posterior >= r.classifier for r in got if r.doc_id < 6} == {True}


def test_without_labels_and_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in quality.scored(docs_of(["a", None]), none).collect()} == {0.5}
    assert quality.scored(docs_of([]), none).collect() == []
