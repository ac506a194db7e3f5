import hashlib
import random
import re

import pyarrow as pa
import pytest

from fleetframe.llm import pii
from fleetframe.llm.pii_examples import examples

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = sum(n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for i, n in enumerate(int(d) for d in reversed(digits)))
    return total % 10 == 0


def brute(text):
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return spans


def random_texts(seed, n):
    rng = random.Random(seed)
    bits = ["a.b@c.de", "@", "x@y", "é@b.c", "ü", "+49 (30) 123-4567", "+", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "0007.1.2.3", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "٣", "\x1f", "\n", "\t", " ", " ", " ", ".", "-", "12", "999999999999999999999999", "(", ")", "word", "%$", "a@b.c.", "+1.", "..", " "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_base_spans_match_the_patterns():
    for text in random_texts(1, 4000):
        assert pii.base_spans(text) == brute(text), repr(text)


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "@" * 300_000, "a@" * 150_000):
        assert isinstance(pii.base_spans(text), list)


def test_report(docs_of):
    texts = [*random_texts(2, 300), None, "", *(f"mail user{i}@host.example.org or call +1 (555) 010-{i:04d} now" for i in range(40))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x a@b.cd"), (7, texts[7])]
    got = pii.report(docs_of(rows)).collect()
    assert len(got) == len(rows)
    of = dict(rows)
    for r in got:
        spans = brute(of[r.doc_id] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == s[0] for s in spans) for k in pii.KINDS)
        every = r.spans.split(",") if r.spans else []
        assert set(text.split(",") if text else []) <= set(every)
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in every)]
        assert order == sorted(order)
    assert pii.report(docs_of([])).collect() == []


def test_crf_learns_and_decodes_exactly():
    rng = random.Random(3)
    words = lambda: rng.choice(["call", "12", "v1.2", "a1b2", "x@y.zz", "10.0.0.1", "+49", "301234567"])
    rows = []
    for _ in range(300):
        run = [words() for _ in range(rng.randint(1, 4))]
        states = ["email" if "@" in w else "ip" if w.startswith("10.") else "phone" if w == "+49" else "O" for w in run]
        for i in range(1, len(run)):
            if states[i - 1] == "phone" and run[i] == "301234567":
                states[i] = "phone+"
        rows.append(([f for r in pii._features(run, "a", "b") for f in r], [pii.STATES.index(s) for s in states]))
    model = pii.Crf().fit(rows)
    right = total = 0
    per = len(pii._features(["1"], "", "")[0])
    for features, states in rows:
        n = len(states)
        split = [features[i * per : (i + 1) * per] for i in range(n)]
        path = model.decode([split])[0]
        right, total = right + sum(a == b for a, b in zip(path, states)), total + n
        if n <= 3:  # Viterbi against all paths
            score = model.scores(__import__("numpy").array(split))
            paths = __import__("itertools").product(range(len(pii.STATES)), repeat=n)
            value = lambda p: sum(score[i][s] for i, s in enumerate(p)) + sum(model.move[a, b] for a, b in zip((0, *p), (*p, 0)))
            assert value(path) >= max(map(value, paths)) - 1e-9
    assert right / total > 0.98


def test_masking_keeps_columns(docs_of):
    docs = docs_of([(1, "é mail a.b@c.de, ip 1.2.3.4!"), (2, None), (3, "clean text"), (None, "card 4111 1111 1111 1111")])
    got = {r.doc_id: r for r in pii.masked(docs, pii.train(docs)).collect()}
    assert pii.masked(docs, pii.train(docs)).columns == docs.columns
    assert got[1].text == "é mail [EMAIL], ip [IP]!" and got[2].text is None and got[3].text == "clean text"
    assert got[None].text == "card [CARD]" and got[1].n == 7


@pytest.fixture(scope="module")
def model(docs_of):
    return pii.train(docs_of([(i, t) for i, t in enumerate(random_texts(5, 100))]))


def test_field_adds_forms_that_the_patterns_miss(model):
    table = examples(1200, seed=99)
    assert not {t for t, _ in table} <= {t for t, _ in examples(pii.TRAIN_EXAMPLES)}
    base, added = pii._batch_spans(model, pa.array([t for t, _ in table]))
    for kind in pii.KINDS:
        want = {(i, s) for i, (_, spans) in enumerate(table) for s in spans if s[0] == kind}
        by_field = {(i, s) for i, spans in enumerate(added) for s in spans if s[0] == kind}
        by_pattern = {(i, s) for i, spans in enumerate(base) for s in spans if s[0] == kind}
        assert len(want) > 40 and len(by_pattern & want) < len(want) / 4
        assert len(by_field & want) >= 0.95 * len(by_field) and len((by_field | by_pattern) & want) >= 0.95 * len(want), kind


@pytest.mark.parametrize(("text", "want"), [
    ("please call (555) 010-1234 now", "phone:12:26"),
    ("tel: 030/123456.", "phone:5:15"),
    ("visa 4111.1111.1111.1111, thanks", "card:5:24"),
    ("write to anna@b\u00fccher.de today", "email:9:23"),
    ("host 2001:db8::1a2b up", "ip:5:19"),
    ("on 2024-05-06 at 12:30 we sold 1234 items for $12.50", ""),
    ("isbn 978-3-16-148410-0 and 4111.1111.1111.1112", ""),
])
def test_added_spans_are_reported(model, docs_of, text, want):
    row = pii.spans(docs_of([(1, text)]), model).select(pii.joined(pii.F.col("base")), pii.joined(pii.F.col("added"))).first()
    assert tuple(row) == ("", want)


def test_own_table(spark, docs_of):
    rows = [(f"badge {i}x{i} open", [("ip", 6, 6 + len(f"{i}x{i}"))]) for i in range(10, 90)] + [(f"badge {i} open", None) for i in range(90)] + [(None, None)]
    own = spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:int,end:int>>")
    model = pii.train(docs_of([(1, "clean")]), own)
    got = pii.spans(docs_of([(1, "badge 12x34 open"), (2, "badge 17 open"), (3, None), (4, "")]), model).collect()
    assert {r.doc_id: [tuple(s) for s in r.added] for r in got} == {1: [("ip", 6, 11)], 2: [], 3: [], 4: []}
    assert pii.spans(docs_of([(1, "call 12")]), pii.train(docs_of([]), own.limit(0))).first().added == []


def test_examples_are_the_same_every_time():
    assert examples(200) == examples(200) and all(t[a:b].strip() == t[a:b] != "" for t, spans in examples(500) for _, a, b in spans)
