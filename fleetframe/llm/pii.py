"""Personal data: fixed patterns, and a linear-chain conditional random field (CRF) over word-shape features.

The CRF labels white-space tokens. Only tokens with a digit or an @ can be part of personal data here; all others are O by constraint, so a text
falls into short runs of possible tokens with O on both sides, and Viterbi over those runs is Viterbi over the whole text. Runs of equal
length are decoded together in numpy. Spans that the CRF adds never overlap those of the patterns, which always stay.

It is trained on a small labelled table (text, spans), by default `pii_examples`: forms that the patterns miss and numbers that are no personal data. Beside
it stand runs of the corpus, drawn by hash and labelled by the patterns (`silver_runs`), so that the numbers of this corpus are learnt as what they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .pii_examples import CUES, examples
from .scratch import ship, written
from .whole import rewrite_text

# Kinds in the order of the report, and the patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# End of fixed values.

STATES = ("O", "email", "ip", "card", "card+", "phone", "phone+")
_KIND_OF = {"email": "email", "ip": "ip", "card": "card", "card+": "card", "phone": "phone", "phone+": "phone"}
#: Labelled runs that the CRF is trained on, and tokens of a run that are used: the bounds of the fit.
TRAIN_RUNS, TRAIN_TOKENS = 4000, 32
#: Rows of the labelled table that are used.
TRAIN_EXAMPLES = 2400
FEATURES, ROUNDS, RIDGE = 4096, 120, 1e-3
_EDGE = " \t\r\n\x0b\x0c.,;:!?\"'()[]{}<>*#$%&|"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns by kind and start, leftmost and not overlapping per kind; matches that fail their check are dropped whole."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        # The part before an @ begins where its run of allowed characters does.
        start = at
        while start > done and text[start - 1] in EMAIL_HEAD:
            start -= 1
        m = EMAIL_TAIL.match(text, start) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def _shape(word: str) -> str:
    """Runs of digits as 9, of capitals as A, of other letters as a; other characters as they are, each once in a row."""
    out: list[str] = []
    for c in word[:200]:
        k = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:24])


def _features(words: list[str], before: str, after: str) -> list[list[int]]:
    """Feature numbers of the tokens of a run; before and after are the tokens around it."""
    shapes = [_shape(before.strip(_EDGE)), *(_shape(w.strip(_EDGE)) for w in words), _shape(after.strip(_EDGE))]
    rows = []
    whole = "".join(c for w in words for c in w if "0" <= c <= "9")
    sums = 16 <= len(whole) <= 19 and _luhn(whole)
    cue = before.strip(_EDGE).lower()
    cue = cue if cue in CUES else ""
    for i, word in enumerate(words):
        own = "".join(c for c in word if "0" <= c <= "9")
        digits = len(own)
        parts = re.findall("[0-9]+", word)
        checks = f"{16 <= digits <= 19 and _luhn(own)}{sums}{len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts)}"
        bare = shapes[i + 1]
        texts = (
            f"s{bare}", f"p{shapes[i]}|{bare[:1]}", f"n{shapes[i + 2]}|{bare[:1]}", f"d{min(digits, 20)}", f"l{min(len(word), 30) // 2}|{bare[:3]}",
            f"k{bare.count('.')}{'@' in word}{word[:1] == '+'}{'-' in word}", f"o{min(len(whole), 25)}|{checks}", f"v{checks}|{bare}", f"c{word[:1] if not word[:1].isalnum() else ''}|{bare}",
            f"w{cue}|{bare[:5]}", f"g{'-'.join(str(len(p)) for p in parts[:8])}|{bare[:12]}|{i}",
        )
        rows.append([zlib.crc32(t.encode()) % FEATURES for t in texts])
    return rows


PER_TOKEN = len(_features(["1"], "", "")[0])


class Run:
    """Tokens start[i]:end[i] (code points) of a text that can be personal data, side by side."""

    __slots__ = ("before", "after", "start", "end", "words")

    def __init__(self, words: list[str], start: list[int], end: list[int], before: str, after: str):
        self.words, self.start, self.end, self.before, self.after = words, start, end, before, after


def runs_of(found: tokens.Words, row: int, possible: np.ndarray, text: str) -> list[Run]:
    """The runs of document `row`; possible marks the tokens that may be personal data."""
    low, high = int(found.first[row]), int(found.first[row + 1])
    at = np.flatnonzero(possible[low:high])
    if not len(at):
        return []
    words = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(words, np.uint8)
    code = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    base = int(found.start[low]) - (len(words) - len(words.lstrip(b" \t\n\x0b\x0c\r")))
    start, end = found.start[low:high] - base, found.end[low:high] - base
    token = lambda i: text[code[start[i]] : code[end[i]]] if 0 <= i < high - low else ""
    runs = []
    for group in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
        own = group.tolist()
        runs.append(Run([token(i) for i in own], code[start[own]].tolist(), code[end[own]].tolist(), token(own[0] - 1), token(own[-1] + 1)))
    return runs


def _possible(found: tokens.Words) -> np.ndarray:
    telling = np.concatenate([[0], np.cumsum(((found.data >= 48) & (found.data <= 57)) | (found.data == 64))])
    return telling[found.end] > telling[found.start]


def _labels(run: Run, spans: list[tuple[str, int, int]]) -> list[int]:
    """The state of each token: the kind whose span covers most of it, continued where a span goes on."""
    states, last = [], None
    for s, e in zip(run.start, run.end, strict=True):
        best = max(((min(e, b) - max(s, a), kind, a) for kind, a, b in spans if a < e and b > s), default=None)
        if best is None:
            states.append(0)
            last = None
        else:
            name = best[1] + ("+" if (best[1], best[2]) == last and best[1] in ("card", "phone") else "")
            states.append(STATES.index(name))
            last = (best[1], best[2])
    return states


def _labelled(texts: pa.Array, spans_of) -> list[tuple[int, list[int], list[int]]]:
    """Draw, features and states of every run of the texts; spans_of gives the spans of a text by its place."""
    rows = []
    data, offsets = tokens.string_bytes(texts)
    for row, to in tokens.pieces(offsets):
        found = tokens.words(data, offsets[row : to + 1])
        possible = _possible(found)
        for d in range(to - row):
            if possible[found.first[d] : found.first[d + 1]].any():
                text = texts[row + d].as_py()
                spans = spans_of(row + d, text)
                for run in runs_of(found, d, possible, text):
                    n = TRAIN_TOKENS
                    feats = _features(run.words[:n], run.before, run.words[n] if len(run.words) > n else run.after)
                    rows.append((zlib.crc32(" ".join(run.words).encode("utf-8", "replace")), [f for r in feats for f in r], _labels(run, spans)[:n]))
    return rows


def _silver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _labelled(batch.column("text"), lambda _, text: base_spans(text))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["draw", "features", "states"])


def silver_runs(docs: DataFrame, runs: int = TRAIN_RUNS) -> DataFrame:
    """A small labelled table (features, states): half of it runs with personal data by the patterns, half without, drawn by a hash of their words."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    found = written(texts.mapInArrow(_silver, "draw long, features array<int>, states array<int>"), "silver")
    some = F.exists("states", lambda s: s > 0)
    part = lambda cond: found.filter(cond).dropDuplicates(["draw"]).orderBy("draw").limit(runs // 2).select("draw", "features", "states")
    return part(some).union(part(~some))


class Crf:
    """Weights of a linear-chain CRF; runs begin after O and end before O."""

    def __init__(self) -> None:
        k = len(STATES)
        self.emit, self.move = np.zeros((FEATURES, k)), np.zeros((k, k))
        self.move[~_allowed()] = -1e6

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(-2)

    def fit(self, rows: list[tuple[list[int], list[int]]]) -> Crf:
        """Maximum likelihood with a ridge by Adam; runs of equal length are handled together."""
        k, per = len(STATES), PER_TOKEN
        by: dict[int, list] = {}
        for features, states in rows:
            if states:
                by.setdefault(len(states), []).append((features, states))
        groups = [(np.array([f for f, _ in g], np.int64).reshape(len(g), n, per), np.array([s for _, s in g], np.int64)) for n, g in sorted(by.items())]
        total = sum(len(s) for _, s in groups)
        free = _allowed()
        moments = [np.zeros_like(w) for w in (self.emit, self.emit, self.move, self.move)]
        for step in range(1, ROUNDS + 1 if total else 1):
            g_emit, g_move = RIDGE * self.emit, np.where(free, RIDGE * self.move, 0.0)
            for features, states in groups:
                score = self.scores(features)
                n, length = states.shape
                forward, backward = np.zeros((length, n, k)), np.zeros((length, n, k))
                forward[0] = score[:, 0] + self.move[0]
                for t in range(1, length):
                    forward[t] = score[:, t] + _lse(forward[t - 1][:, :, None] + self.move, 1)
                backward[-1] = self.move[:, 0]
                for t in range(length - 2, -1, -1):
                    backward[t] = _lse(self.move + (score[:, t + 1] + backward[t + 1])[:, None, :], 2)
                whole = _lse(forward[-1] + backward[-1], 1)
                for t in range(length):
                    p = np.exp(forward[t] + backward[t] - whole[:, None])
                    p[np.arange(n), states[:, t]] -= 1
                    for j in range(per):
                        np.add.at(g_emit, features[:, t, j], p / total)
                    if t:
                        pair = forward[t - 1][:, :, None] + self.move + (score[:, t] + backward[t])[:, None, :] - whole[:, None, None]
                        g_move += np.exp(pair).sum(0) / total
                        np.add.at(g_move, (states[:, t - 1], states[:, t]), -1 / total)
                first = np.exp(forward[0] + backward[0] - whole[:, None]).sum(0)
                last = np.exp(forward[-1] + backward[-1] - whole[:, None]).sum(0)
                g_move[0] += (first - np.bincount(states[:, 0], minlength=k)) / total
                g_move[:, 0] += (last - np.bincount(states[:, -1], minlength=k)) / total
            for i, (w, g) in enumerate(((self.emit, g_emit), (self.move, np.where(free, g_move, 0.0)))):
                m, v = moments[2 * i], moments[2 * i + 1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def decode(self, features: list[list[list[int]]]) -> list[list[int]]:
        """The best states of each run, by Viterbi over all runs of one length at a time."""
        out: list[list[int]] = [[] for _ in features]
        by: dict[int, list[int]] = {}
        for i, rows in enumerate(features):
            by.setdefault(len(rows), []).append(i)
        for length, own in by.items():
            score = self.scores(np.array([features[i] for i in own], np.int64))
            best, back = score[:, 0] + self.move[0], []
            for t in range(1, length):
                reach = best[:, :, None] + self.move
                back.append(reach.argmax(1))
                best = reach.max(1) + score[:, t]
            state = (best + self.move[:, 0]).argmax(1)
            path = [state]
            for step in reversed(back):
                state = step[np.arange(len(own)), state]
                path.append(state)
            for i, states in zip(own, np.stack(path[::-1], 1).tolist(), strict=True):
                out[i] = states
        return out


def _allowed() -> np.ndarray:
    """A continued kind follows its own kind only."""
    ok = np.ones((len(STATES), len(STATES)), bool)
    for j, name in enumerate(STATES):
        if name.endswith("+"):
            ok[:, j] = [s in (name, name[:-1]) for s in STATES]
    return ok


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def added_spans(run: Run, states: list[int], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the decoded states, without punctuation at their edges, that overlap no span of the patterns."""
    spans, open_kind, brackets = [], None, {}
    for state, word, start, end in zip(states, run.words, run.start, run.end, strict=True):
        name = STATES[state]
        if name == "O":
            open_kind = None
            continue
        left = start + len(word) - len(word.lstrip(_EDGE))
        right = end - (len(word) - len(word.rstrip(_EDGE)))
        if right <= left:
            open_kind = None
            continue
        if name.endswith("+") and open_kind == name[:-1] and spans:
            spans[-1] = (spans[-1][0], spans[-1][1], right)
        else:
            spans.append((_KIND_OF[name], left, right))
            if name == "phone" and word[: left - start].endswith("(") and ")" in word:
                brackets[left] = start + word.index(")")
        open_kind = _KIND_OF[name]
    # A bracket before a number that goes on behind the closing one belongs to it: "(555) 010-1234".
    spans = [(k, a - (k == "phone" and brackets.get(a, b) < b), b) for k, a, b in spans]
    return [s for s in spans if not any(a < s[2] and b > s[1] for _, a, b in base)]


def _batch_spans(model: Crf, texts: pa.Array) -> tuple[list[list], list[list]]:
    """Spans of the patterns and added spans of each text."""
    data, offsets = tokens.string_bytes(texts)
    all_base: list[list] = []
    all_added: list[list] = []
    for row, to in tokens.pieces(offsets):
        found = tokens.words(data, offsets[row : to + 1])
        possible = _possible(found)
        runs: list[Run] = []
        owner: list[int] = []
        base: list[list] = [[] for _ in range(to - row)]
        for d in range(to - row):
            if possible[found.first[d] : found.first[d + 1]].any():
                text = texts[row + d].as_py()
                base[d] = base_spans(text)
                own = runs_of(found, d, possible, text)
                runs += own
                owner += [d] * len(own)
        added: list[list] = [[] for _ in range(to - row)]
        states = model.decode([_features(r.words, r.before, r.after) for r in runs])
        for d, run, path in zip(owner, runs, states, strict=True):
            if any(path):
                added[d] += added_spans(run, path, base[d])
        all_base += base
        all_added += added
    return all_base, all_added


def _found(model: Crf):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def column(lists: list[list]) -> pa.Array:
        order = lambda s: (KINDS.index(s[0]), s[1], s[2])
        return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in sorted(x, key=order)] for x in lists], kind)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = _batch_spans(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column(base), column(added)], names=["doc_id", "base", "added"])

    return of_batches


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def labelled_runs(table: list[tuple[str, list[tuple[str, int, int]]]]) -> list[tuple[list[int], list[int]]]:
    """Features and states of the runs of a small labelled table; spans of the patterns count as labelled too, where no given span is."""
    given = [spans for _, spans in table]

    def spans_of(i: int, text: str) -> list[tuple[str, int, int]]:
        return [*given[i], *(s for s in base_spans(text) if not any(a < s[2] and b > s[1] for _, a, b in given[i]))]

    return [(f, s) for _, f, s in _labelled(pa.array([text for text, _ in table], pa.string()), spans_of)]


def train(docs: DataFrame, labelled: DataFrame | None = None) -> Crf:
    """The random field, fitted on a labelled table (text, spans as array of kind, start, end) and on runs of docs.

    Without a table `pii_examples` is used; of a table the TRAIN_EXAMPLES rows first by text. Rows with a null text are passed over, null spans are none."""
    table = examples(TRAIN_EXAMPLES)
    if labelled is not None:
        own = labelled.filter("text is not null").select("text", "spans").orderBy("text").limit(TRAIN_EXAMPLES).collect()
        table = [(r["text"], [tuple(s) for s in r["spans"] or []]) for r in own]
    rows = silver_runs(docs).orderBy("draw").collect()
    return Crf().fit([(list(r["features"]), list(r["states"])) for r in rows] + labelled_runs(table))


def spans(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, base, added of every row of docs: spans (kind, start, end) in code points, end exclusive, by kind and start.

    docs needs doc_id and text; other columns are ignored. Null and empty texts have none. Repeated rows and null ids are handled row by row.
    An empty table gives an empty result; a corpus without any pattern trains a CRF that adds nothing.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_found(model), f"doc_id long, base {_SPANS}, added {_SPANS}")


def joined(column: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def _by_start(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row of docs (doc_id, text); the CRF is trained on docs too.

    Null and empty texts have no spans. Repeated rows, and rows without doc_id, each come back. Other columns are ignored; an empty table gives an empty
    result."""
    found = spans(docs, train(docs))
    counts, every = [], []
    for k in KINDS:
        of_kind = _is_kind(k)
        counts.append(F.size(F.filter("base", of_kind)).cast("long").alias(f"n_{k}"))
        every.append(F.array_sort(F.transform(F.filter(F.concat("base", "added"), of_kind), _by_start)))
    every = F.concat(*every)
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))


def _masked(model: Crf, texts: pa.Array) -> pa.Array:
    out = []
    for i, (base, added) in enumerate(zip(*_batch_spans(model, texts), strict=True)):
        if not base and not added:
            continue
        text, parts, done = texts[i].as_py(), [], 0
        for kind, start, end in sorted([*base, *added], key=lambda s: (s[1], -s[2])):
            if start >= done:
                parts += [text[done:start], f"[{kind.upper()}]"]
            done = max(done, end)
        out.append((i, "".join([*parts, text[done:]])))
    if not out:
        return texts
    changed = np.zeros(len(texts), bool)
    changed[[i for i, _ in out]] = True
    return pc.replace_with_mask(texts, pa.array(changed), pa.array([t for _, t in out], texts.type))


def masked(docs: DataFrame, model: Crf) -> DataFrame:
    """The columns of docs with every span of text replaced by its kind in brackets; overlapping spans are replaced as one.

    Null texts stay null and empty ones empty; repeated rows are masked alike; other columns stay as they are; an empty table stays empty."""
    return rewrite_text(docs, partial(_masked, model))
