from fractions import Fraction

import numpy as np
import pytest

from fleetframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, `a.b` string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], schema)


def brute(rows, components=8):
    """Everything from the definitions, covariances as fractions."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in rows]
    n, dim = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(dim)]
    centred = [[r[d] - Fraction(s[d], n) for d in range(dim)] for r in x]
    cov = np.array([[float(sum(r[a] * r[b] for r in centred) / n) for b in range(dim)] for a in range(dim)])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    white = np.array([[float(c) for c in r] for r in centred]) @ (basis / np.sqrt(np.maximum(values, 1e-300)))
    deviation = [sum((n * r[d] - s[d]) ** 2 for d in range(dim)) for r in x]
    return rows, n, cov, values, white[:, :components], deviation


def test_equals_definitions(spark):
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(12, 12)) * np.geomspace(1, 0.05, 12)[:, None]
    rows = [(i, [float(c) for c in (rng.normal(size=12) @ mixing + 0.3).astype(np.float32)]) for i in range(70)]
    rows += [(7, rows[7][1]), (None, rows[8][1])]
    odd = [(200, None), (201, [float("nan")] + [0.0] * 11), (202, [float("inf")] + [0.0] * 11), (203, [None] + [0.5] * 11)]
    kept, n, cov, values, white, deviation = brute(rows + odd)
    model = whitening.fit(table(spark, rows + odd))
    assert model.n == n == 72 and np.allclose(model.covariance, cov, rtol=1e-14)
    got = whitening.whiten(table(spark, rows + odd)).collect()
    assert len(got) == 72 * 8 and {r.vec_id for r in got} == {i for i, _ in kept}
    by_id = {i: k for k, (i, _) in enumerate(kept)}
    signs = {}
    for r in got:
        k = by_id[r.vec_id]
        assert r.n == n and r.deviation == deviation[k]
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-12 and r.identity_error < 1e-9
        want = white[k, r.component - 1]
        assert abs(abs(r.whitened) - abs(want)) < 1e-8
        if abs(want) > 1e-6:
            signs.setdefault(r.component, set()).add(r.whitened * want > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=4) * [1e6, 1e11, 3, 1e3]]) for i in range(40)]
    model = whitening.fit(table(spark, rows))
    assert np.allclose(model.covariance, brute(rows)[2], rtol=1e-15)
    got = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, rows)).collect()}
    assert got == {i: (d if d < 1 << 63 else None) for (i, _), d in zip(rows, brute(rows)[5], strict=True)}


@pytest.mark.parametrize("top", [2**31 - 1, 3_037_000_499 // 2])
def test_deviation_at_the_edge_of_a_long(top):
    model = whitening.Whitening(2, 1, [top], np.eye(1), np.ones(1), np.eye(1))
    x = np.array([[0], [top]])
    exact, fits = model.deviations(x)
    for v, e, f in zip(x[:, 0].tolist(), exact.tolist(), fits.tolist(), strict=True):
        assert f == ((2 * v - top) ** 2 < 1 << 63) and (not f or e == (2 * v - top) ** 2)


def test_odd_tables(spark):
    empty = table(spark, [])
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, []), (3, [float("nan")])])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect() == []  # no variance, no component
    flat = [(i, [float(i), 5.0, 2.0 * i]) for i in range(10)]
    got = whitening.whiten(table(spark, flat + [(50, [1.0]), (51, [1e30, 0.0, 0.0])])).collect()
    assert {r.component for r in got} == {1} and len(got) == 10 and {r.n for r in got} == {10}
    assert abs(sum(r.whitened**2 for r in got) / 10 - 1) < 1e-9
    doubles = spark.createDataFrame([(i, [i * 0.5, i * i * 0.25]) for i in range(5)], "vec_id int, embedding array<double>")
    assert len(whitening.whiten(doubles).collect()) == 10
