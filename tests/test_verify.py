"""Digests of contents: every kind of difference shows, order does not."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetframe.sources import catalog as store
from fleetframe.sources import verify
from tests.conftest import rows

SCHEMA = "k string, a string, b string, n double, t timestamp, xs array<string>, ys array<array<int>>, m map<string,int>, `odd.name` int"
ROW = ("k", "a", None, 1.5, dt.datetime(2024, 1, 1, 0, 0, 0, 1), ["x", None], [[1], [2]], {"a": 1, "b": None}, 1)


@pytest.fixture(scope="module")
def of(spark):
    return lambda *found: spark.createDataFrame(list(found), SCHEMA)


def changed(**values):
    names = ["k", "a", "b", "n", "t", "xs", "ys", "m", "odd"]
    return tuple(values.get(name, old) for name, old in zip(names, ROW, strict=True))


@pytest.mark.parametrize("other", [
    changed(a=None, b="a"), changed(b=""), changed(b="null"), changed(t=dt.datetime(2024, 1, 1, 0, 0, 0, 2)), changed(n=1.5000000000000002),
    changed(xs=["x"]), changed(xs=[None, "x"]), changed(ys=[[1, 2]]), changed(ys=[[], [1], [2]]), changed(m={"a": 1}), changed(odd=2),
])
def test_a_changed_row_shows(of, other):
    assert verify.content_digest(of(ROW)) != verify.content_digest(of(other))


def test_order_and_partitions_do_not_count_but_repeats_do(of):
    some = [changed(a=str(i)) for i in range(20)]
    one = verify.content_digest(of(*some))
    assert one == verify.content_digest(of(*reversed(some)).repartition(7)) and one.rows == 20
    assert verify.content_digest(of(*some, some[0])) != one
    # As many rows, one of them twice in place of another.
    assert verify.content_digest(of(*some[1:], some[1])) != one
    assert verify.content_digest(of()) == (0, 0, 0)


def test_differing_groups(of):
    sent = [changed(k=k, a=str(i)) for k in ("same", "lost", "twice", "swap", None, "moved") for i in range(5)]
    landed = [r for r in sent if r[:2] != ("lost", "0")] + [r for r in sent if r[:2] == ("twice", "1")]
    landed = [(r[0], "x", *r[2:]) if r[:2] == ("swap", "3") else r for r in landed]
    landed = [("new", *r[1:]) if r[:2] == ("moved", "2") else r for r in landed]
    landed = [(r[0], r[1], "y", *r[3:]) if r[0] is None and r[1] == "4" else r for r in landed]
    got = verify.differing(of(*sent), of(*reversed(landed)).select(*[f"`{c}`" for c in reversed(of().columns)]), ["k"])
    want = [("lost", 5, 4), ("moved", 5, 4), ("new", 0, 1), ("swap", 5, 5), ("twice", 5, 6), (None, 5, 5)]
    assert rows(got, "k", "sent_rows", "landed_rows") == sorted(want, key=repr)
    assert verify.differing(of(*sent), of(*sent), ["k"]).count() == 0 and verify.differing(of(), of(), ["k"]).count() == 0


def test_differing_combines_before_its_one_shuffle(of):
    plan = verify.differing(of(ROW), of(ROW), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan and "Join" not in plan


def test_write_verified_sees_content(spark, of, tmp_path, monkeypatch):
    assert store.write_verified(of(ROW, ROW, changed(a="z")), str(tmp_path / "a")) == 3
    assert store.write_verified(of(), str(tmp_path / "none")) == 0
    honest = store.content_digest
    monkeypatch.setattr(store, "content_digest", lambda df: honest(df.withColumn("a", F.when(F.col("a") == "z", "y").otherwise(F.col("a")))))
    with pytest.raises(RuntimeError, match="not the same"):
        store.write_verified(of(ROW, ROW, changed(a="z")), str(tmp_path / "b"))
    monkeypatch.setattr(store, "content_digest", lambda df: honest(df.limit(2)))
    with pytest.raises(RuntimeError, match="3 rows sent, 2 landed"):
        store.write_verified(of(ROW, ROW, changed(a="z")), str(tmp_path / "c"))
