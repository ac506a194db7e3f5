import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetframe.operators import skew


@pytest.fixture
def data(spark):
    rng = random.Random(3)
    # One key owns a third of the rows, one is null.
    keys = ["hot"] * 300 + [f"k{i % 80}" for i in range(500)] + [None] * 100
    rng.shuffle(keys)
    table = [(k, rng.randint(0, 5), i) for i, k in enumerate(keys)]
    return table, spark.createDataFrame(table, "k string, v int, seq long").repartition(6)


def brute(table):
    groups = {}
    for row in sorted(table, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return sorted(
        ((k, v, s, i, len(g), g[0][2]) for g in groups.values() for i, (k, v, s) in enumerate(g, 1)), key=repr
    )


@pytest.mark.parametrize("limit", [None, 50, 2])
@pytest.mark.parametrize("broadcast", [10_000, 1])
def test_positions_do_not_depend_on_the_way(monkeypatch, data, limit, broadcast):
    table, df = data
    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast)
    hot = skew.hot_keys(df, ["k"], limit)
    assert bool(hot) is (limit is not None)
    got = skew.positions(df, ["k"], [F.col("v"), F.col("seq")], size="n", first={"first_seq": "seq"}, hot=hot)
    assert rows(got, "k", "v", "seq", "position", "n", "first_seq") == brute(table)


def test_whole_table_numbering(data):
    table, df = data
    got = skew.positions(df, [], [F.col("v").desc(), F.col("seq")])
    expected = [(s, i) for i, (_, _, s) in enumerate(sorted(table, key=lambda r: (-r[1], r[2])), 1)]
    assert rows(got, "seq", "position") == sorted(expected, key=repr)


@pytest.mark.parametrize("limit", [None, 50, 2])
@pytest.mark.parametrize("broadcast", [10_000, 1])
def test_joins_do_not_depend_on_the_way(monkeypatch, spark, data, limit, broadcast):
    table, df = data
    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast)
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("zz", 3), (None, 4)], "k string, w int")
    hot = skew.hot_keys(df.where("k IS NOT NULL"), ["k"], limit)
    known = {"hot": 1, "k3": 2}
    inner = skew.keyed_join(df, right, "k", hot=hot)
    assert rows(inner, "k", "seq", "w") == sorted(((k, s, known[k]) for k, _, s in table if k in known), key=repr)
    assert rows(skew.matching(df, right, "k", hot), "seq") == sorted(((s,) for k, _, s in table if k in known), key=repr)
    assert rows(skew.not_matching(df, right, "k", hot), "seq") == sorted(
        ((s,) for k, _, s in table if k not in known), key=repr
    )


def test_many_hot_keys_never_meet_on_the_bare_key(spark, data):
    _, df = data
    many = skew.HotKeys(["k"], None, many=True)
    right = spark.createDataFrame([("hot", 1)], "k string, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [skew.matching(df, right, "k", many), skew.positions(df, ["k"], [F.col("v"), F.col("seq")], hot=many)]
        joined, numbered = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(k#" in joined and ", __salt#" in joined
    # The rows themselves are joined to their task's start by key and task; only one row per key and task meets on the key.
    assert "hashpartitioning(k#" in numbered and "__run#" in numbered


def test_hot_limit_is_a_session_setting(spark, data):
    _, df = data
    assert not skew.hot_keys(df, ["k"])
    spark.conf.set("spark.fleetframe.hotRows", "50")
    try:
        assert rows(skew.hot_keys(df, ["k"]).rows, "*") == [("hot",), (None,)]
    finally:
        spark.conf.unset("spark.fleetframe.hotRows")
