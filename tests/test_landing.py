import pytest
from conftest import SCHEME, cluster, replica_set, rows, standalone

from fleetframe import land
from fleetframe.operators import layout, rollup
from fleetframe.plans import deployments
from fleetframe.sources import landing
from fleetframe.sources.nodes import typed_nodes


@pytest.fixture
def landed(records_of):
    records = standalone() + replica_set() + replica_set(seq=40, name="big", size=30) + cluster() + cluster(seq=300, name="sc2", shards=2)
    return land(records_of(records), SCHEME)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


WORK = {
    "summary": lambda nodes, hot: rollup.summaries(nodes),
    "order": lambda nodes, hot: layout.member_order(nodes.select("seq", "grp", "port"), hot),
    "members": lambda nodes, hot: layout.shard_members(nodes, hot=hot).select("seq", "grp", "member_no", "chunk"),
    "hosts": lambda nodes, hot: deployments.host_rows(nodes, hot),
}


@pytest.mark.parametrize("work", list(WORK))
@pytest.mark.parametrize(("limit", "most"), [(1_000_000, 10_000), (10, 10_000), (10, 1)])
def test_work_by_group(spark, landed, tmp_path, work, limit, most):
    plain = WORK[work](typed_nodes(landed), None)
    want = rows(plain, *plain.columns)
    try:
        spark.conf.set("spark.fleetframe.hotRows", limit)
        spark.conf.set("spark.fleetframe.broadcastRows", most)
        made = landing.land_nodes(landed, str(tmp_path / "inv"), buckets=3)
        assert bool(made.hot) == (limit == 10) and made.hot.many == (most == 1)
        got = made.by_group(WORK[work])
        assert rows(got, *plain.columns) == want
        assert rows(made.nodes(), "seq", "grp", "port") == rows(typed_nodes(landed), "seq", "grp", "port")
    finally:
        spark.conf.unset("spark.fleetframe.hotRows")
        spark.conf.unset("spark.fleetframe.broadcastRows")


def test_no_shuffle_by_group(spark, landed, tmp_path):
    made = landing.land_nodes(landed, str(tmp_path / "inv"), buckets=3)
    for work in ("summary", "order", "hosts"):
        plan = plan_of(made.by_group(WORK[work]))
        assert "Exchange" not in plan and "Bucketed: true" in plan
    assert "Exchange" in plan_of(WORK["summary"](typed_nodes(landed), None))


def test_versions_of_the_inventory(spark, landed, tmp_path):
    root = str(tmp_path / "inv")
    with pytest.raises(ValueError, match="nothing is landed"):
        landing.open_landing(spark, root)
    first = landing.land_nodes(landed, root, buckets=2)
    second = landing.land_nodes(landed.where("grp <> 'rs'"), root, buckets=4)
    assert (first.version, second.version) == (1, 2)
    # The earlier version stays readable, and another session finds the buckets again.
    spark.sql(f"DROP TABLE {landing._table(spark, landing.CommitLog(spark, root).folder(landing.CommitLog(spark, root).read(1).folders[0] + '/usual'))}")
    again = landing.open_landing(spark, root, 1)
    plan = plan_of(again.by_group(WORK["summary"]))
    assert "Exchange" not in plan and again.usual.count() == landed.count()
    assert landing.open_landing(spark, root).nodes().where("grp = 'rs'").count() == 0


def test_rows_without_a_group_and_empty_inventories(spark, landed, tmp_path):
    loose = landed.limit(2).withColumn("grp", landed["grp"].substr(1, 0)).selectExpr("* except(grp)", "cast(null as string) as grp").select(landed.columns)
    made = landing.land_nodes(landed.unionByName(loose), str(tmp_path / "a"), buckets=2)
    assert made.nodes().where("grp is null").count() == 2
    assert rows(made.by_group(WORK["summary"]), "grp") == rows(WORK["summary"](typed_nodes(landed), None), "grp")
    assert landing.land_nodes(landed.limit(0), str(tmp_path / "b")).by_group(WORK["summary"]).count() == 0


@pytest.mark.parametrize(("limit", "most"), [(1_000_000, 10_000), (10, 10_000), (10, 1)])
def test_large_inventories_are_dealt_in_steps(spark, landed, tmp_path, monkeypatch, limit, most):
    monkeypatch.setattr(landing, "BUCKET_ROWS", 4)
    monkeypatch.setattr(landing, "SLICE_ROWS", 10)
    shared = tmp_path / "shared"
    monkeypatch.setattr(landing, "scratch_path", lambda _, label: str(shared / label))
    steps, deleted = [], landing.CommitLog.delete
    monkeypatch.setattr(landing.CommitLog, "delete", lambda self, path: (steps.append(path), deleted(self, path)))
    try:
        spark.conf.set("spark.fleetframe.hotRows", limit)
        spark.conf.set("spark.fleetframe.broadcastRows", most)
        made = landing.land_nodes(landed, str(tmp_path / "inv"), buckets=3)
        assert made.hot.many == (most == 1)
        # The staged rows go slice by slice, and nothing is left of them.
        assert len(steps) == 4 and not (shared / "landing").exists()
        for work in WORK.values():
            plain = work(typed_nodes(landed), None)
            assert rows(made.by_group(work), *plain.columns) == rows(plain, *plain.columns)
        assert rows(made.nodes(), "seq", "grp", "port") == rows(typed_nodes(landed), "seq", "grp", "port")
    finally:
        spark.conf.unset("spark.fleetframe.hotRows")
        spark.conf.unset("spark.fleetframe.broadcastRows")
    # A bucket holds about BUCKET_ROWS rows however few buckets were asked for, in one file.
    folder = landing.CommitLog(spark, str(tmp_path / "inv")).read()
    assert folder.note["buckets"] == 3 * -(-landed.count() // 12)
    files = [f.name.rsplit("_", 1)[1].split(".")[0] for f in (tmp_path / "inv" / folder.folders[0] / "usual").glob("*.parquet")]
    assert len(files) == len(set(files)) or most == 1
    assert "Exchange" not in plan_of(made.by_group(WORK["summary"])) or limit == 10


def test_shuffle_files_go_as_jobs_of_a_landing_end(spark, landed, tmp_path, monkeypatch):
    plain, seen = landing._land, []
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    monkeypatch.setattr(landing, "_land", lambda *a: (seen.append(spark.conf.get(name)), plain(*a))[1])
    before = spark.conf.get(name)
    landing.land_nodes(landed, str(tmp_path / "inv"), buckets=2)
    assert seen == ["true"] and spark.conf.get(name) == before
