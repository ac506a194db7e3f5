import json
import random

import pytest
from conftest import SCHEME, cluster, record, replica_set, rows, standalone
from pyspark.sql import functions as F

import fleetframe as ff
from fleetframe.operators import actions, inventory, layout, rollup, skew
from fleetframe.operators.skew import hot_keys
from fleetframe.plans.deployments import cluster_addresses, host_rows


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]


def test_standalone(nodes_of):
    r = one(rollup.rollup(nodes_of(standalone())))
    assert (r.name, r.deployment_type, r.state, r.containers, r.mongo_version, r.port_range) == (
        "sa", "Standalone", "running", 1, "7.0.0", "27017"
    )


def test_replica_set(nodes_of):
    nodes = nodes_of(replica_set())
    r = one(rollup.rollup(nodes))
    assert (r.start_port, r.containers, r.mongo_version, r.port_range) == (27017, 3, "6.0.0", "27017-27019")
    h = one(ff.host_strings(nodes))
    assert h.uri == "mongodb://rs-1:27017,rs-2:27018,rs-3:27019/?replicaSet=rs"
    assert h.set_address == "rs/rs-1:27017,rs-2:27018,rs-3:27019"


def test_five_members(nodes_of):
    assert one(rollup.rollup(nodes_of(replica_set(size=5)))).port_range == "27017-27021"


def test_cluster(nodes_of):
    r = one(rollup.rollup(nodes_of(cluster())))
    assert (r.n_config, r.n_router, r.n_member, r.n_chunks, r.chunk_size) == (3, 2, 9, 3, 3)
    # The range is a formula; the ports themselves reach one further.
    assert (r.containers, r.port_range, r.max_port, r.mongo_version) == (14, "2000-2013", 2014, "5.0.0")
    assert r.layout_error is None


def test_all_deployments_and_nothing(nodes_of):
    nodes = nodes_of(standalone() + replica_set())
    assert rows(ff.list_deployments(nodes), "grp") == [("rs",), ("sa",)]
    assert ff.list_deployments(nodes_of([])).count() == 0
    assert ff.get_deployment(nodes, "nope").count() == 0
    assert one(ff.get_deployment(nodes, "rs")).containers == 3
    assert one(ff.get_deployment(nodes, "rs-2", by_group=False)).containers == 1


def test_unknown_type(nodes_of):
    bad = [record(1, "a", "a", 1, kind="MySQL")]
    r = one(rollup.rollup(nodes_of(bad)))
    assert r.type_error and r.deployment_type is None
    with pytest.raises(Exception, match="unknown deployment type"):
        rollup.checked(rollup.rollup(nodes_of(bad))).collect()
    with pytest.raises(Exception, match="unknown deployment type"):
        rollup.rollup(nodes_of(bad, strict=True)).collect()


def test_bad_port_is_flagged(nodes_of):
    r = one(rollup.rollup(nodes_of([record(1, "a", "a", "x")])))
    assert r.label_error
    with pytest.raises(Exception, match="not a number"):
        rollup.checked(rollup.rollup(nodes_of([record(1, "a", "a", "x")]))).collect()


def test_missing_labels_take_defaults(nodes_of):
    r = nodes_of([record(1, "a", "a", type=None, arbiter=None, shard_id=None)]).first()
    assert (r.type, r.port, r.arbiter, r.shard_id) == ("Standalone", 27017, False, 0)


def test_state_rules(nodes_of):
    stopped = [record(1, "a", "g", 2, "Replica Set", "rs-member", "exited"), record(2, "b", "g", 1, "Replica Set", "rs-member")]
    nodes = nodes_of(stopped + [record(3, "m", "m", 9, "ops-manager", status="paused")])
    assert rows(rollup.rollup(nodes), "grp", "state", "running_rows", "stopped_rows", "mongo_version") == [
        ("g", "running", 1, 1, "7.0.0"), ("m", "paused", 0, 1, None)
    ]
    # Stopped nodes are not seen by default.
    assert rows(ff.list_deployments(nodes), "grp", "containers", "port_range") == [("g", 1, "1-1")]


def test_manager_and_servers(nodes_of):
    manager = record(1, "om", "om", 9080, "ops-manager", parent="om", network="net")
    manager = (*manager[:4], ["MONGO_VERSION=1", "VERSION=8.0.11"], None, None)
    servers = [
        record(i, f"srv-{i - 2}", "srv", 9081 + i, "ops-manager-deployment-server", group_size=3, parent="om", start_port=9083)
        for i in (2, 3, 4)
    ]
    nodes = nodes_of([manager] + servers)
    assert rows(rollup.summaries(nodes), *rollup.SUMMARY_COLUMNS) == [
        ("om", "om", "Ops Manager", "running", 1, "8.0.11", "9080"),
        ("srv", "srv-0", "Ops Manager Deployment Server", "running", 3, "-- Check OM --", "9083-9085"),
    ]
    urls = one(ff.endpoints(nodes).where("grp = 'om'"))
    assert (urls.network_url, urls.external_url, urls.uri) == ("http://om:9080", "http://localhost:9080", None)
    asked = nodes.where("grp = 'srv'").select("node", F.lit("om").alias("om_name"))
    assert rows(inventory.attach_manager(asked, nodes), "node", "om_network", "om_url")[0] == ("srv-0", "net", "http://om:9080")
    assert inventory.without_manager(asked.withColumn("om_name", F.lit("x")), nodes).count() == 3
    family = inventory.children(nodes, nodes.select(F.lit("om").alias("manager")))
    assert rows(family, "manager", "node") == [("om", "om"), ("om", "srv-0"), ("om", "srv-1"), ("om", "srv-2")]


def test_product_order_can_mix_shards(nodes_of):
    members = [
        record(1, "a", "c", 300, "Sharded Cluster", "rs-member", shard_id=1),
        record(2, "b", "c", 100, "Sharded Cluster", "rs-member", shard_id=2),
        record(3, "c", "c", 400, "Sharded Cluster", "rs-member", shard_id=1),
        record(4, "d", "c", 150, "Sharded Cluster", "rs-member", shard_id=2),
    ]
    nodes = nodes_of(members)
    by = lambda o: [r.node for r in layout.shard_members(nodes, o).orderBy("member_no").collect()]
    assert by("product") == ["b", "a", "d", "c"]
    assert by("shard_port") == ["a", "c", "b", "d"]
    heads = layout.shard_headers(layout.shard_members(nodes))
    assert rows(heads, "chunk", "shard_id", "start_port", "size") == [(0, 2, 100, 2), (1, 2, 150, 2)]
    with pytest.raises(ValueError):
        layout.shard_members(nodes, "other")


def test_uneven_and_impossible_layouts(nodes_of):
    def members(n, shards):
        return [record(i, f"n{i}", "c", i, "Sharded Cluster", "rs-member", shard_id=1, shard_count=shards) for i in range(1, n + 1)]

    five = nodes_of(members(5, 2))
    assert rows(layout.shard_headers(layout.shard_members(five)), "chunk", "size") == [(0, 2), (1, 2), (2, 1)]
    few = nodes_of(members(1, 2))
    assert one(layout.shard_members(few)).layout_error
    assert one(rollup.rollup(few)).layout_error == "no config servers"
    none = nodes_of(members(3, 0))
    assert one(rollup.rollup(none)).n_chunks == 0


def test_documents(nodes_of):
    docs = {r.grp: json.loads(r.document) for r in ff.detailed_documents(nodes_of(standalone() + replica_set() + cluster())).collect()}
    sa = docs["sa"]
    assert sa["port"] == 27017 and sa["is_arbiter"] is False and sa["container"]["image"] == ["mongo:latest"]
    assert [m["name"] for m in docs["rs"]["members"]] == ["rs-1", "rs-2", "rs-3"]
    assert docs["rs"]["members"][0]["mongo_version"] == "6.0.0"
    sc = docs["sc"]
    assert [len(s["members"]) for s in sc["shards"]] == [3, 3, 3]
    assert [s["port_range"] for s in sc["shards"]] == ["2006-2008", "2009-2011", "2012-2014"]
    assert {s["name"] for s in sc["shards"]} == {"sc"} and sc["config_servers_replica_set"]["name"] == "sc"
    assert sc["config_servers_replica_set"]["port_range"] == "2000-2002"
    assert [r["host_data_dir"] for r in sc["routers"]] == [None, None]
    summary = {r.grp: json.loads(r.document) for r in ff.summary_json(nodes_of(cluster())).collect()}
    assert summary["sc"]["containers"] == 14


def test_large_groups_come_in_parts_that_join_to_the_whole(nodes_of):
    nodes = nodes_of(replica_set(size=7) + cluster(shards=2, replicas=5))
    whole = ff.host_strings(nodes).collect()
    assert [(r.part, r.parts, r.uri) for r in whole] == [(0, 1, f"mongodb://{whole[0].hosts}/?replicaSet=rs")]
    pieces = sorted(ff.host_strings(nodes, part_rows=3).collect(), key=lambda r: r.part)
    assert ",".join(r.hosts for r in pieces) == whole[0].hosts
    assert [(r.part, r.parts, r.uri, r.set_address) for r in pieces] == [(i, 3, None, None) for i in range(3)]
    hosts = [r.host for r in host_rows(nodes).where("grp = 'rs'").orderBy("place").collect()]
    assert ",".join(hosts) == whole[0].hosts
    addresses = {r.set_name: r.address for r in cluster_addresses(nodes).collect()}
    assert addresses["sc-cfg-svr"].startswith("sc-cfg-svr/sc-cfg-svr-1:") and len(addresses) == 3
    assert all(r.address is None for r in cluster_addresses(nodes, part_rows=2).collect())
    full = {r.grp: json.loads(r.document) for r in ff.detailed_documents(nodes).collect()}
    parts = sorted(ff.detailed_documents(nodes, part_rows=4).collect(), key=lambda r: (r.grp, r.part))
    assert len(parts) == 2 + 4 and {(r.grp, r.parts) for r in parts} == {("rs", 2), ("sc", 4)}
    members = [m for r in parts if r.grp == "rs" for m in json.loads(r.document)["members"]]
    assert members == full["rs"]["members"]
    shards = [s for r in parts if r.grp == "sc" for s in json.loads(r.document)["shards"]]
    assert [m for s in shards for m in s["members"]] == [m for s in full["sc"]["shards"] for m in s["members"]]
    assert {s["port_range"] for s in shards if s["port_range"]} >= {s["port_range"] for s in full["sc"]["shards"]}
    config = [m for r in parts if r.grp == "sc" for m in json.loads(r.document)["config_servers_replica_set"]["members"]]
    assert config == full["sc"]["config_servers_replica_set"]["members"]


def test_groups_as_lists(nodes_of):
    slim = nodes_of(standalone() + replica_set(size=5)).select("grp", "node", "seq")
    whole = inventory.grouped(slim).where("grp = 'rs'").first()
    assert [m.node for m in whole.members] == [f"rs-{i}" for i in range(1, 6)]
    parts = inventory.grouped(slim, part_rows=2).where("grp = 'rs'").orderBy("part").collect()
    assert [[m.node for m in p.members] for p in parts] == [["rs-1", "rs-2"], ["rs-3", "rs-4"], ["rs-5"]]


def test_reports(nodes_of, tmp_path):
    nodes = nodes_of(standalone() + cluster())
    lines = [r.line for r in ff.in_order(ff.list_rows(nodes)).collect()]
    assert lines[0] == "| Name|Type|Status|Containers|Version|Port(s) |"
    assert lines[2:] == ["| sa|Standalone|running|1|7.0.0|27017 |", "| sc|Sharded Cluster|running|14|5.0.0|2000-2013 |"]
    detail = [r.line for r in ff.in_order(ff.detail_rows(nodes)).collect()]
    assert detail[:2] == ["**sa (standalone):**", "| Name | Port | Type | Hostname | Container ID |"]
    assert detail[3] == f"| sa|27017|mongod|sa:27017|{1:064x} |".replace(f"{1:064x}", f"{1:064x}"[:12])
    kinds = [line.split("|")[3] for line in detail[7:]]
    assert kinds == ["mongod (config)"] * 3 + ["mongos"] * 2 + ["mongod"] * 9
    ff.write_report(ff.summary_json(nodes), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    told = [json.loads(line) for line in text.strip().split("\n")]
    assert {d["name"]: d["document"]["containers"] for d in told} == {"sa": 1, "sc": 14}


def test_bad_values_stay_visible(nodes_of):
    members = replica_set(size=3)
    members[1] = record(12, None, "rs", 27018, "Replica Set", "rs-member")
    nodes = nodes_of([*members, *[record(i, f"odd-{i}", "odd", i, "Mystery Box") for i in (50, 51)]])
    found = one(ff.host_strings(nodes))
    assert (found.uri, found.set_address, found.name_error) == (None, None, True)
    lines = {r.line for r in ff.detail_rows(nodes).collect()}
    assert f"| unknown|27018|mongod|unknown|{12:064x} |".replace(f"{12:064x}", f"{12:064x}"[:12]) in lines
    assert "**odd-50 (unknown):**" in lines and sum("odd-5" in line for line in lines) == 3
    assert "| odd|unknown|unknown|None|7.0.0| |" in {r.line for r in ff.list_rows(nodes).collect()}
    odd = json.loads(one(ff.detailed_documents(nodes).where("grp = 'odd'")).document)
    assert odd["type_error"] and [m["name"] for m in odd["members"]] == ["odd-50", "odd-51"]
    assert odd["members"][0]["container"]["ports"] == {}


@pytest.mark.parametrize("many", [False, True])
def test_listing_does_not_depend_on_the_way(nodes_of, many):
    nodes = nodes_of(replica_set(size=7) + cluster(shards=2, replicas=5) + standalone())
    hot = skew.HotKeys(["grp"], None, many=True) if many else None
    first = {(r.grp, r.document) for r in ff.detailed_documents(nodes).collect()}
    assert {(r.grp, r.document) for r in ff.detailed_documents(nodes, hot=hot).collect()} == first


def test_unknown_values_in_rows(nodes_of):
    row = record(1, "a", "a", 1)
    nodes = nodes_of([(*row[:4], ["X=1"], None, None)])
    assert ff.list_rows(nodes).where("rank = 2").first().line == "| a|Standalone|running|1|unknown|1 |"


def test_actions(nodes_of):
    nodes = nodes_of(cluster(shards=1, replicas=2, config=1, routers=1) + replica_set(size=2) + [record(1, "at", "at", 1, "Atlas Deployment")])
    plan = actions.action_list(nodes)
    def of(group, action):
        return [r.node for r in plan.where((F.col("grp") == group) & (F.col("action") == action)).orderBy("step").collect()]
    assert of("sc", "stop") == of("sc", "remove") == ["sc-mongos-1", "sc-sh-1-1", "sc-sh-1-2", "sc-cfg-svr-1"]
    assert of("sc", "start") == ["sc-cfg-svr-1", "sc-mongos-1", "sc-sh-1-1", "sc-sh-1-2"]
    assert of("rs", "stop") == ["rs-1", "rs-2"]
    assert (of("at", "stop"), of("at", "remove"), of("at", "start")) == ([], ["at"], ["at"])
    assert rows(plan.where("remove_dir IS NOT NULL AND grp = 'sc'"), "node")[0] == ("sc-cfg-svr-1",)


def test_scans_lookups_and_bulk(records_of, nodes_of):
    data = standalone() + replica_set() + [record(5, "x", "x", 1, status="exited"), record(6, "y", None, 2)]
    foreign = (9, "f", "running", {"source": "else", SCHEME.key("group"): "f"}, [], None, None)
    records = records_of(data + [foreign])
    assert inventory.scan_records(records, SCHEME).count() == 5
    assert inventory.scan_records(records, SCHEME, include_stopped=True).count() == 6
    assert inventory.scan_records(records, SCHEME, name="f").count() == 1
    assert inventory.scan_records(records, SCHEME, name="rs-1", by_group=False).count() == 1
    assert inventory.with_label(records, SCHEME, "group").count() == 6
    nodes = nodes_of(data)
    assert inventory.scan_landed(nodes, SCHEME).count() == 5
    assert inventory.scan_landed(nodes, SCHEME, name="rs").count() == 3
    names = records_of([]).sparkSession.createDataFrame([("rs",), ("x",), ("q",), ("q",)], "grp string")
    assert rows(inventory.found(nodes, names), "node") == [("rs-1",), ("rs-2",), ("rs-3",)]
    assert rows(inventory.missing(nodes, names), "grp") == [("q",), ("x",)]
    assert rows(inventory.bulk_targets(nodes_of(data + [foreign])), "grp") == [("rs",), ("sa",)]
    # A group of this fleet whose running node another tool started is still reached; a wholly foreign one is not listed.
    mixed = (10, "m", "running", {"source": "else", SCHEME.key("group"): "x"}, [], None, None)
    assert rows(inventory.bulk_targets(nodes_of(data + [foreign, mixed])), "grp") == [("rs",), ("sa",), ("x",)]
    assert rows(ff.list_deployments(nodes_of(data + [foreign])), "grp") == [("rs",), ("sa",)]


def test_landed_files_filter_in_the_scan(spark, nodes_of, records_of, tmp_path):
    path = str(tmp_path / "landed")
    ff.write_landed(ff.land(records_of(standalone() + replica_set()), SCHEME), path)
    nodes = ff.typed_nodes(ff.read_landed(spark, path))
    one_group = ff.get_deployment(nodes, "rs")
    assert one(one_group).containers == 3
    plan = one_group._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(grp,rs)" in plan and "data_dir" not in plan.split("ReadSchema")[1]


def _brute(data):
    """Plain Python roll-up of replica sets and clusters, from the definitions."""
    out = {}
    groups = {}
    for seq, _id, status, labels, env, *_rest in data:
        get = lambda k: labels.get(SCHEME.key(k))
        groups.setdefault(get("group"), []).append(
            (seq, get("name"), int(get("port")), get("role"), int(get("shard-id") or 0), int(get("shard-count")), status, get("type"))
        )
    for grp, nodes in groups.items():
        nodes.sort()
        if nodes[0][7] == "Replica Set":
            members = sorted(nodes, key=lambda n: n[2])
            out[grp] = (len(nodes), f"{members[0][2]}-{members[0][2] + len(nodes) - 1}", [n[1] for n in members])
            continue
        config = sorted((n for n in nodes if n[3] == "cfg-svr"), key=lambda n: n[2])
        routers = sorted((n for n in nodes if n[3] == "mongos"), key=lambda n: n[2])
        members = sorted((n for n in nodes if n[3] == "rs-member"), key=lambda n: n[4] * n[2])
        shards = members[0][5] if members else 0
        slices = []
        if shards > 0 and members:
            step = len(members) // shards
            slices = [members[i:i + step] for i in range(0, len(members), step)]
        count = len(routers) + len(config) + (len(slices) * len(slices[0]) if slices else 0)
        shown = config + routers + [n for s in slices for n in s]
        out[grp] = (count, f"{config[0][2]}-{config[0][2] + count - 1}", [n[1] for n in shown])
    return out


@pytest.mark.parametrize("hot_rows", [None, 4])
def test_random_fleets_against_plain_python(spark, nodes_of, hot_rows):
    rng = random.Random(7)
    data, seq = [], 0
    for g in range(30):
        is_set = rng.random() < 0.4
        shards = rng.randint(1, 4)
        roles = ["rs-member"] * rng.randint(shards, 12)
        roles = roles if is_set else ["cfg-svr"] * rng.randint(1, 3) + ["mongos"] * rng.randint(0, 3) + roles
        rng.shuffle(roles)
        for i, role in enumerate(roles):
            seq += 1
            data.append(record(
                seq, f"g{g}-{i}", f"g{g}", rng.randint(1, 40), "Replica Set" if is_set else "Sharded Cluster", role,
                rng.choice(["running", "exited"]), shard_id=rng.randint(0, 3), shard_count=shards,
            ))
    expected = _brute(data)
    nodes = nodes_of(rng.sample(data, len(data)))
    hot = hot_keys(nodes, ["grp"], hot_rows) if hot_rows else None
    got = {r.grp: (r.containers, r.port_range) for r in rollup.rollup(nodes).collect()}
    assert got == {g: e[:2] for g, e in expected.items()}
    placed = {}
    for r in layout.listing(nodes, hot=hot).orderBy("grp", "place").collect():
        placed.setdefault(r.grp, []).append(r.node)
    assert placed == {g: e[2] for g, e in expected.items()}
