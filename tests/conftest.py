import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from fleetframe import LabelScheme, land, typed_nodes  # noqa: E402
from fleetframe.session import build  # noqa: E402
from fleetframe.sources.nodes import RECORD_SCHEMA  # noqa: E402

SCHEME = LabelScheme()


@pytest.fixture(scope="session")
def spark():
    session = build("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    # A few rows per test: interpreting the plans is much faster than compiling them.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()


def record(seq, name, group, port=27017, kind="Standalone", role="standalone", status="running", version="7.0.0", **labels):
    """One node record with labels as a provisioner writes them."""
    spelled = {
        "source": SCHEME.source_value,
        **{
            SCHEME.key(k): v
            for k, v in {
                "name": name, "group": group, "port": str(port), "role": role, "type": kind, "shard-id": "0",
                "shard-count": "2", "arbiter": "0", "data-dir": f"/var/data/{name}-db", "container-data-dir": "/data/db",
            }.items()
            if v is not None
        },
    }
    for key, value in labels.items():
        key = SCHEME.key(key.replace("_", "-"))
        if value is None:
            spelled.pop(key, None)
        else:
            spelled[key] = str(value)
    return (seq, f"{seq:064x}", status, spelled, [f"MONGO_VERSION={version}"], ["mongo:latest"], None)


def standalone(seq=1, name="sa", **more):
    return [record(seq, name, name, 27017, **more)]


def replica_set(seq=10, name="rs", size=3, start=27017, version="6.0.0"):
    return [
        record(seq + i, f"{name}-{i}", name, start + i - 1, "Replica Set", "rs-member", version=version)
        for i in range(1, size + 1)
    ]


def cluster(seq=100, name="sc", shards=3, replicas=3, config=3, routers=2, start=2000):
    rows, n = [], seq
    common = {"kind": "Sharded Cluster", "version": "5.0.0", "shard_count": shards}
    for i in range(1, config + 1):
        rows.append(record(n := n + 1, f"{name}-cfg-svr-{i}", name, start + i - 1, role="cfg-svr", **common))
    for i in range(1, routers + 1):
        rows.append(record(
            n := n + 1, f"{name}-mongos-{i}", name, start + config + i - 1, role="mongos",
            data_dir=None, container_data_dir=None, arbiter=None, shard_id=None, **common,
        ))
    base = start + config + routers
    for s in range(1, shards + 1):
        for i in range(1, replicas + 1):
            rows.append(record(
                n := n + 1, f"{name}-sh-{s}-{i}", name, base + (s - 1) * replicas + i, role="rs-member", shard_id=s, **common
            ))
    return rows


@pytest.fixture(scope="session")
def records_of(spark):
    return lambda rows: spark.createDataFrame(rows, RECORD_SCHEMA)


@pytest.fixture(scope="session")
def nodes_of(records_of):
    return lambda rows, **options: typed_nodes(land(records_of(rows), SCHEME), **options)


def rows(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
