"""Deployment specs: defaults, validation, capacity, expansion to nodes, labels, conflicts, connection strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe import fixed
from fleetframe.functions import LabelScheme, mask_list
from fleetframe.operators.inventory import running_only
from fleetframe.operators.skew import HotKeys, keyed_join, matching, not_matching

TYPE_FLAGS = ["standalone", "replica_set", "sharded", "atlas"]


def with_defaults(specs: DataFrame) -> DataFrame:
    """Specs with every absent column added at its default and null settings replaced by it.

    A spec without a name is named after its ``seq``.
    """
    given = F.col("name") if "name" in specs.columns else F.lit(None).cast("string")
    specs = specs.withColumn("name", F.coalesce(given, F.concat(F.lit("deployment-"), F.col("seq").cast("string"))))
    for column, default in fixed.SPEC_DEFAULTS.items():
        if column not in specs.columns:
            value = F.lit(default) if default is not None else F.lit(None).cast("string")
            specs = specs.withColumn(column, value)
        elif default is not None:
            specs = specs.withColumn(column, F.coalesce(F.col(column), F.lit(default)))
    roles = F.array(*[F.lit(r) for r in fixed.DEFAULT_AUTH_ROLES])
    given = F.col("auth_roles") if "auth_roles" in specs.columns else F.lit(None).cast("array<string>")
    return specs.withColumn("auth_roles", F.when(F.size(given) > 0, given).otherwise(roles))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def violations(specs: DataFrame) -> DataFrame:
    """One row per broken rule of a spec: not exactly one type, or an arbiter on a standalone node."""
    chosen = sum((_flag(f).cast("int") for f in TYPE_FLAGS), F.lit(0))
    found = F.array_compact(F.array(
        F.when(chosen != 1, "exactly one type has to be set"),
        F.when(_flag("standalone") & _flag("arbiter"), "a standalone deployment has no arbiter"),
    ))
    return specs.select("seq", "name", F.explode(found).alias("violation"))


def valid_specs(specs: DataFrame) -> DataFrame:
    """Specs that break no rule."""
    chosen = sum((_flag(f).cast("int") for f in TYPE_FLAGS), F.lit(0))
    return specs.where((chosen == 1) & ~(_flag("standalone") & _flag("arbiter")))


def port_count() -> Column:
    """Ports (and nodes) a spec needs."""
    clustered = F.col("shards") * F.col("replicas") + F.col("config_servers") + F.col("mongos")
    return F.when(_flag("sharded"), clustered).when(_flag("replica_set"), F.col("replicas")).otherwise(F.lit(1))


def write_concern() -> Column:
    """Default write concern, set only for sets and clusters with an arbiter."""
    applies = _flag("arbiter") & (_flag("replica_set") | _flag("sharded"))
    return F.when(applies, F.expr("cast(replicas div 2 as int)"))


def capacity(specs: DataFrame) -> DataFrame:
    """Ports needed and default write concern per spec."""
    return specs.select("seq", "name", port_count().alias("ports"), write_concern().alias("write_concern"))


def _with_slots(df: DataFrame, count: str, block: int = 10_000) -> DataFrame:
    """Each row once per ``slot`` from 0 below ``count``, spread out in blocks so that no array is longer than one."""
    blocks = df.where(F.col(count) > 0).withColumn("block", F.explode(F.expr(f"sequence(0, ({count} - 1) div {block})")))
    slots = F.expr(f"sequence(int(block * {block}), int(least(block * {block} + {block - 1}, {count} - 1)))")
    return blocks.withColumn("slot", F.explode(slots)).drop("block")


def expand(specs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per planned node: ``seq, grp, slot, node, port, role, deployment_type, shard_id, arbiter``.

    Slot i of a spec listens on its start port + i: config servers first, then routers, then shard by shard. Role and
    name follow from the slot by arithmetic, so a spec of any size expands in one narrow step.
    """
    base = _with_slots(specs.withColumn("n", port_count().cast("int")), "n")
    slot, config, routers = F.col("slot"), F.col("config_servers"), F.col("mongos")
    rest = F.expr("slot - config_servers - mongos")
    sharded, is_set = _flag("sharded"), _flag("replica_set")
    in_config = sharded & (slot < config)
    in_router = sharded & ~in_config & (slot < config + routers)
    in_shard = sharded & (slot >= config + routers)
    shard_no = F.expr("cast((slot - config_servers - mongos) div greatest(replicas, 1) + 1 as int)")
    text = lambda c: c.cast("string")
    node = (
        F.when(in_config, F.concat("name", F.lit("-cfg-svr-"), text(slot + 1)))
        .when(in_router, F.concat("name", F.lit("-mongos-"), text(slot - config + 1)))
        .when(
            in_shard,
            F.concat("name", F.lit("-sh-"), text(shard_no), F.lit("-"), text(rest % F.greatest("replicas", F.lit(1)) + 1)),
        )
        .when(is_set, F.concat("name", F.lit("-"), text(slot + 1)))
        .otherwise(F.col("name"))
    )
    role = (
        F.when(in_config, fixed.CONFIG)
        .when(in_router, fixed.ROUTER)
        .when(in_shard | is_set, fixed.MEMBER)
        .when(_flag("atlas"), fixed.ATLAS_ROLE)
        .otherwise(fixed.SINGLE)
    )
    kind = (
        F.when(sharded, fixed.SHARDED)
        .when(is_set, fixed.REPLICA_SET)
        .when(_flag("atlas"), fixed.ATLAS)
        .otherwise(fixed.STANDALONE)
    )
    return base.select(
        "seq",
        F.col("name").alias("grp"),
        "slot",
        node.alias("node"),
        (F.col("port") + slot).cast("int").alias("port"),
        role.alias("role"),
        kind.alias("deployment_type"),
        F.when(in_shard, shard_no).otherwise(0).alias("shard_id"),
        (is_set & _flag("arbiter") & (slot == F.col("n") - 1)).alias("arbiter"),
        *keep,
    )


def expand_server_groups(groups: DataFrame) -> DataFrame:
    """Servers of agent groups (``seq, name, om_name, port, count``): ``{name}-{i}`` from 0 on consecutive ports."""
    return _with_slots(groups, "count").select(
        "seq",
        F.col("name").alias("grp"),
        "slot",
        F.concat("name", F.lit("-"), F.col("slot").cast("string")).alias("node"),
        (F.col("port") + F.col("slot")).cast("int").alias("port"),
        F.lit(fixed.RAW_SERVER).alias("role"),
        "om_name",
        F.col("count").cast("int").alias("group_size"),
        F.col("port").cast("int").alias("start_port"),
    )


def _labels(scheme: LabelScheme, source: str, values: dict[str, Column]) -> Column:
    entries = [F.lit(scheme.source_key), F.lit(source)]
    for name, value in values.items():
        entries += [F.lit(scheme.key(name)), F.coalesce(value.cast("string"), F.lit(""))]
    return F.create_map(*entries)


def _bit(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)).cast("int")


def node_labels(specs: DataFrame, scheme: LabelScheme = LabelScheme(), data_root: str = "/data") -> DataFrame:
    """Planned nodes with the label map each one is started with; all values are text.

    Routers carry no shard id, arbiter or directories; managed single nodes carry no shard id or arbiter.
    """
    nodes = expand(specs, ("shards", "ephemeral"))
    kept = ~_flag("ephemeral") & (F.col("role") != fixed.ATLAS_ROLE)
    host = F.when(kept, F.concat(F.lit(data_root.rstrip("/") + "/"), "node", F.lit("-db"))).otherwise("")
    common = {
        "name": F.col("node"),
        "group": F.col("grp"),
        "port": F.col("port"),
        "role": F.col("role"),
        "type": F.col("deployment_type"),
        "shard-count": F.coalesce("shards", F.lit(0)),
    }
    dirs = {"data-dir": host, "container-data-dir": F.when(kept, "/data/db").otherwise(""), "ephemeral": _bit("ephemeral")}
    shard = {"shard-id": F.col("shard_id"), "arbiter": _bit("arbiter")}
    source = scheme.source_value
    labels = (
        F.when(F.col("role") == fixed.ROUTER, _labels(scheme, source, common))
        .when(F.col("role") == fixed.ATLAS_ROLE, _labels(scheme, source, common | dirs))
        .otherwise(_labels(scheme, source, common | dirs | shard))
    )
    return nodes.select("seq", "grp", "slot", "node", labels.alias("labels"))


def manager_labels(managers: DataFrame, scheme: LabelScheme = LabelScheme()) -> DataFrame:
    """Managers (``seq, name, port, network_name``) with their label map and the name of their database deployment."""
    values = {
        "name": F.col("name"),
        "group": F.col("name"),
        "parent": F.col("name"),
        "port": F.col("port"),
        "network": F.col("network_name"),
        "role": F.lit(fixed.RAW_MANAGER),
        "type": F.lit(fixed.RAW_MANAGER),
    }
    return managers.select(
        "seq", F.col("name").alias("grp"), F.concat("name", F.lit(fixed.APP_DB_SUFFIX)).alias("app_db"),
        _labels(scheme, scheme.source_value, values).alias("labels"),
    )


def server_labels(groups: DataFrame, scheme: LabelScheme = LabelScheme()) -> DataFrame:
    """Agent servers with their label map."""
    values = {
        "name": F.col("node"),
        "group": F.col("grp"),
        "group-size": F.col("group_size"),
        "parent": F.col("om_name"),
        "port": F.col("port"),
        "start-port": F.col("start_port"),
        "role": F.lit(fixed.RAW_SERVER),
        "type": F.lit(fixed.RAW_SERVER),
    }
    return expand_server_groups(groups).select(
        "seq", "grp", "slot", "node", _labels(scheme, scheme.source_value, values).alias("labels")
    )


def repeated_names(specs: DataFrame) -> DataFrame:
    """Specs whose name an earlier spec (smaller ``seq``) of the same table has: planned one after another, the first gets the name."""
    firsts = specs.groupBy("name").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("specs")).where("specs > 1")
    return specs.join(firsts, "name").where(F.col("seq") > F.col("first_seq")).select(*specs.columns)


def name_collisions(specs: DataFrame, nodes: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Specs whose name a running deployment already has."""
    return matching(specs, running_only(nodes).select(F.col("grp").alias("name")), "name", hot)


def free_names(specs: DataFrame, nodes: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Specs whose name no running deployment has."""
    return not_matching(specs, running_only(nodes).select(F.col("grp").alias("name")), "name", hot)


def _ports(planned: DataFrame) -> DataFrame:
    return planned.where(F.col("port").between(0, fixed.MAX_PORT))


def port_conflicts(specs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per spec that cannot get all its ports: how many are taken by running nodes, shared with another spec, or out
    of range.

    Both sides are first reduced to one row per port. A port is a number up to 65535, so each of these tables is bounded
    by that and is broadcast: the planned rows are never shuffled by port, and no pairs of specs are built.
    """
    planned = expand(specs).select("seq", F.col("grp").alias("name"), "port")
    taken = _ports(running_only(nodes).select("port")).distinct().withColumn("taken", F.lit(True))
    claims = (
        _ports(planned).groupBy("port").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
        .select("port", (F.col("lo") != F.col("hi")).alias("shared"))
    )
    marked = planned.join(F.broadcast(taken), "port", "left").join(F.broadcast(claims), "port", "left")
    counted = marked.groupBy("seq", "name").agg(
        F.count_if(F.coalesce("taken", F.lit(False))).alias("taken_ports"),
        F.count_if(F.coalesce("shared", F.lit(False))).alias("shared_ports"),
        F.count_if(~F.col("port").between(0, fixed.MAX_PORT)).alias("invalid_ports"),
    )
    return counted.where((F.col("taken_ports") > 0) | (F.col("shared_ports") > 0) | (F.col("invalid_ports") > 0))


def host_port_conflicts(specs: DataFrame, nodes: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """``port_conflicts`` for a fleet on several machines: specs and nodes have a ``host``, and only ports of the same host collide.

    Columns: ``seq, name, host, taken_ports, shared_ports, invalid_ports``. A null host is the local one. Specs are told apart by ``seq``.

    Ports in use and planned ports are brought to one row per host and port in one shuffle, combined before it; only ports in conflict go on. A host may hold any
    share of the fleet, as its ports are spread by the pair. Planned rows on a port that many specs of a host want are not moved (``keyed_join``).
    """
    host = F.coalesce("host", F.lit("localhost")).alias("host")
    planned = expand(specs, keep=("host",)).select("seq", F.col("grp").alias("name"), host, "port")
    taken = _ports(running_only(nodes)).select(host, "port", F.lit(True).alias("taken"), F.lit(None).cast("long").alias("seq"))
    claims = _ports(planned).select("host", "port", F.lit(False).alias("taken"), F.col("seq").cast("long").alias("seq"))
    marks = taken.unionByName(claims).groupBy("host", "port").agg(
        F.max("taken").alias("taken"), (F.min("seq") != F.max("seq")).alias("shared")
    )
    # Without a claim there is no first or last spec, and ``shared`` is null.
    marks = marks.where(F.col("shared").isNotNull() & (F.col("taken") | F.col("shared")))
    hits = keyed_join(_ports(planned), marks, ["host", "port"], "inner", hot).select(
        "seq", "name", "host", "taken", "shared", F.lit(False).alias("invalid")
    )
    off = F.lit(False)
    beyond = planned.where(~F.col("port").between(0, fixed.MAX_PORT)).select(
        "seq", "name", "host", off.alias("taken"), off.alias("shared"), F.lit(True).alias("invalid")
    )
    return hits.unionByName(beyond).groupBy("seq", "name", "host").agg(
        F.count_if("taken").alias("taken_ports"), F.count_if("shared").alias("shared_ports"), F.count_if("invalid").alias("invalid_ports")
    )


def connections(specs: DataFrame, masked: bool = True) -> DataFrame:
    """Connection strings per spec: over localhost and over mapped host names, an array of one string per entry point.

    User and password are put in only if both are set, and the password is masked unless ``masked`` is off.
    """
    port = F.col("port").cast("string")
    auth = F.when(
        F.col("username").isNotNull() & F.col("password").isNotNull(),
        F.concat("username", F.lit(":"), "password", F.lit("@")),
    ).otherwise("")
    start = F.concat(F.lit("mongodb://"), auth)
    local = F.concat(start, F.lit("localhost:"))
    routers = F.when(F.col("mongos") > 0, F.sequence(F.lit(1), F.col("mongos").cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    members = F.when(F.col("replicas") > 0, F.sequence(F.lit(1), F.col("replicas").cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    text = lambda c: c.cast("string")
    router_port = lambda i: text(F.col("port") + F.col("config_servers") + i - 1)
    hosts = F.array_join(
        F.transform(members, lambda i: F.concat("name", F.lit("-"), text(i), F.lit(":"), text(F.col("port") + i - 1))),
        ",",
    )
    localhost = F.when(
        _flag("sharded"), F.transform(routers, lambda i: F.concat(local, router_port(i)))
    ).otherwise(F.array(F.concat(local, port)))
    mapped = (
        F.when(
            _flag("sharded"),
            F.transform(
                routers, lambda i: F.concat(start, "name", F.lit("-mongos-"), text(i), F.lit(":"), router_port(i))
            ),
        )
        .when(_flag("replica_set"), F.array(F.concat(start, hosts, F.lit("/?replicaSet="), "name")))
        .when(_flag("atlas"), F.array(F.concat(start, "name", F.lit(":"), port)))
        .otherwise(F.array(F.concat(start, "name", F.lit("-1:"), port, F.lit("/?directConnection=True"))))
    )
    hide = mask_list if masked else (lambda c: c)
    return specs.select("seq", "name", hide(localhost).alias("localhost"), hide(mapped).alias("mapped"))
