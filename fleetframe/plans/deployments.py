"""Listing, describing and exporting deployments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe import fixed
from fleetframe.functions import LabelScheme, endpoint_uri, manager_urls
from fleetframe.operators.inventory import running_only, scan_landed
from fleetframe.operators.layout import PART_ROWS, listing
from fleetframe.operators.rollup import SINGLE_TYPES, port_span, rollup, summaries
from fleetframe.operators.skew import HotKeys
from fleetframe.sources.nodes import PORTS_TYPE


def list_deployments(nodes: DataFrame, include_stopped: bool = False, scheme: LabelScheme = LabelScheme()) -> DataFrame:
    """One summary row per deployment of this fleet."""
    return summaries(scan_landed(nodes, scheme, include_stopped=include_stopped))


def get_deployment(nodes: DataFrame, name: str, include_stopped: bool = True, by_group: bool = True) -> DataFrame:
    """Summary of one deployment, empty if there is none. The name filter reaches the file scan."""
    kept = nodes.where(F.col("grp" if by_group else "node") == name)
    return summaries(kept if include_stopped else running_only(kept))


# --- member lists as text -------------------------------------------------------------------------------------------


def host_rows(nodes: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """``grp, section, chunk, place, host``: the ``node:port`` of every member of a set, config set or shard, in report order.

    Section 0 is the config set of a cluster, 2 the members of a set or, with their ``chunk``, of a shard. One row per node at every size.
    """
    kind = F.col("of.deployment_type")
    shown = (kind == fixed.REPLICA_SET) | ((kind == fixed.SHARDED) & F.col("section").isin(0, 2))
    host = F.concat("node", F.lit(":"), F.col("port").cast("string"))
    return listing(nodes, hot=hot, kinds=[fixed.REPLICA_SET, fixed.SHARDED]).where(shown).select("grp", "section", "chunk", "place", host.alias("host"))


def host_strings(nodes: DataFrame, part_rows: int = PART_ROWS, hot: HotKeys | None = None) -> DataFrame:
    """``hosts``, connection string ``uri`` and ``set_address`` of every replica set; ``host_rows`` is the form without a limit.

    ``hosts`` of a set of more than ``part_rows`` nodes come in ``parts`` rows, each a plain list. ``uri`` and ``set_address`` stand only where they are
    whole and true: they are null if a set has several parts or a member without a name or port (``name_error``).
    """
    sets = listing(nodes, part_rows=part_rows, hot=hot, kinds=[fixed.REPLICA_SET])
    host = F.concat("node", F.lit(":"), F.col("port").cast("string"))
    joined = sets.groupBy("grp", "part").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("place", host.alias("host"))))["host"], ",").alias("hosts"),
        F.max("of.rows").alias("size"),
        F.count_if(host.isNull()).alias("unnamed"),
    )
    parts = F.expr(f"(size + {part_rows - 1}) div {int(part_rows)}")
    whole = (parts == 1) & (F.col("unnamed") == 0)
    return joined.select(
        "grp",
        "part",
        parts.alias("parts"),
        "hosts",
        F.when(whole, F.concat(F.lit("mongodb://"), "hosts", F.lit("/?replicaSet="), "grp")).alias("uri"),
        F.when(whole, F.concat("grp", F.lit("/"), "hosts")).alias("set_address"),
        (F.col("unnamed") > 0).alias("name_error"),
    )


def cluster_addresses(nodes: DataFrame, part_rows: int = PART_ROWS, hot: HotKeys | None = None) -> DataFrame:
    """``grp, set_name, address``: set address of the config set and of each shard of every cluster, as routers are given them.

    The address is null where a member has no name or port, or where the set has more than ``part_rows`` nodes (see ``host_rows``).
    """
    host = F.concat("node", F.lit(":"), F.col("port").cast("string"))
    shown = listing(nodes, part_rows=part_rows, hot=hot, kinds=[fixed.SHARDED]).where((F.col("section") == 0) | F.col("chunk").isNotNull())
    name = F.when(F.col("section") == 0, F.concat("grp", F.lit("-cfg-svr"))).otherwise(F.concat("grp", F.lit("-sh-"), (F.col("chunk") + 1).cast("string")))
    # One size per set is known beforehand, so a set that is too large is never gathered.
    size = F.when(F.col("section") == 0, F.col("of.n_config")).otherwise(F.col("of.chunk_size"))
    entry = F.when(size <= part_rows, F.struct("place", host.alias("host")))
    joined = shown.select("grp", name.alias("set_name"), entry.alias("entry"), host.alias("host"), size.alias("size")).groupBy("grp", "set_name").agg(
        F.array_join(F.array_sort(F.collect_list("entry"))["host"], ",").alias("hosts"), F.count_if(F.col("host").isNull()).alias("unnamed"), F.max("size").alias("size")
    )
    whole = (F.col("unnamed") == 0) & (F.col("size") <= part_rows)
    return joined.select("grp", "set_name", F.when(whole, F.concat("set_name", F.lit("/"), "hosts")).alias("address"))


def endpoints(nodes: DataFrame) -> DataFrame:
    """Per single-node deployment its connection string, and for managers the network and local URLs."""
    rolled = rollup(nodes).where(F.col("deployment_type").isin(SINGLE_TYPES))
    is_manager = F.col("deployment_type") == fixed.MANAGER
    urls = manager_urls(F.col("name"), F.col("start_port"))
    return rolled.select(
        "grp",
        "deployment_type",
        F.when(~is_manager, endpoint_uri(F.col("name"), F.col("start_port"))).alias("uri"),
        F.when(is_manager, urls["network_url"]).alias("network_url"),
        F.when(is_manager, urls["external_url"]).alias("external_url"),
    )


# --- nested documents -----------------------------------------------------------------------------------------------


def _summary_fields() -> list[Column]:
    return [
        F.col("of.name").alias("name"),
        F.col("of.deployment_type").alias("deployment_type"),
        F.col("of.state").alias("state"),
        F.col("of.containers").alias("containers"),
        F.col("of.mongo_version").alias("mongo_version"),
    ]


def _node_fields() -> list[Column]:
    kind = F.col("of.deployment_type")
    router = (kind == fixed.SHARDED) & (F.col("section") == 1)
    single = kind.isin(SINGLE_TYPES)
    return [
        F.col("node").alias("name"),
        F.when(single, kind).when(router, fixed.ROUTER).otherwise("mongod").alias("deployment_type"),
        F.when(single, F.col("of.state")).otherwise(F.col("status")).alias("state"),
        F.lit(1).alias("containers"),
        F.when(single, F.col("of.mongo_version")).when(kind == fixed.REPLICA_SET, F.col("member_version"))
        .alias("mongo_version"),
        F.col("port").alias("port"),
        F.when(~router, F.col("data_dir")).alias("host_data_dir"),
        F.when(~router, F.col("container_data_dir")).alias("container_data_dir"),
        (F.col("arbiter") & ~router & (kind != fixed.ATLAS)).alias("is_arbiter"),
        F.struct(
            F.col("id").alias("id"),
            F.coalesce("image_tags", F.array().cast("array<string>")).alias("image"),
            F.coalesce("ports", F.create_map().cast(PORTS_TYPE)).alias("ports"),
        ).alias("container"),
    ]


def _set_fields(name: Column, kind: str, start: Column, size: Column, members: Column) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        name.alias("name"),
        F.lit(kind).alias("deployment_type"),
        text.alias("state"),
        size.alias("containers"),
        text.alias("mongo_version"),
        port_span(start, size).alias("port_range"),
        size.alias("size"),
        members.alias("members"),
    )


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def detailed_documents(nodes: DataFrame, part_rows: int = PART_ROWS, hot: HotKeys | None = None) -> DataFrame:
    """The full nested document of every deployment as JSON text: ``grp``, ``part``, ``parts``, ``document``.

    Members, routers, config set and shards are nested in report order. A deployment of more than ``part_rows`` nodes
    comes in several documents with the same head and consecutive nodes, so each stays small and none is cut. A shard
    that goes on in a later part has its port range in its first piece only. A cluster whose members cannot be split into
    shards shows them as ``unassigned`` next to the error.
    """
    listed = listing(nodes, part_rows=part_rows, hot=hot)
    # Bounded lists: at most part_rows nodes per (grp, part).
    pieces = (
        listed.groupBy("grp", "part", "section", "chunk")
        .agg(
            # By place only: maps, such as port bindings, have no order.
            F.array_sort(
                F.collect_list(F.struct("place", F.struct(*_node_fields()).alias("node"))),
                lambda a, b: F.signum(a["place"] - b["place"]).cast("int"),
            ).alias("placed"),
            F.min_by(F.struct("place", "port"), "place").alias("head"),
            F.any_value("of").alias("of"),
        )
        .withColumn("nodes", F.col("placed")["node"])
    )
    skipped = F.col("chunk") * F.col("of.chunk_size")
    chunk_start = F.col("of.n_config") + F.col("of.n_router") + skipped + 1
    start = F.when(F.col("head.place") == chunk_start, F.col("head.port"))
    size = F.least(F.col("of.chunk_size"), F.col("of.n_member") - skipped)
    shard = _set_fields(F.col("grp"), "shard", start, size, F.col("nodes"))
    in_section = lambda n: F.any_value(
        F.when((F.col("section") == n) & F.col("chunk").isNull(), F.col("nodes")), ignoreNulls=True
    )
    by_part = pieces.groupBy("grp", "part").agg(
        F.any_value("of").alias("of"),
        in_section(0).alias("config"),
        in_section(1).alias("routers"),
        in_section(2).alias("members"),
        F.array_sort(
            F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("chunk", shard.alias("shard")))),
            lambda a, b: F.signum(a["chunk"] - b["chunk"]).cast("int"),
        )["shard"].alias("shards"),
    )
    shown = F.when(F.col("of.deployment_type").isin(SINGLE_TYPES), 1).otherwise(F.greatest("of.rows", F.lit(1)))
    shown = F.when(F.col("of.deployment_type") == fixed.SHARDED, F.col("of.n_config") + F.col("of.n_router") + F.when(F.col("of.n_chunks") == 0, 0).otherwise(F.col("of.n_member"))).otherwise(shown)
    shown = F.when(F.col("of.deployment_type") == fixed.SERVER_GROUP, 1).otherwise(shown)
    return by_part.withColumn("shown", shown).select(
        "grp", "part", F.expr(f"(shown + {part_rows - 1}) div {int(part_rows)}").alias("parts"), _document().alias("document")
    )


def _document() -> Column:
    kind, head = F.col("of.deployment_type"), _summary_fields()
    span = F.col("of.port_range").alias("port_range")
    single = F.get("members", F.lit(0))
    node_tail = ["port", "host_data_dir", "container_data_dir", "is_arbiter", "container"]
    or_empty = lambda c: F.coalesce(F.col(c), F.array()).alias(c)
    config = _set_fields(
        F.col("grp"), fixed.REPLICA_SET, F.col("of.config_start"), F.col("of.n_config"), or_empty("config")
    )
    cluster = [*head, span, or_empty("routers"), config.alias("config_servers_replica_set"), F.col("shards")]
    return (
        F.when(kind == fixed.REPLICA_SET, _json(*head, span, F.col("of.rows").alias("size"), F.col("members")))
        .when((kind == fixed.SHARDED) & F.col("of.n_chunks").isNotNull(), _json(*cluster))
        .when(
            kind == fixed.SHARDED,
            _json(*cluster, F.col("of.layout_error").alias("layout_error"), or_empty("members").alias("unassigned")),
        )
        .when(kind.isin([fixed.STANDALONE, fixed.ATLAS]), _json(*head, *[single[c].alias(c) for c in node_tail]))
        .when(kind.isNull(), _json(*head, F.col("of.type_error").alias("type_error"), or_empty("members")))
        .otherwise(_json(*head, span))
    )
