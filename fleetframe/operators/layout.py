"""Member order, shard slices and the ordered node listing of a deployment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe import fixed
from fleetframe.operators.rollup import SINGLE_TYPES, headers, order_text, with_rollup
from fleetframe.operators.skew import HotKeys, hot_keys, keyed_join, positions, range_positions, window_positions
from fleetframe.session import pinned

PART_ROWS = 10_000
NODE_FIELDS = [
    "seq", "grp", "node", "role", "port", "shard_id", "status", "arbiter", "member_version", "id", "image_tags", "ports",
    "data_dir", "container_data_dir",
]
_REPORT_ORDER = ["section", "sorter", "seq"]


def member_order(nodes: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """``member_no``: place of each node in its group by port, ties in input order."""
    return positions(nodes, ["grp"], [F.col("port"), F.col("seq")], "member_no", hot=hot)


def shard_members(nodes: DataFrame, order: str = "product", hot: HotKeys | None = None) -> DataFrame:
    """Shard members of clusters with their ``member_no`` and ``chunk`` (from 0).

    A slice holds floor(members / shards) nodes; a group with fewer members than shards has no slices and is flagged.
    """
    members = nodes.where((F.col("role") == fixed.MEMBER) & F.col("grp").isNotNull())
    placed = positions(
        members, ["grp"], [F.expr(order_text(order)), F.col("seq")], "member_no",
        size="n_member", first={"group_shards": "shard_count"}, hot=hot,
    )
    size = F.expr("CASE WHEN group_shards > 0 THEN n_member div group_shards END")
    return placed.withColumn("chunk_size", size).withColumns({
        "chunk": F.expr("CASE WHEN chunk_size > 0 THEN (member_no - 1) div chunk_size END"),
        "layout_error": F.coalesce(F.col("chunk_size") == 0, F.lit(False)),
    })


def shard_headers(members: DataFrame) -> DataFrame:
    """One row per slice of ``shard_members``: shard id and start port of its first node, and its size."""
    return (
        members.where(F.col("chunk").isNotNull())
        .groupBy("grp", "chunk")
        .agg(
            F.min_by(F.struct("shard_id", "port"), "member_no").alias("head"),
            F.count(F.lit(1)).alias("size"),
        )
        .select(
            "grp", "chunk", F.col("head.shard_id").alias("shard_id"), F.col("head.port").alias("start_port"), "size"
        )
    )


def fixed_chunks(df: DataFrame, keys: list[str], order: list, size: int = 20) -> DataFrame:
    """Cut each group (or, without keys, the whole table) into slices of ``size`` rows, numbered from 0."""
    placed = positions(df, keys, order, "position")
    return placed.withColumn("chunk", F.expr(f"(position - 1) div {int(size)}"))


def listing(
    nodes: DataFrame, order: str = "product", part_rows: int = PART_ROWS, hot: HotKeys | None = None, kinds: list[str] | None = None
) -> DataFrame:
    """The nodes a deployment report shows, each with its ``place`` in the report, next to its group's roll-up (``of``).

    Sections are config servers (0), routers (1), members (2; all nodes of a group of unknown type). Single-node types show their first node only; clusters
    show the nodes of the three roles (members without a ``chunk`` if the layout is in error). ``part`` numbers slices of ``part_rows`` places: results that nest nodes are
    built per part, so that no row or task has to hold a whole group however large it is. ``kinds`` keeps groups of these types only, before
    anything is numbered.
    """
    wanted = F.lit(True) if kinds is None else F.col("of.deployment_type").isin(kinds)
    nodes = nodes.where(F.col("grp").isNotNull())
    hot = hot if hot is not None else hot_keys(nodes, ["grp"])
    if hot.many:
        return _placed(_range_listing(nodes, order, wanted), part_rows)
    shown = _shown(with_rollup(hot.without(nodes) if hot else nodes, NODE_FIELDS, order).where(wanted), order)
    placed = window_positions(shown, ["grp"], _REPORT_ORDER, "place")
    if hot:
        large = hot.only(nodes)
        # One row per hot group; it is joined on again after the numbering, so the sort carries nodes only.
        of = pinned(headers(large, order).where(wanted))
        shown = _shown(large.join(F.broadcast(of), "grp").select(*NODE_FIELDS, "of"), order).drop("of")
        numbered = range_positions(shown, ["grp"], _REPORT_ORDER, "place", n_keys=hot.count)
        placed = placed.unionByName(numbered.join(F.broadcast(of), "grp"))
    return _placed(placed, part_rows)


def _range_listing(nodes: DataFrame, order: str, wanted: Column) -> DataFrame:
    """The listing where very many groups are hot: roll-ups meet nodes over salted keys and all nodes are numbered by a range sort."""
    of = pinned(headers(nodes, order).where(wanted))
    every = HotKeys(["grp"], None, many=True)
    shown = _shown(keyed_join(nodes.select(*NODE_FIELDS), of, "grp", hot=every), order).drop("of")
    numbered = range_positions(shown, ["grp"], _REPORT_ORDER, "place", n_keys=None)
    return keyed_join(numbered, of, "grp", hot=every)


def _placed(placed: DataFrame, part_rows: int) -> DataFrame:
    clustered = F.col("of.deployment_type") == fixed.SHARDED
    return (
        placed.where(~F.col("single") | (F.col("place") == 1))
        .withColumn("member_no", F.col("place") - F.col("of.n_config") - F.col("of.n_router"))
        .withColumns({
            "chunk": F.when(
                clustered & (F.col("section") == 2) & (F.col("of.chunk_size") > 0),
                F.expr("(member_no - 1) div greatest(of.chunk_size, 1)"),
            ),
            "part": F.expr(f"(place - 1) div {int(part_rows)}"),
        })
        .drop("sorter", "single", "member_no")
    )


def _shown(joined: DataFrame, order: str) -> DataFrame:
    """Nodes that a report shows, with the columns they are sorted by."""
    kind, role = F.col("of.deployment_type"), F.col("role")
    clustered = kind == fixed.SHARDED
    single = kind.isin([*SINGLE_TYPES, fixed.SERVER_GROUP])
    section = (
        F.when(single | (kind == fixed.REPLICA_SET) | kind.isNull(), 2)
        .when(clustered & (role == fixed.CONFIG), 0)
        .when(clustered & (role == fixed.ROUTER), 1)
        .when(clustered & (role == fixed.MEMBER) & (F.col("of.n_chunks").isNull() | (F.col("of.n_chunks") > 0)), 2)
    )
    sorter = (
        F.when(single, F.lit(0).cast("long"))
        .when(clustered & (role == fixed.MEMBER), F.expr(order_text(order)))
        .otherwise(F.col("port").cast("long"))
    )
    single = F.coalesce(single, F.lit(False))
    return joined.withColumns({"section": section, "sorter": sorter, "single": single}).where("section IS NOT NULL")
