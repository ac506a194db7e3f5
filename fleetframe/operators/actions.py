"""Ordered action lists for stopping, removing and starting deployments. The lists are data; nothing is executed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe import fixed
from fleetframe.functions import safe_path
from fleetframe.operators.inventory import children
from fleetframe.operators.layout import listing
from fleetframe.operators.skew import HotKeys, positions

ACTIONS = ["stop", "remove", "start"]


def action_list(nodes: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """``grp, action, step, node``: for each action the nodes of every deployment in the order it must reach them.

    Routers, shard members, config servers when stopping or removing; config servers, routers, members when starting.
    Managed single nodes cannot be stopped; managers and their servers are removed as families (``family_removal``), so neither has
    steps here, and groups of unknown type have none. A stop step is idle if its node does not run.

    The report order (config, routers, members) is numbered once; the place of a node under each action is that number
    shifted by the size of the sections that move, so the three lists cost one numbering.
    """
    kind = F.col("of.deployment_type")
    listed = listing(nodes, hot=hot).where(~kind.isin(fixed.MANAGER, fixed.SERVER_GROUP))
    config = F.col("of.n_config")
    clustered = kind == fixed.SHARDED
    shown_members = F.when(F.col("of.n_chunks") == 0, 0).otherwise(F.col("of.n_member"))
    others = F.col("of.n_router") + shown_members
    last_first = (
        F.when(clustered & (F.col("section") == 0), F.col("place") + others)
        .when(clustered, F.col("place") - config)
        .otherwise(F.col("place"))
    )
    step = F.when(F.col("action") == "start", F.col("place")).otherwise(last_first)
    idle = (F.col("action") == "stop") & ~F.coalesce(F.col("status") == fixed.RUNNING, F.lit(False))
    removes_dir = (F.col("action") == "remove") & safe_path(F.col("data_dir"))
    reached = ~(clustered & (F.col("section") == 1)) & (kind != fixed.ATLAS)
    return (
        listed.withColumn("action", F.explode(F.array(*[F.lit(a) for a in ACTIONS])))
        .where(~((kind == fixed.ATLAS) & (F.col("action") == "stop")))
        .select(
            "grp", "action", step.alias("step"), "node", "id", idle.alias("idle"),
            F.when(removes_dir & reached, F.col("data_dir")).alias("remove_dir"),
        )
    )


def family_removal(nodes: DataFrame, managers: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """``manager, step, relation, node, id, remove_dir``: what goes with each manager of ``managers`` (column ``manager``), in order.

    Everything that names the manager as parent goes first, as listed; then the members of its application database by port, whose data
    directories go too where they may.
    """
    family = children(nodes, managers).withColumn("turn", F.when(F.col("relation") == "child", 0).otherwise(1))
    family = family.withColumn("sorter", F.when(F.col("turn") == 1, F.col("port")).otherwise(F.lit(0)))
    placed = positions(family, ["manager"], [F.col("turn"), F.col("sorter"), F.col("seq")], "step", hot=hot)
    removes = (F.col("turn") == 1) & safe_path(F.col("data_dir"))
    return placed.select("manager", "step", "relation", "node", "id", F.when(removes, F.col("data_dir")).alias("remove_dir"))


def safe_paths(nodes: DataFrame) -> DataFrame:
    """Nodes whose data directory may be acted on."""
    return nodes.where(safe_path(F.col("data_dir")))
