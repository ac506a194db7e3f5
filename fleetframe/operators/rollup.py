"""Deployment roll-ups: one row per group from its nodes, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetframe import fixed

SINGLE_TYPES = [fixed.STANDALONE, fixed.ATLAS, fixed.MANAGER]
MANAGER_TYPES = [fixed.MANAGER, fixed.SERVER_GROUP]

SUMMARY_COLUMNS = ["grp", "name", "deployment_type", "state", "containers", "mongo_version", "port_range"]


def port_span(start: Column, size: Column) -> Column:
    """``start-(start+size-1)``: a formula over the start port, not the highest port in use."""
    return F.concat_ws("-", start.cast("string"), (start + size - 1).cast("string"))


def order_text(order: str = "product") -> str:
    """Sort key of a shard member: shard id times port, or shard id before port with ``order='shard_port'``."""
    if order == "product":
        return "bigint(shard_id) * bigint(port)"
    if order == "shard_port":
        return f"bigint(shard_id) * {fixed.MAX_PORT + 1}L + bigint(port)"
    raise ValueError(f"unknown shard order: {order}")


def measures(order: str = "product") -> dict[str, Column]:
    """The aggregates of a group of typed nodes from which every field of its roll-up follows.

    Only counts, minima and first-row picks are kept per group, so map tasks combine a hot group before the shuffle.
    """
    running, member = f"status = {_text(fixed.RUNNING)}", f"role = {_text(fixed.MEMBER)}"
    config, router = f"role = {_text(fixed.CONFIG)}", f"role = {_text(fixed.ROUTER)}"
    texts = {
        "rows": "count(1)",
        "running_rows": f"count_if({running})",
        "stopped_rows": f"count_if(NOT coalesce({running}, false))",
        "min_port": "min(port)",
        "max_port": "max(port)",
        "n_config": f"count_if({config})",
        "n_router": f"count_if({router})",
        "n_member": f"count_if({member})",
        "running_fixed": f"count_if({running} AND ({config} OR {router}))",
        "running_member": f"count_if({running} AND {member})",
        "config_start": f"min(CASE WHEN {config} THEN port END)",
        "group_shards": f"min_by(shard_count, CASE WHEN {member} THEN struct({order_text(order)}, seq) END)",
        "first": "min_by(struct(type, node, port, raw_port, status, version, group_size, start_port), seq)",
        "label_error": "max(coalesce(label_error, false))",
    }
    return {name: F.expr(text) for name, text in texts.items()}


def rollup(nodes: DataFrame, order: str = "product") -> DataFrame:
    """All measures of every group, for every type, in one pass over typed nodes."""
    grouped = nodes.where(F.col("grp").isNotNull()).groupBy("grp")
    return _dispatch(grouped.agg(*[m.alias(name) for name, m in measures(order).items()]))


def with_rollup(nodes: DataFrame, keep: list[str], order: str = "product") -> DataFrame:
    """The columns ``keep`` of every node next to the roll-up of its group as ``of``.

    The measures are taken over a window, which brings nodes and roll-up together with one shuffle of the nodes. For
    groups small enough for one task each; others are joined with their ``headers``.
    """
    group = Window.partitionBy("grp")
    # Plain columns under names of their own, so that those a caller does not use are never shuffled.
    kept = {c: f"__kept_{c}" for c in keep if c != "grp"}
    measured = nodes.where(F.col("grp").isNotNull()).select(
        "grp",
        *[F.col(c).alias(name) for c, name in kept.items()],
        *[m.over(group).alias(name) for name, m in measures(order).items()],
    )
    rolled = _dispatch(measured, list(kept.values()))
    of = F.struct(*[c for c in rolled.columns if c not in kept.values()]).alias("of")
    # The group column itself stays, so that what follows knows how the rows are partitioned.
    return rolled.select(*[F.col(kept[c]).alias(c) if c in kept else c for c in keep], of)


def headers(nodes: DataFrame, order: str = "product") -> DataFrame:
    """The roll-up of every group as one column: ``grp, of``."""
    rolled = rollup(nodes, order)
    return rolled.select("grp", F.struct(*rolled.columns).alias("of"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _up(test: str) -> str:
    return f"CASE WHEN {test} THEN {_text(fixed.RUNNING)} ELSE {_text(fixed.STOPPED)} END"


def _span(start: str, size: str) -> str:
    return f"concat_ws('-', string({start}), string({start} + {size} - 1))"


_SET, _CLUSTER = f"kind = {_text(fixed.REPLICA_SET)}", f"kind = {_text(fixed.SHARDED)}"
_GROUP, _MANAGER = f"kind = {_text(fixed.SERVER_GROUP)}", f"kind = {_text(fixed.MANAGER)}"

# Measures to roll-up fields, each by the type of the group's first node; later lines may use earlier ones.
_FIELDS = [
    "first.type AS kind",
    # Shard layout: slices of floor(members / shards); what is left over makes extra slices.
    f"coalesce({_CLUSTER} AND group_shards > 0 AND n_member > 0, false) AS sharded",
    "CASE WHEN sharded THEN n_member div greatest(group_shards, 1) END AS chunk_size",
    "CASE WHEN NOT sharded THEN 0L WHEN chunk_size > 0 THEN ceil(n_member / chunk_size) END AS n_chunks",
    "n_router + n_config + CASE WHEN sharded THEN n_chunks * chunk_size ELSE 0L END AS cluster_nodes",
    "running_fixed + CASE WHEN sharded THEN running_member ELSE 0L END AS cluster_running",
    "try_cast(first.group_size AS bigint) AS group_nodes",
    "try_cast(first.start_port AS int) AS group_start",
    f"""CASE WHEN {_SET} THEN rows WHEN {_CLUSTER} THEN cluster_nodes WHEN {_GROUP} THEN group_nodes
        WHEN kind IS NOT NULL THEN 1L END AS containers""",
    f"""CASE WHEN {_SET} THEN {_up("running_rows > 0")} WHEN {_CLUSTER} THEN {_up("cluster_running > 0")}
        WHEN {_MANAGER} OR {_GROUP} THEN first.status
        WHEN kind IS NOT NULL THEN {_up(f"first.status = {_text(fixed.RUNNING)}")} END AS state""",
    f"""CASE WHEN {_SET} THEN {_span("min_port", "rows")}
        WHEN {_CLUSTER} THEN CASE WHEN config_start IS NULL THEN '' ELSE {_span("config_start", "containers")} END
        WHEN {_GROUP} THEN CASE WHEN first.group_size <> '' AND first.start_port <> ''
          THEN {_span("group_start", "group_nodes")} ELSE '' END
        WHEN {_MANAGER} THEN first.raw_port ELSE string(first.port) END AS port_range""",
]

# What a roll-up row holds besides its key.
_OUT = [
    f"CASE WHEN {_SET} OR {_CLUSTER} THEN grp ELSE first.node END AS name",
    "kind AS deployment_type",
    "state",
    "containers",
    f"CASE WHEN {_GROUP} THEN {_text(fixed.SERVER_GROUP_VERSION)} ELSE first.version END AS mongo_version",
    "CASE WHEN kind IS NOT NULL THEN port_range END AS port_range",
    f"""CASE WHEN {_SET} THEN min_port WHEN {_CLUSTER} THEN config_start WHEN {_GROUP} THEN group_start
        ELSE first.port END AS start_port""",
    "max_port",
    "rows",
    "running_rows",
    "stopped_rows",
    "n_config",
    "n_router",
    "n_member",
    "config_start",
    "group_shards AS shard_count",
    "chunk_size",
    "n_chunks",
    "kind IS NULL AS type_error",
    "label_error",
    f"""CASE WHEN {_CLUSTER} AND n_config = 0 THEN 'no config servers'
        WHEN {_CLUSTER} AND chunk_size = 0 THEN 'fewer members than shards' END AS layout_error""",
]


def _dispatch(measured: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return measured.selectExpr("*", *_FIELDS).selectExpr("grp", *_OUT, *(keep or []))


def summaries(nodes: DataFrame, order: str = "product") -> DataFrame:
    """The summary of every deployment: six report fields under the group's key."""
    return rollup(nodes, order).select(*SUMMARY_COLUMNS)


def checked(rolled: DataFrame) -> DataFrame:
    """The same rows; fails at run time on an unknown type, a bad number or an impossible shard layout."""
    problem = (
        F.when(F.col("type_error"), "unknown deployment type")
        .when(F.col("label_error"), "label is not a number")
        .otherwise(F.col("layout_error"))
    )
    return rolled.where(
        F.when(problem.isNull(), True).otherwise(
            F.raise_error(F.concat(F.col("grp"), F.lit(": "), problem)).cast("boolean")
        )
    )


def status_counts(nodes: DataFrame) -> DataFrame:
    """Running and other nodes per group."""
    return rollup(nodes).select("grp", "running_rows", "stopped_rows")


def role_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per role, container count and port range of every sharded cluster."""
    return rollup(nodes).where(F.col("deployment_type") == fixed.SHARDED).select(
        "grp", "n_config", "n_router", "n_member", "n_chunks", "chunk_size", "containers", "port_range", "layout_error"
    )
