"""Inventory scans and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe import fixed
from fleetframe.functions import LabelScheme, canonical_type, default_to, overlay, short_id
from fleetframe.functions.labels import env_value
from fleetframe.operators.skew import HotKeys, keyed_join, matching, positions


def running_only(nodes: DataFrame) -> DataFrame:
    """Nodes that run."""
    return nodes.where(F.col("status") == fixed.RUNNING)


def scan_records(
    records: DataFrame,
    scheme: LabelScheme = LabelScheme(),
    name: str | None = None,
    include_stopped: bool = False,
    by_group: bool = True,
) -> DataFrame:
    """Records of this fleet, or, given ``name``, records of that group (or node); a name replaces the source filter."""
    labels = F.col("labels")
    if name:
        wanted = scheme.label(labels, "group" if by_group else "name") == name
    else:
        wanted = F.try_element_at(labels, F.lit(scheme.source_key)) == scheme.source_value
    kept = records.where(wanted)
    return kept if include_stopped else running_only(kept)


def scan_landed(
    landed: DataFrame,
    scheme: LabelScheme = LabelScheme(),
    name: str | None = None,
    include_stopped: bool = False,
    by_group: bool = True,
) -> DataFrame:
    """The same scan over landed or typed columns, where the filters reach the file reader."""
    if name:
        kept = landed.where(F.col("grp" if by_group else "node") == name)
    else:
        kept = landed.where(F.col("source") == scheme.source_value)
    return kept if include_stopped else running_only(kept)


def with_label(records: DataFrame, scheme: LabelScheme, name: str) -> DataFrame:
    """Records that have the label ``name`` at all."""
    return records.where(F.map_contains_key("labels", F.lit(scheme.key(name))))


def flat_labels(records: DataFrame, scheme: LabelScheme = LabelScheme(), prefixed: bool = True) -> DataFrame:
    """``seq`` and the label map with id, status, version and type put over it; by default fleet labels only."""
    raw = scheme.label(F.col("labels"), "type")
    version = (
        F.when(raw == fixed.RAW_ATLAS, F.try_element_at(F.col("labels"), F.lit("version")))
        .when(raw == fixed.RAW_MANAGER, env_value(F.col("env"), fixed.MANAGER_VERSION_VAR))
        .otherwise(env_value(F.col("env"), fixed.SERVER_VERSION_VAR))
    )
    values = {
        scheme.key("container-id"): short_id(F.col("id")),
        scheme.key("container-status"): F.col("status"),
        scheme.key("mongo-version"): version,
        scheme.key("type"): default_to(raw, fixed.STANDALONE),
    }
    return records.select("seq", overlay(F.col("labels"), values, scheme.prefix if prefixed else None).alias("labels"))


def grouped(nodes: DataFrame, part_rows: int = 10_000, hot: HotKeys | None = None) -> DataFrame:
    """Nodes gathered per group in input order: ``grp, part, members``.

    A group of more than ``part_rows`` nodes fills several rows, numbered by ``part``.
    """
    placed = positions(nodes.where(F.col("grp").isNotNull()), ["grp"], ["seq"], "place", hot=hot)
    fields = F.struct("place", F.struct(*[c for c in nodes.columns if c != "grp"]).alias("node"))
    gathered = placed.groupBy("grp", F.expr(f"(place - 1) div {int(part_rows)}").alias("part")).agg(
        F.array_sort(F.collect_list(fields)).alias("placed")
    )
    return gathered.select("grp", "part", F.col("placed")["node"].alias("members"))


def unknown_types(landed: DataFrame) -> DataFrame:
    """Nodes whose type is not one of the known ones."""
    return landed.where(canonical_type(default_to(F.col("raw_type"), fixed.STANDALONE)).isNull())


def found(nodes: DataFrame, names: DataFrame, include_stopped: bool = False, hot: HotKeys | None = None) -> DataFrame:
    """Nodes of the groups listed in ``names`` (column ``grp``)."""
    kept = nodes if include_stopped else running_only(nodes)
    return matching(kept, names, "grp", hot)


def missing(nodes: DataFrame, names: DataFrame, include_stopped: bool = False) -> DataFrame:
    """Distinct names that no group in ``nodes`` has."""
    kept = nodes if include_stopped else running_only(nodes)
    return names.select("grp").distinct().join(kept.select("grp").distinct(), "grp", "left_anti")


def children(nodes: DataFrame, managers: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Everything that goes with each manager in ``managers`` (column ``manager``): nodes that name it as parent, and
    nodes of its application database group. One row per (manager, node, relation)."""
    named = managers.select("manager").distinct()
    owner = F.when(
        F.endswith("grp", F.lit(fixed.APP_DB_SUFFIX)), F.expr(f"left(grp, length(grp) - {len(fixed.APP_DB_SUFFIX)})")
    )
    link = lambda relation, name: F.struct(F.lit(relation).alias("relation"), name.alias("manager"))
    links = F.explode(F.array(link("child", F.col("parent")), link("app-db", owner))).alias("link")
    linked = nodes.select("*", links).select(*nodes.columns, "link.relation", "link.manager")
    return keyed_join(linked, named, "manager", "left_semi", hot)


def attach_manager(servers: DataFrame, managers: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Servers (column ``om_name``) with their running manager's network and URL; servers without one drop out.

    Of several manager nodes with one name the first listed is used.
    """
    chosen = (
        running_only(managers)
        .groupBy(F.col("node").alias("om_name"))
        .agg(F.min_by(F.struct("network", F.coalesce("raw_port", F.lit("None")).alias("port")), "seq").alias("om"))
        .select(
            "om_name",
            F.col("om.network").alias("om_network"),
            F.concat(F.lit("http://"), "om_name", F.lit(":"), F.col("om.port")).alias("om_url"),
        )
    )
    return keyed_join(servers, chosen, "om_name", "inner", hot)


def without_manager(servers: DataFrame, managers: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Servers whose manager does not run or does not exist."""
    names = running_only(managers).select(F.col("node").alias("om_name")).distinct()
    return keyed_join(servers, names, "om_name", "left_anti", hot)


def bulk_targets(nodes: DataFrame, scheme: LabelScheme = LabelScheme()) -> DataFrame:
    """Groups a bulk removal reaches: groups of this fleet (some node has its source) with at least one running node, of any source."""
    flags = nodes.where(F.col("grp").isNotNull()).groupBy("grp").agg(
        F.max(F.col("source") == scheme.source_value).alias("own"), F.max(F.col("status") == fixed.RUNNING).alias("runs")
    )
    return flags.where("own AND runs").select("grp")
