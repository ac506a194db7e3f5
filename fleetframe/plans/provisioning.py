"""Planning deployments: from specs to checked node plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.functions import LabelScheme
from fleetframe.operators.inventory import running_only
from fleetframe.operators.planning import (
    connections,
    expand,
    name_collisions,
    node_labels,
    port_conflicts,
    repeated_names,
    valid_specs,
    violations,
    with_defaults,
)
from fleetframe.operators.skew import not_matching
from fleetframe.session import pinned


@dataclass
class Plan:
    """Outcome of planning: nodes to start, and why other specs cannot be."""

    nodes: DataFrame
    labels: DataFrame
    connections: DataFrame
    rejected: DataFrame


def plan_deployments(
    specs: DataFrame, inventory: DataFrame, scheme: LabelScheme = LabelScheme(), data_root: str = "/data"
) -> Plan:
    """Check specs (unique ``seq``) against their rules, the running names and the ports in use, then expand the rest.

    ``rejected`` has ``seq, name, reason``, one row per reason. Specs with free names and their port conflicts are
    written to the shared folder, so the inventory is read once per check and not once per result.
    """
    specs = with_defaults(specs)
    broken = violations(specs)
    valid = valid_specs(specs)
    taken = name_collisions(valid, inventory)
    again = repeated_names(valid)
    single = valid.join(again.select("seq"), "seq", "left_anti")
    free = pinned(not_matching(single, running_only(inventory).select(F.col("grp").alias("name")), "name"))
    conflicts = pinned(port_conflicts(free, inventory))
    ready = free.join(conflicts.select("seq"), "seq", "left_anti")
    rejected = (
        broken.withColumnRenamed("violation", "reason")
        .unionByName(taken.select("seq", "name", F.lit("a deployment of this name runs").alias("reason")))
        .unionByName(again.select("seq", "name", F.lit("an earlier spec has this name").alias("reason")))
        .unionByName(conflicts.select("seq", "name", F.lit("a port is taken or shared").alias("reason")))
    )
    return Plan(expand(ready), node_labels(ready, scheme, data_root), connections(ready), rejected)
