"""Report rows and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe import fixed
from fleetframe.operators.layout import listing
from fleetframe.operators.rollup import rollup, summaries
from fleetframe.operators.skew import HotKeys

_TITLES = {fixed.REPLICA_SET: "replica set", fixed.SHARDED: "sharded cluster"}


def _or_unknown(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(fixed.UNKNOWN))


def _row(cells: list[Column], joint: str = "|") -> Column:
    """A line of a table; a cell without a value is ``unknown``, so that none is left out."""
    return F.concat(F.lit("| "), F.concat_ws(joint, *[F.coalesce(c, F.lit(fixed.UNKNOWN)) for c in cells]), F.lit(" |"))


def _rule(width: int) -> str:
    return "| " + "|".join([fixed.RULE_CELL] * width) + " |"


def list_rows(nodes: DataFrame) -> DataFrame:
    """Lines of the deployment table: ``rank`` 0 and 1 are the heading and the rule, 2 is one line per group."""
    spark = nodes.sparkSession
    heads = spark.createDataFrame(
        [(0, "| " + "|".join(fixed.LIST_HEADINGS) + " |"), (1, _rule(len(fixed.LIST_HEADINGS)))], "rank int, line string"
    )
    cells = [
        F.col("grp"),
        F.col("deployment_type"),
        _or_unknown(F.col("state")),
        F.coalesce(F.col("containers").cast("string"), F.lit("None")),
        _or_unknown(F.col("mongo_version")),
        F.coalesce("port_range", F.lit("")),
    ]
    lines = summaries(nodes).select(F.lit(2).alias("rank"), "grp", _row(cells).alias("line"))
    return heads.select("rank", F.lit(None).cast("string").alias("grp"), "line").unionByName(lines)


def detail_rows(nodes: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Lines of every deployment's node table, numbered by ``line_no`` within ``grp``.

    Line 0 is the title, 1 the heading, 2 the rule; nodes follow in report order.
    """
    kind = F.col("deployment_type")
    title = F.when(kind.isNull(), fixed.UNKNOWN).otherwise("standalone")
    for name, text in _TITLES.items():
        title = F.when(kind == name, text).otherwise(title)
    heads = rollup(nodes).select(
        "grp",
        F.posexplode(F.array(
            F.concat(F.lit("**"), F.coalesce("name", F.lit(fixed.UNKNOWN)), F.lit(" ("), title, F.lit("):**")),
            F.lit("| " + " | ".join(fixed.DETAIL_HEADINGS) + " |"),
            F.lit(_rule(len(fixed.DETAIL_HEADINGS))),
        )).alias("line_no", "line"),
    ).withColumn("line_no", F.col("line_no").cast("long"))
    clustered = F.col("of.deployment_type") == fixed.SHARDED
    node_type = (
        F.when(clustered & (F.col("section") == 0), "mongod (config)")
        .when(clustered & (F.col("section") == 1), fixed.ROUTER)
        .otherwise("mongod")
    )
    port = F.col("port").cast("string")
    cells = [
        F.col("node"), port, node_type, F.concat("node", F.lit(":"), port),
        F.coalesce(F.nullif("id", F.lit("")), F.lit(fixed.NO_ID)),
    ]
    lines = listing(nodes, hot=hot).select("grp", (F.col("place") + 2).alias("line_no"), _row(cells).alias("line"))
    return heads.unionByName(lines)


def in_order(lines: DataFrame) -> DataFrame:
    """Report lines sorted for reading; only this step needs a global sort."""
    return lines.orderBy(*[c for c in ("rank", "grp", "line_no") if c in lines.columns])


def summary_json(nodes: DataFrame) -> DataFrame:
    """``grp`` and the six summary fields as JSON text, nulls kept."""
    fields = F.struct("name", "deployment_type", "state", "containers", "mongo_version", "port_range")
    return summaries(nodes).select("grp", F.to_json(fields, {"ignoreNullFields": "false"}).alias("document"))


def report_lines(documents: DataFrame) -> DataFrame:
    """One JSON object per line: the deployment's ``name``, its part if there are several, and its ``document``."""
    extra = [c for c in ("part", "parts") if c in documents.columns]
    fields = [F.concat(F.lit(f'"{c}":'), F.col(c).cast("string")) for c in extra]
    name = F.regexp_replace(F.to_json(F.struct(F.col("grp").alias("name"))), r"^\{|\}$", "")
    return documents.select("grp", F.concat(F.lit("{"), F.concat_ws(",", name, *fields, F.concat(F.lit('"document":'), "document")), F.lit("}")).alias("line"))


def write_report(documents: DataFrame, path: str) -> None:
    """Write keyed documents as JSON Lines."""
    report_lines(documents).select(F.col("line").alias("value")).write.mode("overwrite").text(path)
