"""Node records: reading, landing as plain columns, typing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe import fixed
from fleetframe.functions import LabelScheme, canonical_type, default_to, env_value, known_type, short_id, to_int

RECORD_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("env", T.ArrayType(T.StringType())),
    T.StructField("image_tags", T.ArrayType(T.StringType())),
    T.StructField("ports", T.MapType(T.StringType(), T.ArrayType(T.StructType([
        T.StructField("HostIp", T.StringType()), T.StructField("HostPort", T.StringType()),
    ])))),
])

# Landed column -> label field. Plain columns, unlike map values, are pruned and filtered inside the file scan.
LABEL_COLUMNS = {
    "grp": "group",
    "node": "name",
    "raw_type": "type",
    "role": "role",
    "port": "port",
    "shard_id": "shard-id",
    "shard_count": "shard-count",
    "arbiter": "arbiter",
    "data_dir": "data-dir",
    "container_data_dir": "container-data-dir",
    "parent": "parent",
    "group_size": "group-size",
    "start_port": "start-port",
    "network": "network",
}
PORTS_TYPE = RECORD_SCHEMA["ports"].dataType.simpleString()
LANDED_COLUMNS = ["seq", "id", "status", "env", "image_tags", "ports", "source", "version_label", *LABEL_COLUMNS]


def read_records(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Node records with a label map. ``seq`` must hold the order in which the inventory lists them."""
    return spark.read.schema(RECORD_SCHEMA).format(fmt).load(path)


def land(records: DataFrame, scheme: LabelScheme = LabelScheme()) -> DataFrame:
    """Spread the labels that the operators use into plain string columns."""
    labels = F.col("labels")
    return records.select(
        "seq",
        "id",
        "status",
        "env",
        "image_tags",
        F.col("ports") if "ports" in records.columns else F.lit(None).cast(PORTS_TYPE).alias("ports"),
        F.try_element_at(labels, F.lit(scheme.source_key)).alias("source"),
        F.try_element_at(labels, F.lit("version")).alias("version_label"),
        *[scheme.label(labels, field).alias(column) for column, field in LABEL_COLUMNS.items()],
    )


def write_landed(landed: DataFrame, path: str) -> None:
    """Write landed nodes as Parquet, sorted by group within files so that group filters skip row groups."""
    landed.sortWithinPartitions("grp", "seq").write.mode("overwrite").parquet(path)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Read landed nodes."""
    return spark.read.parquet(path)


def typed_nodes(landed: DataFrame, strict: bool = False) -> DataFrame:
    """Landed nodes with defaults, typed fields, canonical type and resolved version.

    A port or shard label that is not a number gives null and ``label_error``; with ``strict`` an unknown type or a bad
    number is an error. Missing landed columns are taken as null.
    """
    absent = set(LANDED_COLUMNS) - set(landed.columns)
    if absent:
        special = {"env": "array<string>", "image_tags": "array<string>", "ports": PORTS_TYPE}
        kind = {c: special.get(c, "string") for c in absent}
        landed = landed.withColumns({c: F.lit(None).cast(kind[c]) for c in sorted(absent)})
    number = (lambda c: F.expr(f"int(coalesce({c}, '0'))")) if strict else (lambda c: to_int(default_to(F.col(c), "0")))
    server_version = env_value(F.col("env"), fixed.SERVER_VERSION_VAR)
    version = (
        F.when(F.col("raw_type") == fixed.RAW_ATLAS, F.col("version_label"))
        .when(F.col("raw_type") == fixed.RAW_MANAGER, env_value(F.col("env"), fixed.MANAGER_VERSION_VAR))
        .otherwise(server_version)
    )
    raw = default_to(F.col("raw_type"), fixed.STANDALONE)
    port, shard_id, shard_count = number("port"), number("shard_id"), number("shard_count")
    return landed.select(
        "seq",
        "grp",
        "node",
        "source",
        (known_type(raw) if strict else canonical_type(raw)).alias("type"),
        "role",
        port.alias("port"),
        shard_id.alias("shard_id"),
        shard_count.alias("shard_count"),
        F.expr("coalesce(arbiter = '1', false)").alias("arbiter"),
        "status",
        version.alias("version"),
        server_version.alias("member_version"),
        short_id(F.col("id")).alias("id"),
        "image_tags",
        "ports",
        "data_dir",
        "container_data_dir",
        "parent",
        "group_size",
        "start_port",
        "network",
        F.col("port").alias("raw_port"),
        (port.isNull() | shard_id.isNull() | shard_count.isNull()).alias("label_error"),
    )
