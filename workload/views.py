"""Views that give the test tables the shapes of node records, tags, specs, logs and archives.

The SQL runs unchanged on Spark and on DuckDB; ``{table}`` stands for a test table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.functions import LabelScheme
from fleetframe.sources.nodes import LABEL_COLUMNS

SCHEME = LabelScheme()

INV = """
SELECT k * 10 + n AS seq, concat('dep-', CAST(k AS STRING)) AS grp,
 concat('dep-', CAST(k AS STRING), '-', CAST(n AS STRING)) AS node,
 CASE k % 8 WHEN 0 THEN 'Standalone' WHEN 1 THEN 'Replica Set' WHEN 2 THEN 'Sharded Cluster'
  WHEN 3 THEN 'Atlas Deployment' WHEN 4 THEN 'ops-manager' WHEN 5 THEN 'ops-manager-deployment-server'
  WHEN 6 THEN 'replica_set' ELSE NULL END AS raw_type,
 CASE WHEN k % 8 = 2 THEN CASE WHEN n <= 2 THEN 'cfg-svr' WHEN n = 3 THEN 'mongos' ELSE 'rs-member' END
  WHEN k % 8 IN (1, 6) THEN 'rs-member' ELSE 'standalone' END AS role,
 CAST(20000 + (k % 1000) * 10 + (8 - n) AS STRING) AS port,
 CASE WHEN k % 8 = 2 AND n > 3 THEN CASE WHEN n <= 5 THEN '2' ELSE '1' END ELSE '0' END AS shard_id,
 '2' AS shard_count, CASE WHEN ls = 'O' THEN 'running' ELSE 'exited' END AS status,
 concat('PATH=/usr/bin;MONGO_VERSION=', CAST(4 + pk % 5 AS STRING), '.0.', CAST(pk % 31 AS STRING),
  ';VERSION=8.0.11') AS env,
 concat(CAST(6 + pk % 3 AS STRING), '.0.0') AS version_label,
 CASE WHEN k % 8 = 5 THEN concat('dep-', CAST(k - 1 AS STRING)) ELSE NULL END AS parent,
 CASE WHEN k % 8 = 5 THEN CAST(1 + k % 4 AS STRING) ELSE NULL END AS group_size,
 CASE WHEN k % 8 = 5 THEN CAST(20000 + (k % 1000) * 10 AS STRING) ELSE NULL END AS start_port,
 CASE WHEN rf = 'A' AND n = 7 THEN '1' ELSE '0' END AS arbiter,
 CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN '/' ELSE concat('/data/dep-', CAST(k AS STRING)) END AS data_dir,
 CASE WHEN n % 4 = 3 THEN '/data/db' ELSE '' END AS container_data_dir,
 CASE WHEN rf = 'R' THEN 'other' ELSE 'fleet' END AS source,
 concat('net-', CAST(k % 3 AS STRING)) AS network,
 concat(md5(concat('dep-', CAST(k AS STRING), '-', CAST(n AS STRING))), md5(CAST(k AS STRING))) AS id
FROM (SELECT l_orderkey AS k, l_linenumber AS n, chr(min(ascii(l_linestatus))) AS ls, chr(min(ascii(l_returnflag))) AS rf,
       min(l_partkey) AS pk
      FROM {lineitem} GROUP BY l_orderkey, l_linenumber) b
"""

# The same nodes with what careless provisioners write: unknown types, ports that are no numbers, members without a name.
ODD_INV = """
SELECT seq, grp, CASE WHEN seq % 37 = 5 THEN NULL ELSE node END AS node,
 CASE WHEN CAST(floor(seq / 10) AS BIGINT) % 24 = 7 THEN 'Mystery Box' ELSE raw_type END AS raw_type, role,
 CASE WHEN seq % 41 = 3 AND CAST(floor(seq / 10) AS BIGINT) % 8 <> 2 THEN 'auto' ELSE port END AS port,
 shard_id, shard_count, status, env, version_label, parent, group_size, start_port, arbiter, data_dir, container_data_dir,
 source, network, id
FROM ({inv}) i
""".replace("{inv}", INV)

# All order lines of a customer segment as members of one replica set: a few groups hold all rows.
WIDE_INV = """
SELECT l_orderkey * 10 + l_linenumber AS seq, concat('wide-', CAST(l_suppkey % 3 AS STRING)) AS grp,
 concat('m-', CAST(l_orderkey * 10 + l_linenumber AS STRING)) AS node, 'replica_set' AS raw_type, 'rs-member' AS role,
 CAST(20000 + l_partkey % 20000 AS STRING) AS port, 'running' AS status, 'fleet' AS source
FROM {lineitem}
"""

TAGS = """
SELECT p_partkey AS seq, CASE p_partkey % 10
  WHEN 0 THEN 'latest' WHEN 1 THEN CAST(3 + p_size % 6 AS STRING)
  WHEN 2 THEN concat(CAST(3 + p_size % 6 AS STRING), '.', CAST(p_partkey % 3 AS STRING))
  WHEN 3 THEN concat(CAST(3 + p_size % 6 AS STRING), '.', CAST(p_partkey % 3 AS STRING), '.',
   CAST(p_partkey % 31 AS STRING), '-rc', CAST(p_size AS STRING))
  WHEN 4 THEN concat('nanoserver-', CAST(p_size AS STRING))
  ELSE concat(CAST(3 + p_size % 6 AS STRING), '.', CAST(p_partkey % 3 AS STRING), '.',
   CAST(p_partkey % 31 AS STRING), '-', lower(p_type)) END AS tag
FROM {part}
"""

# Tags as an earlier load knew them: same rule, other sizes and one part more, so they overlap the new ones in part.
OLD_TAGS = TAGS.replace("p_size", "(p_size + 3)").replace("p_partkey % 31", "(p_partkey + 1) % 31")

# Tags with the odd spellings that a version parser meets.
ODD_TAGS = """
SELECT seq, tag FROM ({tags}) t
UNION ALL SELECT seq, concat(replace(tag, '.', '-'), '.1') FROM ({tags}) t
UNION ALL SELECT seq, concat(split_part(tag, '-', 1), '12') FROM ({tags}) t
UNION ALL SELECT seq, concat(split_part(tag, '-', 1), '.', CAST(seq AS STRING)) FROM ({tags}) t
UNION ALL SELECT seq, concat(CAST(20231012123045 + seq AS STRING), '-x') FROM ({tags}) t
""".replace("{tags}", TAGS)

SPEC = """
SELECT c_custkey AS seq, concat('dep-', CAST(c_custkey AS STRING)) AS name,
 CASE c_custkey % 5 WHEN 0 THEN 'standalone' WHEN 1 THEN 'replica_set' WHEN 2 THEN 'sharded' WHEN 3 THEN 'atlas'
  ELSE 'invalid' END AS kind,
 20000 + (c_custkey % 1000) * 30 AS port, 1 + 2 * (c_custkey % 4) AS replicas, 1 + c_custkey % 3 AS shards,
 1 + c_custkey % 2 AS config_servers, 1 + c_nationkey % 2 AS mongos, c_acctbal < 0 AS arbiter,
 CASE WHEN c_mktsegment LIKE '%U%' THEN lower(c_mktsegment) END AS username,
 CASE WHEN c_nationkey % 3 = 0 THEN concat('pw', CAST(c_nationkey AS STRING)) END AS password,
 c_nationkey % 4 = 1 AS ephemeral
FROM {customer}
"""

SERVER_SPEC = """
SELECT s_suppkey AS seq, concat('srv-', CAST(s_suppkey AS STRING)) AS name,
 concat('dep-', CAST(s_suppkey * 4 AS STRING)) AS om_name,
 9080 + (s_suppkey % 1000) * 8 AS port, 1 + s_nationkey % 5 AS count
FROM {supplier}
"""

LOGS = """
SELECT event_id AS seq, user_id, event_type, CASE event_id % 5
  WHEN 0 THEN concat('2024-01-01T00:00:', lpad(CAST(event_id % 60 AS STRING), 2, '0'), '.',
   lpad(CAST(event_id % 1000 AS STRING), 3, '0'), '+0000 I  ', event_type)
  WHEN 1 THEN concat('connect mongodb://', event_type, ':pw', CAST(user_id AS STRING), '@host',
   CAST(event_id % 7 AS STRING), ':27017')
  WHEN 2 THEN concat('hosts mongodb://localhost:27017 then mongodb+srv://u:', event_type, '@h')
  WHEN 3 THEN concat('1', chr(10), '2024-01-01T00:00:00.000+0000 W  x', chr(10), event_type)
  ELSE 'mongodb://localhost:27017' END AS line
FROM {events}
"""

ARCHIVE = """
SELECT p_partkey AS seq, CASE WHEN p_partkey % 4 = 0 THEN 'currentReleases' ELSE 'oldReleases' END AS section,
 concat(CAST(4 + p_size % 5 AS STRING), '.0.', CAST(p_partkey % 31 AS STRING)) AS version,
 CASE WHEN p_partkey % 3 = 0 THEN 'arm64' ELSE 'x86_64' END AS arch,
 CASE WHEN p_size % 2 = 0 THEN 'deb' ELSE 'rpm-el8' END AS package_format,
 CASE WHEN p_partkey % 5 < 3 THEN 'tar.gz' ELSE 'deb' END AS link_name,
 concat('https://downloads.example.com/', CAST(p_partkey AS STRING)) AS download_link
FROM {part}
"""

PAIR_TEXT = """
SELECT page_id, split_part(split_part(url, '?', 2), '#', 1) AS text FROM {pages}
"""

TABLES = ["lineitem", "part", "customer", "supplier", "events", "orders", "pages"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run the SQL of a view on the tables it names."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def sql(text: str) -> str:
    """The SQL of a view with plain table names."""
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text.strip()


def landed(spark: SparkSession, sf_dir: str, inventory: str = INV) -> DataFrame:
    """Nodes as landed columns."""
    nodes = view(spark, sf_dir, inventory)
    if "env" not in nodes.columns:
        return nodes
    binding = F.array(F.struct(F.lit("0.0.0.0").alias("HostIp"), F.col("port").alias("HostPort")))
    return nodes.withColumns({"env": F.split("env", ";"), "ports": F.create_map(F.lit("27017/tcp"), binding)})


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as records with a label map.

    Absent values have no key, and nodes on line 6 belong to no group.
    """
    nodes = landed(spark, sf_dir)
    nodes = nodes.withColumn("grp", F.when(~F.endswith("node", F.lit("-6")), F.col("grp")))
    entries = [F.lit(SCHEME.source_key), F.col("source"), F.lit("version"), F.col("version_label")]
    for column, field in LABEL_COLUMNS.items():
        entries += [F.lit(SCHEME.key(field)), F.col(column)]
    labels = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
    return nodes.select(
        "seq", "id", "status", labels.alias("labels"), "env", F.lit(None).cast("array<string>").alias("image_tags"), "ports"
    )


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs with one flag per type."""
    rows = view(spark, sf_dir, SPEC)
    kinds = ["standalone", "replica_set", "sharded", "atlas"]
    return rows.withColumns({k: F.col("kind") == k for k in kinds})


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested archive documents, each with one release of two platforms and two links per platform."""
    row = view(spark, sf_dir, ARCHIVE)
    other_arch = F.when(F.col("arch") == "arm64", "x86_64").otherwise("arm64")
    other_link = F.when(F.col("link_name") == "deb", "tar.gz").otherwise("deb")

    def platform(arch, tail):
        link = lambda name, end: F.struct(
            name.alias("name"), F.concat("download_link", F.lit(tail + end)).alias("download_link")
        )
        links = F.array(link(F.col("link_name"), ""), link(other_link, "/b"))
        return F.struct(
            arch.alias("arch"), F.col("package_format"), F.struct(links.alias("links")).alias("packages")
        )

    release = F.array(F.struct(
        F.col("version"), F.array(platform(F.col("arch"), ""), platform(other_arch, "/a")).alias("platform")
    ))
    return row.select(
        F.when(F.col("section") == "currentReleases", release).alias("currentReleases"),
        F.when(F.col("section") == "oldReleases", release).alias("oldReleases"),
    )


def log_records(logs: DataFrame) -> DataFrame:
    """Log lines as records with positional and named arguments."""
    return logs.select(
        "seq",
        F.col("line").alias("msg"),
        F.array("event_type", "line").alias("args"),
        F.create_map(F.lit("uri"), F.col("line")).alias("kwargs"),
    )
