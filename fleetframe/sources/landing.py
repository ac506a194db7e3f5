"""Landed nodes laid out by group, so that work by group needs no shuffle.

A landing is a committed version of the inventory in two parts. Usual groups lie in buckets by group, sorted, one file to a bucket: a roll-up or a window by group
reads its bucket and is done. Groups above the row limit (``spark.fleetframe.hotRows``) would fill a task each; their rows lie in plain files, sorted over
all of them, next to the list of these groups, which is found once, at landing. Queries take the list from there instead of counting their input.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.operators.skew import HotKeys, hot_keys
from fleetframe.session import scratch_path, settings
from fleetframe.sources.commits import CommitLog
from fleetframe.sources.nodes import typed_nodes

WRITER = "landing"
#: Rows of a bucket, about; rows dealt into buckets in one step, at least; the most slices that rows are staged in; bytes that the writer of a slice holds.
BUCKET_ROWS, SLICE_ROWS, SLICES, SLICE_BLOCK = 250_000, 1_000_000, 8, 16 << 20

_SLICE = "__slice"


@dataclass
class Landing:
    """One version of landed nodes: ``usual`` in buckets, ``large`` in plain files, and the groups of the latter."""

    version: int
    usual: DataFrame
    large: DataFrame
    hot: HotKeys

    def nodes(self, **options) -> DataFrame:
        """All typed nodes, for work that is not by group."""
        return typed_nodes(self.usual.unionByName(self.large), **options)

    def by_group(self, work: Callable[[DataFrame, HotKeys], DataFrame], **options) -> DataFrame:
        """``work`` of (typed nodes, their hot groups), whose result for a group follows from that group's rows, on both parts."""
        usual = work(typed_nodes(self.usual, **options), HotKeys(["grp"], None))
        return usual.unionByName(work(typed_nodes(self.large, **options), self.hot)) if self.hot else usual


def _table(spark: SparkSession, path: str) -> str:
    return f"landed_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"


def land_nodes(landed: DataFrame, root: str, buckets: int | None = None, hot_rows: int | None = None) -> Landing:
    """Commit landed nodes as the next version of the inventory at ``root`` and open it.

    Rows without a group lie with the usual ones. ``buckets`` (default: the number of shuffle partitions) is the least number of buckets; there are as many
    times more as it takes for them to hold about ``BUCKET_ROWS`` rows, which a task sorts in memory, at landing and in the work by group. ``hot_rows``
    replaces the setting. With more hot groups than may be broadcast all rows go to plain files.

    Besides the landing the disk holds its rows once more, and what one step shuffles: rows are staged in slices, a step deals a few of them into their
    buckets, and a slice that is dealt is deleted, as are the shuffle files of jobs that have ended.
    """
    spark = landed.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged, log = scratch_path(spark, "landing"), CommitLog(spark, root)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        try:
            return _land(landed, log, staged, buckets, hot_rows)
        finally:
            log.delete(staged)


def _land(landed: DataFrame, log: CommitLog, staged: str, least: int, hot_rows: int | None) -> Landing:
    spark = landed.sparkSession
    # Records are spread out once; counting and dealing read plain columns. The rows of a bucket lie in one slice, whatever multiple of the least number
    # of buckets there is. A writer for each slice spares the sort by slice.
    slices = min(SLICES, least)
    with settings(spark, spark__sql__maxConcurrentOutputFileWriters=slices + 1):
        dealt = landed.withColumn(_SLICE, F.pmod(F.hash("grp"), F.lit(least)) % slices)
        dealt.write.partitionBy(_SLICE).option("compression", "zstd").option("parquet.block.size", SLICE_BLOCK).parquet(staged)
    read = lambda *paths: spark.read.schema(landed.schema).option("recursiveFileLookup", "true").parquet(*paths)
    rows = read(staged)
    grouped = rows.where(F.col("grp").isNotNull())
    hot = hot_keys(grouped, ["grp"], hot_rows)
    n = rows.count()
    buckets = least * max(math.ceil(n / (least * BUCKET_ROWS)), 1)
    folder = f"writer={WRITER}/batch={log.read().version}/write={uuid.uuid4().hex}"
    large = grouped if hot.many else hot.only(grouped) if hot else rows.limit(0)
    large.repartitionByRange("grp", "seq").sortWithinPartitions("grp", "seq").write.option("compression", "zstd").parquet(log.folder(f"{folder}/large"))
    path = log.folder(f"{folder}/usual")
    parts = [f"{staged}/{name}" for name in log.names(log.at(staged), f"{_SLICE}=")]
    steps = min(max(math.ceil(n / SLICE_ROWS), 1), max(len(parts), 1))
    for step in range(steps):
        mine = parts[step::steps]
        rows = read(*(mine or [staged]))
        usual = rows.where(F.col("grp").isNull()) if hot.many else hot.without(rows) if hot else rows
        writer = usual.repartition(buckets, "grp").write.mode("append").bucketBy(buckets, "grp").sortBy("grp", "seq")
        writer.option("path", path).option("compression", "zstd").saveAsTable(_table(spark, path))
        for part in mine:
            log.delete(part)
    groups = [list(r) for r in hot.rows.collect()] if hot.rows is not None else []
    snapshot = log.commit(lambda _: (folder,), operation="land", buckets=buckets, groups=groups, many=hot.many, schema=landed.schema.json())
    return _open(spark, log, snapshot.version)


def open_landing(spark: SparkSession, root: str, version: int | None = None) -> Landing:
    """A version of the inventory at ``root``, by default the latest."""
    log = CommitLog(spark, root)
    latest = log.read(version)
    if not latest.folders:
        raise ValueError(f"nothing is landed at {root}")
    return _open(spark, log, latest.version)


def _open(spark: SparkSession, log: CommitLog, version: int) -> Landing:
    snapshot = log.read(version)
    note, folder = snapshot.note, snapshot.folders[0]
    schema = T.StructType.fromJson(json.loads(note["schema"]))
    path = log.folder(f"{folder}/usual")
    name = _table(spark, path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (grp) SORTED BY (grp, seq) INTO {note['buckets']} BUCKETS LOCATION '{path}'")
    rows = spark.createDataFrame(note["groups"], "__other_grp string") if note["groups"] else None
    hot = HotKeys(["grp"], rows, len(note["groups"]), note["many"])
    return Landing(version, spark.table(name), spark.read.schema(schema).parquet(log.folder(f"{folder}/large")), hot)
