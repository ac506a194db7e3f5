"""Pages of the catalogue from an order-statistics index that a load keeps.

The index of a catalogue version lists its tags in descending order, for the whole catalogue and for every whole or partial version, cut into ranges of about
RANGE_ROWS tags, and says of each range how many tags come before it. A page reads the ranges that it lies in, however deep it is. Indexes are built from
a committed version and stay as they are, so pages that are read one after another fit together while loads go on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetframe.operators.catalog import page_of
from fleetframe.sources.catalog import read_catalog
from fleetframe.sources.commits import CommitLog

FOLDER = "_pages"
RANGE_ROWS = 10_000


def _scopes() -> F.Column:
    """The whole catalogue, and each partial version that a tag belongs to."""
    scope, scopes = F.lit(""), [F.lit("")]
    for part in ("major", "minor", "patch"):
        scope = F.concat(scope, F.lit("" if part == "major" else "."), F.col(part).cast("string"))
        scopes.append(scope)
    return F.array_compact(F.array(*scopes))


def write_index(docs: DataFrame, path: str, range_rows: int = RANGE_ROWS) -> None:
    """Index tag documents (``tag``, unique; ``major, minor, patch``). Complete when its ``ranges`` are."""
    spark = docs.sparkSession
    rows = docs.where("tag is not null").select(F.explode(_scopes()).alias("scope"), "tag")
    # Only the columns of the scopes are counted; the number of ranges follows the number of rows.
    ranges = max(1, -(-rows.count() // range_rows))
    listed = rows.repartitionByRange(ranges, "scope", F.desc("tag")).sortWithinPartitions("scope", F.desc("tag"))
    listed.withColumn("range", F.spark_partition_id()).write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    each = _rows(spark, path).groupBy("scope", "range").agg(F.count(F.lit(1)).alias("rows"), F.min("tag").alias("last_tag"))
    # One row per range and scope.
    ahead = Window.partitionBy("scope").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("start", F.coalesce(F.sum("rows").over(ahead), F.lit(0)))
    each.repartitionByRange(1, "scope", "range").sortWithinPartitions("scope", "range").write.mode("overwrite").parquet(f"{path}/ranges")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("scope string, tag string, range int").parquet(f"{path}/rows")


def indexed_page(
    spark: SparkSession,
    path: str,
    page: int = 1,
    page_size: int = 40,
    version: str | None = None,
    after: str | None = None,
    compat_drop_last: bool = False,
) -> DataFrame:
    """One page of indexed tags in descending order, ``place, tag, has_more`` as ``tag_page`` gives it, optionally of a whole or partial version."""
    scope = (version or "").strip()
    if scope and not re.fullmatch(r"[0-9]+(\.[0-9]+){0,2}", scope):
        raise ValueError(f"not a whole or partial version: {version}")
    scope = ".".join(str(int(part)) for part in scope.split(".")) if scope else ""
    ranges = spark.read.schema("scope string, range int, rows long, last_tag string, start long").parquet(f"{path}/ranges").where(F.col("scope") == scope)
    first = (page - 1) * page_size
    if after is None:
        ranges = ranges.where((F.col("start") <= first + page_size) & (F.col("start") + F.col("rows") > first))
    else:
        ranges = ranges.where(F.col("last_tag") < after)
    # A range has a row at least, so these hold a page and one tag more.
    own = ranges.orderBy("range").limit(page_size + 2).collect()
    rows = _rows(spark, path).where(F.col("range").isin([r["range"] for r in own[: _needed(own, page_size, after)]])).where(F.col("scope") == scope)
    if after is not None:
        seen = rows.where(F.col("tag") < after).orderBy(F.desc("tag")).limit(page_size + 1)
    else:
        skipped = first - own[0]["start"] if own else 0
        seen = rows.orderBy(F.desc("tag")).limit(skipped + page_size + 1)
        # What lies before the page in its first range; fewer rows than a range has.
        seen = seen.orderBy(F.desc("tag")).offset(skipped)
    return page_of(seen, page_size, compat_drop_last)


def _needed(own: list, page_size: int, after: str | None) -> int:
    """How many of the ranges below ``after`` surely hold a page and one tag more: the first of them may have a single one."""
    if after is None:
        return len(own)
    held = 1
    for n, r in enumerate(own[1:], 2):
        if held > page_size:
            return n - 1
        held += r["rows"]
    return len(own)


def _indexes(log: CommitLog) -> list[int]:
    """Versions whose index is complete, rising."""
    at = log.path(FOLDER)
    return sorted(int(n[8:]) for n in log.names(at, "version=") if "_SUCCESS" in log.names(log.path(FOLDER, n, "ranges")))


def index_catalog(spark: SparkSession, root: str, range_rows: int = RANGE_ROWS) -> int:
    """Index the latest version of the catalogue at ``root``, unless that is done; returns the version."""
    log = CommitLog(spark, root)
    version = log.read().version
    if version not in _indexes(log):
        write_index(read_catalog(spark, root, version or None), f"{root}/{FOLDER}/version={version}", range_rows)
    return version


def list_indexed_tags(spark: SparkSession, root: str, page: int = 1, page_size: int = 40, version: str | None = None, **options) -> DataFrame:
    """A page of the catalogue at ``root`` as of its newest index."""
    indexed = _indexes(CommitLog(spark, root))
    if not indexed:
        raise ValueError(f"{root} has no page index: see index_catalog")
    return indexed_page(spark, f"{root}/{FOLDER}/version={indexed[-1]}", page, page_size, version, **options)


def drop_old_indexes(spark: SparkSession, root: str) -> list[int]:
    """Delete all indexes but the newest complete one; nobody should be paging through an older one."""
    log = CommitLog(spark, root)
    kept = _indexes(log)[-1:]
    gone = [int(n[8:]) for n in log.names(log.path(FOLDER), "version=") if int(n[8:]) not in kept and int(n[8:]) < max(kept, default=0)]
    for version in gone:
        log.discard(f"{FOLDER}/version={version}")
    return gone
