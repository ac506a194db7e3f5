"""Tables written to the shared folder named in spark.checkpoint.dir, and small helpers on the session.

A written table cuts lineage: it outlives a lost executor, and what was written is read back column by column. `release` deletes what this
process has written, for callers that have consumed their results.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a two-column id table that may be broadcast; beyond it the same join is done by shuffle.
BROADCAST_ROWS = 1_000_000

_written: list[str] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application, so that executors need no copy of their own."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = f"{tempfile.mkdtemp(prefix='llm-code-')}/{package.name}"
        context.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
        _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; local sessions without one get a new temporary folder, clusters an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._llm_path = path
    return back


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Jobs begun inside delete their shuffle files when they end, not when the driver next collects its garbage. Each frame is to be run once there."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def drop(df: DataFrame) -> None:
    """Delete a table made by `written` that nothing reads any more."""
    _delete(df.sparkSession, df._llm_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def release(spark: SparkSession) -> None:
    """Delete all tables that this process has written."""
    for path in list(_written):
        _delete(spark, path)


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (distinct); ids travel by broadcast while they are few, by shuffle beyond that."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def anti(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in ids (distinct), as `semi`; null keys stay."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
