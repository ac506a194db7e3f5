"""Session builder and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: list[str] = []


def build(app: str = "fleetframe", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on. Every operator also works on a session it did not build."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Small results still use all cores; large ones are cut by the advisory size anyway.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without one gets a fresh folder under /tmp; a cluster session without one is an error, because a
    machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not _one_machine(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fleetframe-", dir="/tmp")
        sc.setCheckpointDir(folder)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder, until ``release``."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _scratch.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete all scratch paths of this process, for callers that have consumed their results."""
    while _scratch:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that a lost executor cannot change its rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, **values) -> Iterator[None]:
    """Session settings that hold inside only; ``__`` stands for a dot."""
    names = {name.replace("__", "."): str(value) for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def listing(spark: SparkSession):
    """Paths are listed by a few tasks for each core: by default each of up to 10,000 paths is a task of its own."""
    return settings(spark, spark__sql__sources__parallelPartitionDiscovery__parallelism=4 * spark.sparkContext.defaultParallelism)


def setting(spark: SparkSession, name: str, default: int) -> int:
    """A whole-number setting ``spark.fleetframe.<name>`` of the session."""
    return int(spark.conf.get(f"spark.fleetframe.{name}", str(default)))
