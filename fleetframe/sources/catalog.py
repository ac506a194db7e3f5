"""Release catalogue sources and sinks: landed tag pages, release archives, the tag table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.session import listing
from fleetframe.sources.commits import CommitLog, Conflict, Snapshot
from fleetframe.sources.verify import content_digest, digest_of, observed

PAGE_SCHEMA = "results array<struct<name string>>, next string"

_RELEASES = (
    "array<struct<version string, platform array<struct<arch string, package_format string,"
    " packages struct<links array<struct<name string, download_link string>>>>>>>"
)
ARCHIVE_SCHEMA = f"currentReleases {_RELEASES}, oldReleases {_RELEASES}"

TAG_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("tag", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("fragments", T.ArrayType(T.StringType())),
    T.StructField("release_candidate", T.BooleanType()),
    T.StructField("major", T.IntegerType()),
    T.StructField("minor", T.IntegerType()),
    T.StructField("patch", T.IntegerType()),
    T.StructField("parse_error", T.BooleanType()),
    T.StructField("imported_at", T.TimestampType()),
])


def page_names(pages: DataFrame) -> DataFrame:
    """Tag names of tag pages (batch or stream), one row each as ``tag``."""
    return pages.select(F.explode("results.name").alias("tag"))


def page_documents(files: DataFrame) -> DataFrame:
    """The tag pages in whole files (``path``, ``value``), batch or stream: ``path, part, value, results, reason``.

    A file holds one JSON document, indented or not, or one per line. ``part`` numbers a file's documents from 1. A document that is no JSON, has no list of
    results or a result without a name has a ``reason`` and no results; so has a file without any text. A byte order mark is passed over.
    """
    text = F.regexp_replace(F.coalesce("value", F.lit("")), "^\ufeff", "")
    parsed = lambda x: F.try_parse_json(x).isNotNull()
    # A file whose lines all are documents holds one per line; any other is one document.
    by_line = F.filter(F.split(text, "\r?\n"), lambda x: x.rlike(r"\S"))
    documents = F.when((F.size(by_line) > 0) & F.forall(by_line, parsed), by_line).otherwise(F.array(text))
    rows = files.select("path", F.posexplode(documents).alias("at", "value"))
    results = F.from_json("value", PAGE_SCHEMA)["results"]
    rows = rows.withColumn("read", F.when(parsed(F.col("value")), results))
    reason = (
        F.when(~F.col("value").rlike(r"\S"), "empty")
        .when(~parsed(F.col("value")), "not JSON")
        .when(F.col("read").isNull(), "no list of results")
        .when(F.exists("read", lambda r: r["name"].isNull()), "a result without a name")
    )
    rows = rows.select("path", (F.col("at") + 1).alias("part"), "value", "read", reason.alias("reason"))
    return rows.select("path", "part", "value", F.when(F.col("reason").isNull(), F.col("read")).alias("results"), "reason")


def _checked(documents: DataFrame) -> DataFrame:
    """Tag names of page documents; a broken one ends the run. Files without any text are passed over."""
    told = F.concat(F.lit("not a tag page: "), F.col("reason"), F.lit(" in "), F.col("path"), F.lit(": "), F.substring("value", 1, 100))
    results = F.when(F.col("reason").isNull(), F.col("results")).otherwise(F.raise_error(told).cast("array<struct<name:string>>"))
    return page_names(documents.where("reason is null or reason <> 'empty'").select(results.alias("results")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Tag names of all pages landed under ``path`` as JSON files, one document per file, indented or not, or one per line.

    A file is read whole (pages are small). One that is not such JSON is an error, not an empty page.
    """
    files = spark.read.text(path, wholetext=True)
    return _checked(page_documents(files.select(F.col("_metadata.file_path").alias("path"), "value")))


def stream_page_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Whole page files as they arrive: ``path, value``."""
    reader = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch)
    with listing(spark):
        return reader.load(path).select(F.col("_metadata.file_path").alias("path"), "value")


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Tag names of page files as they arrive, the same as ``read_pages``: a broken file ends the stream."""
    return _checked(page_documents(stream_page_files(spark, path, files_per_batch)))


def quarantine(broken: DataFrame, root: str, writer: str, batch: int) -> None:
    """Keep broken page documents (``path, part, reason, value``) of a batch; a batch that is run again writes the same place."""
    broken.select("path", "part", "reason", "value").write.mode("overwrite").parquet(f"{root}/{_quarantined(writer, batch)}")


def _quarantined(writer: str, batch: int) -> str:
    return f"writer={quote(writer, safe='')}/batch={batch}"


def in_quarantine(spark: SparkSession, root: str, writer: str, batch: int) -> bool:
    """Whether the quarantine holds a folder of the batch."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, _quarantined(writer, batch))
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def begin_quarantine(spark: SparkSession, root: str) -> None:
    """Make the quarantine's root, which can be read from then on."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    """Broken page documents of all batches: ``path, part, reason, value, writer, batch``."""
    with listing(spark):
        return spark.read.schema("path string, part int, reason string, value string, writer string, batch long").parquet(root)


def read_archive(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Release archives: one row per JSON document."""
    return spark.read.schema(ARCHIVE_SCHEMA).option("multiLine", multi_line).json(path)


def append_batch(
    docs: DataFrame, root: str, writer: str, batch: int, once: bool = False, before: Callable[[], None] | None = None
) -> Snapshot:
    """Commit tag documents as batch number ``batch`` of ``writer`` to the table at ``root``; returns the new version.

    Every writer (a stream's id, a load's name) has folders of its own, so batch numbers of two writers never meet. A batch that is run again takes
    the place of its earlier run, so repeats change nothing. With ``once`` it is passed over instead if the writer has committed it or a later one, also
    if a compaction has taken it in since. Documents need ``imported_at``; those without get the time of this call. ``before`` is called when the documents
    are written and not yet committed.
    """
    log = CommitLog(docs.sparkSession, root)
    place = f"writer={quote(writer, safe='')}/batch={batch}"
    own = lambda name: name == place or name.startswith(place + "/")
    latest = log.read()
    if once and latest.applied.get(writer, -1) >= batch:
        return latest
    folder = _write(log, docs, place)
    if before:
        before()

    def change(latest: Snapshot) -> tuple[str, ...]:
        return (*(f for f in latest.folders if not own(f)), folder)

    return log.commit(change, writer, batch, operation="append")


def _write(log: CommitLog, docs: DataFrame, place: str) -> str:
    stamped = docs.selectExpr(*[f"`{c}`" if c != "imported_at" else "coalesce(imported_at, current_timestamp()) AS imported_at" for c in TAG_SCHEMA.names])
    folder = f"{place}/write={uuid.uuid4().hex}"
    # The manifest says which folders are whole; they need no marker of their own.
    stamped.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(log.folder(folder))
    return folder


def _stored(spark: SparkSession, log: CommitLog, snapshot: Snapshot) -> DataFrame:
    keys = [T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())]
    schema = T.StructType([*TAG_SCHEMA.fields, *keys])
    reads = []
    # Folders from before there was a log lie one level higher; one read takes folders of one depth.
    for deep in (True, False):
        folders = [log.folder(f) for f in snapshot.folders if ("/write=" in f) == deep]
        if folders:
            with listing(spark):
                reads.append(spark.read.schema(schema).option("basePath", log.root.toString()).parquet(*folders).select(*schema.names))
    return reduce(DataFrame.union, reads) if reads else spark.createDataFrame([], schema)


def _current(stored: DataFrame) -> DataFrame:
    return latest_by_key(stored, "tag", F.struct("imported_at", "batch", "seq", "writer")).drop("writer", "batch")


def read_catalog(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Tag documents of a version of the catalogue, by default the latest: of all batches of all writers the document imported last per tag.

    Documents imported at the same time are ordered by batch number, place and writer. The result stays on its version, whatever is committed or
    compacted meanwhile, until ``vacuum`` drops it. Batches are only added; the upsert is resolved here, with map-side combining, so a load never
    rewrites the table. ``compact`` shortens what has to be read.
    """
    log = CommitLog(spark, root)
    return _current(_stored(spark, log, log.read(version)))


COMPACTED = "compacted"


def compact(spark: SparkSession, root: str) -> Snapshot:
    """Commit a version that holds the current documents in one folder in place of all batches that the latest version has; returns the new latest version.

    Batches committed meanwhile stay, and as import times are kept, they still win. Of compactions that run at the same time one is committed; the
    others drop what they wrote. Nothing that an earlier version names is deleted: see ``vacuum``.
    """
    log = CommitLog(spark, root)
    seen = log.read()
    if not seen.folders:
        return seen
    folder = _write(log, _current(_stored(spark, log, seen)), f"writer={COMPACTED}/batch={seen.version}")

    def change(latest: Snapshot) -> tuple[str, ...]:
        if not set(seen.folders) <= set(latest.folders):
            raise Conflict(f"{root}: what version {seen.version} holds was replaced in version {latest.version}")
        return (folder, *(f for f in latest.folders if f not in seen.folders))

    try:
        return log.commit(change, operation="compact", of=seen.version)
    except Conflict:
        log.discard(folder)
        return log.read()


def vacuum(spark: SparkSession, root: str, keep_versions: int = 10, keep_seconds: float = 86_400) -> list[str]:
    """Delete old versions and folders that no kept version names; see ``CommitLog.vacuum``."""
    return CommitLog(spark, root).vacuum(keep_versions, keep_seconds)


def latest_by_key(df: DataFrame, key: str, order) -> DataFrame:
    """The row with the greatest ``order`` of each key."""
    last = F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("last")
    picked = df.groupBy(key).agg(last)
    return picked.select(*[key if c == key else F.col("last")[c].alias(c) for c in df.columns])


def upsert(target: DataFrame, source: DataFrame, key: str = "tag", order: str = "seq") -> DataFrame:
    """``target`` with the rows of ``source`` put in: same key replaced, new key added.

    ``target`` has unique keys; of several source rows per key the last counts. Both sides are united and the best row per key is taken, so the
    source is read and shuffled once and rows of a hot key are combined before the shuffle.
    """
    rank = lambda df, n: df.select(*target.columns, F.struct(F.lit(n).alias("side"), F.col(order).cast("long").alias("at")).alias("__rank"))
    best = latest_by_key(rank(target, 0).unionByName(rank(source, 1)), key, F.col("__rank"))
    return best.select(*target.columns)


def write_verified(df: DataFrame, path: str) -> int:
    """Write Parquet and check that the rows that can be read back are those that were sent, in any order; returns their number.

    Number and digest of the rows sent are taken by the write job itself, so the input is computed once; the landed rows are read back whole. A lost,
    doubled or changed row is an error. Files are left in place for a look at them; ``differing`` tells in which groups two tables differ.
    """
    watched, seen = observed(df)
    watched.write.mode("overwrite").parquet(path)
    sent, landed = digest_of(seen), content_digest(df.sparkSession.read.schema(df.schema).parquet(path))
    if landed.rows != sent.rows:
        raise RuntimeError(f"{path}: {sent.rows} rows sent, {landed.rows} landed")
    if landed != sent:
        raise RuntimeError(f"{path}: {sent.rows} rows sent and landed, but not the same")
    return landed.rows
