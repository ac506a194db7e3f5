"""Streaming jobs: log masking and catalogue refresh. Both are stateless and restart from their checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetframe.functions import mask_credentials, mask_list, mask_map
from fleetframe.operators.catalog import name_filter, tag_documents
from fleetframe.sources.catalog import append_batch, begin_quarantine, in_quarantine, page_documents, quarantine


def mask_records(records: DataFrame, strict: bool = False) -> DataFrame:
    """Log records (``msg``, optionally ``args`` list and ``kwargs`` map) with every connection string masked.

    Works on a batch or a stream; every argument is masked, whatever the others are.
    """
    masked = records.withColumn("msg", mask_credentials(F.col("msg"), strict))
    if "args" in records.columns:
        masked = masked.withColumn("args", mask_list(F.col("args"), strict))
    if "kwargs" in records.columns:
        masked = masked.withColumn("kwargs", mask_map(F.col("kwargs"), strict))
    return masked


def start_masking(
    records: DataFrame, path: str, checkpoint: str, strict: bool = False, once: bool = False
) -> StreamingQuery:
    """Write the masked stream to Parquet files; ``once`` stops when all input there is has been read."""
    writer = (
        mask_records(records, strict)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def _writer(batch: DataFrame) -> str:
    """The stream's own id, which its checkpoint keeps."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def _add(names: DataFrame, root: str, number: int, writer: str, must_include: str | None, must_exclude: str | None) -> None:
    kept = name_filter(names, must_include, must_exclude)
    if "seq" not in kept.columns:
        kept = kept.withColumn("seq", F.lit(0).cast("long"))
    append_batch(tag_documents(kept), root, writer, number, once=True)


def start_catalog_refresh(
    names: DataFrame,
    root: str,
    checkpoint: str,
    must_include: str | None = None,
    must_exclude: str | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Enrich streamed tag names and add each batch to the catalogue at ``root``.

    The stream's own id and the batch number name what is committed: a batch that is run again after a failure is passed over if it was committed, and
    another stream's batches never meet it.
    """

    def add(batch: DataFrame, number: int) -> None:
        _add(batch, root, number, _writer(batch), must_include, must_exclude)

    writer = names.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_page_refresh(
    files: DataFrame,
    root: str,
    broken: str,
    checkpoint: str,
    must_include: str | None = None,
    must_exclude: str | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Add the tags of streamed page files (``stream_page_files``) to the catalogue at ``root``; broken documents go to the table ``broken`` by path.

    Every document of a batch goes to one of the two, so none is lost. Broken ones are written first: when the catalogue has a batch, its quarantine
    is complete. A batch that is run again writes the same places. A broken document does not keep others of its file, or other files, from being read.

    Batches may be small and many, so what does not change is done once: documents are parsed in the stream's own plan, and a batch is one job, with a
    second one for broken documents if the first has met any.
    """
    spark = files.sparkSession
    begin_quarantine(spark, broken)
    # A row for every tag that is wanted, and one with a reason for every broken document.
    documents = page_documents(files).withColumn("wrong", F.col("reason").isNotNull())
    entries = F.when(F.col("wrong"), F.array(F.lit(None).cast("string"))).otherwise(F.col("results.name"))
    rows = documents.select("path", "part", F.when(F.col("wrong"), F.col("value")).alias("value"), "reason", "wrong", F.explode(entries).alias("tag"))
    if must_include:
        rows = rows.where(F.col("wrong") | F.col("tag").contains(must_include))
    if must_exclude:
        rows = rows.where(F.col("wrong") | ~F.col("tag").contains(must_exclude))
    rows = tag_documents(rows.withColumn("seq", F.lit(0).cast("long")), "path", "part", "value", "reason", "wrong")
    # The time of a document is that of its commit, not that of the trigger.
    rows = rows.withColumn("imported_at", F.lit(None).cast("timestamp"))

    count = F.count_if("wrong").alias("broken")

    def add(batch: DataFrame, number: int) -> None:
        name, seen = _writer(batch), Observation()

        def hold_back() -> None:
            if seen.get["broken"] or in_quarantine(spark, broken, name, number):
                quarantine(batch.where("wrong"), broken, name, number)

        good = batch.observe(seen, count).where("not wrong")
        append_batch(good, root, name, number, once=True, before=hold_back)

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
