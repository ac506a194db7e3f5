"""Filters and rewrites of whole rows by their text, in one pass that carries every column once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ship


def _packed(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _text(rows: pa.StructArray) -> pa.Array:
    text = rows.field("text")
    return text if pa.types.is_string(text.type) else text.cast(pa.string())


def keep_rows(docs: DataFrame, keeps: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of docs whose text `keeps` is true for, with all their columns."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keeps(_text(batch.column("row")))))
            pa.default_memory_pool().release_unused()

    packed = _packed(docs)
    return packed.mapInArrow(of_batches, packed.schema).select("row.*")


def rewrite_text(docs: DataFrame, rewritten: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """docs with its text column rewritten; all other columns stay."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            columns = [rewritten(_text(rows)) if f.name == "text" else rows.field(f.name) for f in rows.type]
            fields = [pa.field("text", pa.string()) if f.name == "text" else f for f in rows.type]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=fields)], names=["row"])
            pa.default_memory_pool().release_unused()

    packed = _packed(docs.withColumn("text", F.col("text").cast("string")))
    return packed.mapInArrow(of_batches, packed.schema).select("row.*")
