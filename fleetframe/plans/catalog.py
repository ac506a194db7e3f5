"""Catalogue load and listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.operators.catalog import name_filter, tag_documents, tag_page, version_filter
from fleetframe.sources.catalog import append_batch, read_catalog, read_pages
from fleetframe.sources.page_index import index_catalog


def load_tags(
    spark: SparkSession,
    pages: str,
    root: str,
    batch: int,
    writer: str = "load",
    must_include: str | None = None,
    must_exclude: str | None = None,
    index: bool = False,
) -> DataFrame:
    """Read landed pages, enrich the tags and add them to the catalogue at ``root`` as ``batch`` of ``writer``; returns the current catalogue.

    ``index`` keeps the page index up to date, for ``list_indexed_tags``.
    """
    names = name_filter(read_pages(spark, pages), must_include, must_exclude).withColumn("seq", F.lit(0).cast("long"))
    append_batch(tag_documents(names), root, writer, batch)
    if index:
        index_catalog(spark, root)
    return read_catalog(spark, root)


def list_tags(docs: DataFrame, page: int = 1, page_size: int = 40, version: str | None = None, **options) -> DataFrame:
    """One page of the catalogue, optionally of a whole or partial version."""
    return tag_page(version_filter(docs, version), page, page_size, **options)
