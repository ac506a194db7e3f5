"""Release catalogue operators: tag documents, filters, groups, pages, archive links."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetframe.functions import tag_group, tag_version
from fleetframe.operators.skew import HotKeys, positions


def tag_documents(tags: DataFrame, *also: str) -> DataFrame:
    """Tags (``seq, tag``) with group, fragments, release-candidate flag, version parts, import time and the columns ``also``.

    A version that does not parse gives null parts and ``parse_error``; the row stays.
    """
    tag, version = F.col("tag"), F.col("version")
    return tags.withColumn("version", tag_version(tag)).select(
        "seq",
        "tag",
        tag_group(tag).alias("group"),
        F.split(tag, "-").alias("fragments"),
        tag.contains("-rc").alias("release_candidate"),
        version["major"].alias("major"),
        version["minor"].alias("minor"),
        version["patch"].alias("patch"),
        version["parse_error"].alias("parse_error"),
        F.current_timestamp().alias("imported_at"),
        *also,
    )


def name_filter(tags: DataFrame, must_include: str | None = None, must_exclude: str | None = None) -> DataFrame:
    """Tags that contain one text and lack another; a missing or empty text sets no condition. Case counts."""
    if must_include:
        tags = tags.where(F.col("tag").contains(must_include))
    if must_exclude:
        tags = tags.where(~F.col("tag").contains(must_exclude))
    return tags


def version_filter(docs: DataFrame, version: str | None = None) -> DataFrame:
    """Tag documents of a whole or partial version (``7``, ``7.0`` or ``7.0.6``): each given part has to be equal."""
    if version is None or not version.strip():
        return docs
    if not re.fullmatch(r"[0-9]+(\.[0-9]+){0,2}", version.strip()):
        raise ValueError(f"not a whole or partial version: {version}")
    for part, value in zip(("major", "minor", "patch"), version.strip().split(".")):
        docs = docs.where(F.col(part) == int(value))
    return docs


def grouped_tags(tags: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Tags (``seq, tag``) under their version group, each with its ``place`` in the group's descending order.

    There are few groups and each may be huge, so the list of a group is a set of rows, not one array.
    """
    keyed = tags.withColumn("group", tag_group(F.col("tag")))
    return positions(keyed, ["group"], [F.col("tag").desc(), F.col("seq")], "place", hot=hot)


def group_sizes(tags: DataFrame) -> DataFrame:
    """Number of tags and of distinct tags per version group, and the first and last in order."""
    # Two partial steps: duplicates are combined first, then the few groups.
    distinct = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy(tag_group(F.col("tag")).alias("group")).agg(
        F.sum("n").alias("tags"),
        F.count(F.lit(1)).alias("distinct_tags"),
        F.max("tag").alias("first_tag"),
        F.min("tag").alias("last_tag"),
    )


def newest_first(tags: DataFrame) -> DataFrame:
    """Tags in descending code-point order (so ``7.0.9`` comes before ``7.0.10``)."""
    return tags.orderBy(F.col("tag").desc())


def tag_page(
    tags: DataFrame,
    page: int = 1,
    page_size: int = 40,
    after: str | None = None,
    compat_drop_last: bool = False,
) -> DataFrame:
    """One page of distinct tags in descending order: ``place, tag, has_more``.

    One row more than a page is looked at to tell whether there is a next page. ``after`` continues below the last tag
    seen. A page far into a large catalogue is cheapest from its page index. ``compat_drop_last`` leaves out the last row read even on the last
    page.
    """
    distinct = tags.select("tag").distinct()
    if after is not None:
        distinct, page = distinct.where(F.col("tag") < after), 1
    seen = distinct.orderBy(F.col("tag").desc()).offset((page - 1) * page_size).limit(page_size + 1)
    return page_of(seen, page_size, compat_drop_last)


def page_of(seen: DataFrame, page_size: int, compat_drop_last: bool = False) -> DataFrame:
    """``place, tag, has_more`` of at most ``page_size + 1`` tags, of which the last tells whether there is a next page."""
    whole = Window.partitionBy(F.lit(1))
    numbered = seen.withColumns({
        "place": F.row_number().over(whole.orderBy(F.col("tag").desc())),
        "rows": F.count(F.lit(1)).over(whole),
    })
    last = F.col("rows") - 1 if compat_drop_last else F.lit(page_size)
    return numbered.where(F.col("place") <= last).select("place", "tag", (F.col("rows") > page_size).alias("has_more"))


def archive_links(archives: DataFrame, version: str, arch: str, package_format: str, file_type: str) -> DataFrame:
    """Download links of a nested release archive.

    Current and old releases together; version and package format have to contain the given text, architecture and link
    name to equal it. Each level is filtered before the next is spread out.
    """
    releases = archives.select(
        F.explode(F.concat(
            F.coalesce("currentReleases", F.expr("cast(array() AS " + _type(archives, "currentReleases") + ")")),
            F.coalesce("oldReleases", F.expr("cast(array() AS " + _type(archives, "oldReleases") + ")")),
        )).alias("release")
    ).where(F.col("release.version").contains(version))
    platforms = releases.select("release.version", F.explode("release.platform").alias("platform")).where(
        (F.col("platform.arch") == arch) & F.col("platform.package_format").contains(package_format)
    )
    links = platforms.select(
        "version", "platform.arch", "platform.package_format", F.explode("platform.packages.links").alias("link")
    ).where(F.col("link.name") == file_type)
    return links.select("version", "arch", "package_format", F.col("link.download_link").alias("download_link"))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
