"""Release archives landed as sorted rows, so that a question about one version reads little."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANDED_SCHEMA = "section string, version string, arch string, package_format string, links array<struct<name string, download_link string>>"


def archive_platforms(archives: DataFrame) -> DataFrame:
    """One row per platform of a release, of archives as ``read_archive`` gives them."""
    names = archives.columns
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("releases")) for s in ("currentReleases", "oldReleases") if s in names])
    releases = archives.select(F.inline(sections)).select("section", F.explode("releases").alias("release"))
    platforms = releases.select("section", "release.version", F.explode("release.platform").alias("platform"))
    links = F.transform("platform.packages.links", lambda x: F.struct(x["name"].alias("name"), x["download_link"].alias("download_link")))
    return platforms.select("section", "version", "platform.arch", "platform.package_format", links.alias("links"))


def land_archives(archives: DataFrame, path: str, files: int | None = None) -> None:
    """Write archives once as rows sorted by architecture and version, in place of what was at ``path``.

    The range sort also takes package format and a hash of the links, so that a version which holds most rows is dealt over many files.
    """
    keys = ["arch", "version", "package_format", F.xxhash64("links")]
    dealt = archive_platforms(archives)
    dealt = dealt.repartitionByRange(files, *keys) if files else dealt.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def read_landed_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDED_SCHEMA).parquet(path)


def landed_links(landed: DataFrame, version: str, arch: str, package_format: str, file_type: str) -> DataFrame:
    """Download links, the same rows as ``archive_links`` over the nested documents.

    Filters on architecture, version and package format reach the files: statistics and dictionaries let row groups be passed over.
    """
    kept = landed.where((F.col("arch") == arch) & F.col("version").contains(version) & F.col("package_format").contains(package_format))
    links = kept.select("version", "arch", "package_format", F.explode("links").alias("link")).where(F.col("link.name") == file_type)
    return links.select("version", "arch", "package_format", F.col("link.download_link").alias("download_link"))
