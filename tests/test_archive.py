"""Landed archives give the links of the nested documents and are read in part."""

import itertools

import pytest

from fleetframe.operators import catalog
from fleetframe.sources import archive
from fleetframe.sources.catalog import ARCHIVE_SCHEMA
from tests.conftest import rows

COLUMNS = ["version", "arch", "package_format", "download_link"]


def document(*versions, old=None):
    def release(version):
        links = lambda a: ([{"name": n, "download_link": f"{version}/{a}/{n}"} for n in ("deb", "tar.gz", None)],)
        return (version, [(a, f, links(a)) for a in ("arm64", "x86_64", None) for f in ("rpm-8", None)] + [("x86_64", "rpm", None), None])

    return ([release(x) for x in versions], None if old is None else [release(x) for x in old])


@pytest.fixture(scope="module")
def archives(spark):
    documents = [document(*[f"{a}.0.{b}" for b in range(20)], old=[f"{a}.1.0", None, "6.0.1"]) for a in range(3, 9)]
    return spark.createDataFrame([*documents, (None, None), ([None], []), document("6.0.1"), document("6.0.1")], ARCHIVE_SCHEMA)


def test_same_links(spark, archives, tmp_path):
    archive.land_archives(archives, str(tmp_path / "landed"), files=6)
    landed = archive.read_landed_archives(spark, str(tmp_path / "landed"))
    seen = 0
    for version, arch, form, name in itertools.product(("6.0.1", "3.", "9"), ("x86_64", "none"), ("rpm", "8"), ("deb", "zip")):
        want = rows(catalog.archive_links(archives, version, arch, form, name), *COLUMNS)
        assert rows(archive.landed_links(landed, version, arch, form, name), *COLUMNS) == want
        seen += len(want)
    assert seen > 100


def test_files_are_passed_over(spark, archives, tmp_path):
    archive.land_archives(archives, str(tmp_path / "landed"), files=20)
    landed = archive.read_landed_archives(spark, str(tmp_path / "landed"))
    every = landed.count()
    asked = archive.landed_links(landed, "6.0.1", "x86_64", "rpm", "deb")
    execution = asked._jdf.queryExecution()
    plan = execution.executedPlan().toString()
    assert "EqualTo(arch,x86_64)" in plan and "Exchange" not in plan and "section" not in plan
    leaf = execution.executedPlan().collectLeaves().head()
    execution.toRdd().count()
    assert 0 < leaf.metrics().apply("numOutputRows").value() < every / 3


def test_empty_and_one_section(spark, tmp_path):
    archive.land_archives(spark.createDataFrame([], ARCHIVE_SCHEMA), str(tmp_path / "none"))
    assert archive.landed_links(archive.read_landed_archives(spark, str(tmp_path / "none")), "", "x86_64", "", "deb").count() == 0
    one = spark.createDataFrame([document("6.0.1")], ARCHIVE_SCHEMA).select("currentReleases")
    assert archive.archive_platforms(one).count() == 8
