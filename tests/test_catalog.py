import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetframe import list_tags, load_tags
from fleetframe.operators import catalog, layout, properties
from fleetframe.sources import catalog as store


def tags_of(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "seq long, tag string")


def write_pages(folder, pages):
    folder.mkdir(exist_ok=True)
    for i, names in enumerate(pages):
        body = {"results": [{"name": n, "size": 1} for n in names], "next": "more" if i + 1 < len(pages) else None}
        (folder / f"page-{i}.json").write_text(json.dumps(body))


def test_pages_and_filters(spark, tmp_path):
    write_pages(tmp_path / "pages", [["7.0", "7.0-rc1"], ["latest", "8.0"], []])
    tags = store.read_pages(spark, str(tmp_path / "pages"))
    assert rows(tags, "tag") == [("7.0",), ("7.0-rc1",), ("8.0",), ("latest",)]
    assert rows(catalog.name_filter(tags, "0", "-rc"), "tag") == [("7.0",), ("8.0",)]
    assert catalog.name_filter(tags, "", "").count() == 4
    assert rows(catalog.name_filter(tags, "LATEST"), "tag") == []


@pytest.mark.parametrize("count, page, size, shown, more", [
    (42, 1, 40, 40, True), (42, 2, 40, 2, False), (23, 1, 40, 23, False), (40, 1, 40, 40, False), (41, 1, 40, 40, True),
    (0, 1, 40, 0, None), (5, 3, 2, 1, False),
])
def test_pages_of_tags(spark, count, page, size, shown, more):
    tags = tags_of(spark, [f"t{i:03d}" for i in range(count)] * 2)
    got = catalog.tag_page(tags, page, size).collect()
    assert len(got) == shown and {r.has_more for r in got} == ({more} if shown else set())
    expected = sorted((f"t{i:03d}" for i in range(count)), reverse=True)[(page - 1) * size:][:shown]
    assert [r.tag for r in sorted(got, key=lambda r: r.place)] == expected


def test_page_options(spark):
    tags = tags_of(spark, [f"t{i}" for i in range(5)])
    assert rows(catalog.tag_page(tags, 1, 40, compat_drop_last=True), "tag") == [("t1",), ("t2",), ("t3",), ("t4",)]
    assert rows(catalog.tag_page(tags, 1, 4, compat_drop_last=True), "tag") == [("t1",), ("t2",), ("t3",), ("t4",)]
    assert rows(catalog.tag_page(tags, page_size=2, after="t2"), "tag", "has_more") == [("t0", False), ("t1", False)]


def test_order_is_by_code_point(spark):
    tags = tags_of(spark, ["7.0.9", "7.0.10", "latest", "￿", "\U0001f600"])
    assert [r.tag for r in catalog.newest_first(tags).collect()] == ["\U0001f600", "￿", "latest", "7.0.9", "7.0.10"]


def test_groups(spark):
    tags = tags_of(spark, ["7.0.9", "7.0.10", "7", "latest", "7.0", "nano"])
    assert rows(catalog.grouped_tags(tags), "group", "place", "tag") == [
        ("7", 1, "7"), ("7.0", 1, "7.0.9"), ("7.0", 2, "7.0.10"), ("7.0", 3, "7.0"), ("others", 1, "nano"),
        ("others", 2, "latest"),
    ]
    assert rows(catalog.group_sizes(tags), "group", "tags") == [("7", 1), ("7.0", 3), ("others", 2)]


def test_version_filter(spark):
    docs = catalog.tag_documents(tags_of(spark, ["7.0.6", "7.0", "7", "8.0.6", "latest"]))
    pick = lambda v: rows(catalog.version_filter(docs, v), "tag")
    assert pick("7") == [("7",), ("7.0",), ("7.0.6",)]
    assert pick("7.0") == [("7.0",), ("7.0.6",)]
    assert pick("7.0.6") == [("7.0.6",)]
    assert len(pick(None)) == len(pick(" ")) == 5
    with pytest.raises(ValueError):
        catalog.version_filter(docs, "seven")
    assert rows(list_tags(docs, page_size=1, version="7.0"), "tag", "has_more") == [("7.0.6", True)]


def test_upsert(spark):
    target = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "tag string, seq long, v string")
    source = spark.createDataFrame([("b", 3, "x"), ("b", 4, "y"), ("c", 5, "z")], "tag string, seq long, v string")
    once = store.upsert(target, source)
    expected = [("a", 1, "old"), ("b", 4, "y"), ("c", 5, "z")]
    assert rows(once, "tag", "seq", "v") == expected
    assert rows(store.upsert(once, source), "tag", "seq", "v") == expected


def test_load_is_repeatable(spark, tmp_path):
    root, pages = str(tmp_path / "table"), tmp_path / "pages"
    write_pages(pages, [["7.0", "latest"], ["7.0"]])
    first = rows(load_tags(spark, str(pages), root, 0), "tag", "group", "major")
    assert first == [("7.0", "7.0", 7), ("latest", "others", None)]
    assert rows(load_tags(spark, str(pages), root, 0), "tag", "group", "major") == first
    write_pages(pages, [["7.0-rc1"]])
    later = load_tags(spark, str(pages), root, 1)
    assert rows(later, "tag", "release_candidate") == [("7.0", False), ("7.0-rc1", True), ("latest", False)]


def test_archive_file(spark, tmp_path):
    link = lambda n: {"name": n, "download_link": f"https://x/{n}"}
    def release(version, arch="x86_64", fmt="deb"):
        return {"version": version, "platform": [
            {"arch": arch, "package_format": fmt, "packages": {"links": [link("tar.gz"), link("deb")]}}
        ]}
    body = {"currentReleases": [release("6.0.10"), release("6.0.1", "arm64")], "oldReleases": [release("16.0.1", fmt="deb8")]}
    path = tmp_path / "archive.json"
    path.write_text(json.dumps(body, indent=1))
    found = catalog.archive_links(store.read_archive(spark, str(path), multi_line=True), "6.0.1", "x86_64", "deb", "tar.gz")
    assert rows(found, "version", "package_format", "download_link") == [
        ("16.0.1", "deb8", "https://x/tar.gz"), ("6.0.10", "deb", "https://x/tar.gz")
    ]
    path.write_text(json.dumps({"oldReleases": [release("6.0.1")]}))
    assert catalog.archive_links(store.read_archive(spark, str(path)), "6.0.1", "x86_64", "deb", "deb").count() == 1


def test_verified_write(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(10)], "doc_num int")
    assert store.write_verified(df, str(tmp_path / "t")) == 10


def test_chunks_of_a_table_and_of_groups(spark):
    tags = tags_of(spark, [f"{i:03d}" for i in range(45)])
    whole = layout.fixed_chunks(tags, [], [F.col("seq")])
    assert rows(whole.groupBy("chunk").count(), "*") == [(0, 20), (1, 20), (2, 5)]
    halves = layout.fixed_chunks(tags.withColumn("h", F.col("seq") % 2), ["h"], [F.col("seq")], 10)
    assert rows(halves.groupBy("h", "chunk").count(), "*") == [(0, 0, 10), (0, 1, 10), (0, 2, 3), (1, 0, 10), (1, 1, 10), (1, 2, 2)]


def test_properties(spark):
    texts = spark.createDataFrame([("d", "a = 1\n# note\nb=x=y\na=2"), ("e", "a=9")], "doc string, text string")
    base = properties.property_lines(texts)
    assert rows(base, "*") == [("d", "a", " 1"), ("d", "a", "2"), ("d", "b", "x=y"), ("e", "a", "9")]
    new = spark.createDataFrame([("d", "a", "5", 1), ("d", "a", "6", 2), ("d", "c", "7", 3)], "doc string, key string, value string, seq int")
    laid = properties.overlay_properties(base, new)
    assert rows(laid, "*") == [("d", "a", "6"), ("d", "b", "x=y"), ("d", "c", "7"), ("e", "a", "9")]
