import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetframe.operators import catalog
from fleetframe.sources import catalog as store, page_index


def shown(df):
    return [(r.place, r.tag, r.has_more) for r in sorted(df.collect(), key=lambda r: r.place)]


@pytest.fixture(scope="module")
def listing(spark, tmp_path_factory):
    rng = random.Random(1)
    tags = sorted({f"{rng.randint(3, 8)}.{rng.randint(0, 3)}.{rng.randint(0, 30)}-{rng.choice('abc')}" for _ in range(300)} | {"latest", "7", "7.0", "￿", "\U0001f600", "x"})
    docs = catalog.tag_documents(spark.createDataFrame(list(enumerate(tags)), "seq long, tag string"))
    path = str(tmp_path_factory.mktemp("index"))
    page_index.write_index(docs, path, range_rows=16)
    return tags, docs, path


def test_every_page_equals_the_plain_one(spark, listing):
    tags, docs, path = listing
    backwards = sorted(tags, reverse=True)
    for size in (7, 40, 1000):
        for page in range(1, len(tags) // size + 3):
            want = backwards[(page - 1) * size : page * size]
            got = shown(page_index.indexed_page(spark, path, page, size))
            assert got == [(i + 1, t, len(tags) > page * size) for i, t in enumerate(want)]
    assert shown(page_index.indexed_page(spark, path, 2, 40, compat_drop_last=True)) == shown(catalog.tag_page(docs, 2, 40, compat_drop_last=True))


@pytest.mark.parametrize("version", ["7", "7.0", "07.0", "7.0.3", "9", " "])
def test_pages_of_a_version(spark, listing, version):
    _, docs, path = listing
    for page in (1, 2, 5):
        want = shown(catalog.tag_page(catalog.version_filter(docs, version), page, 6))
        assert shown(page_index.indexed_page(spark, path, page, 6, version)) == want
    with pytest.raises(ValueError):
        page_index.indexed_page(spark, path, version="seven")


def test_pages_after_a_tag(spark, listing):
    tags, docs, path = listing
    for after in (tags[0], tags[1], tags[130], tags[-1], "zzz\U0001f600", "6", ""):
        for size in (1, 20, 500):
            assert shown(page_index.indexed_page(spark, path, page_size=size, after=after)) == shown(catalog.tag_page(docs, page_size=size, after=after))


def test_a_page_reads_its_ranges_only(spark, listing):
    tags, _, path = listing
    deep = page_index.indexed_page(spark, path, len(tags) // 10 - 2, 10)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "HashAggregate" not in plan
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    read = deep._jdf.queryExecution().optimizedPlan().toString()
    assert "range" in scan and "scope" in scan
    ranges = spark.read.parquet(f"{path}/rows").select("range").distinct().count()
    wanted = {int(n) for n in __import__("re").findall(r"range#\d+ IN \(([^)]*)\)", read)[0].split(",")} if " IN (" in read else {0}
    assert ranges > 20 and len(wanted) <= 2


def test_indexes_follow_the_catalogue(spark, tmp_path):
    root = str(tmp_path / "t")
    add = lambda n, *tags: store.append_batch(catalog.tag_documents(spark.createDataFrame(list(enumerate(tags)), "seq long, tag string")), root, "load", n)
    add(0, "7.0", "8.0")
    with pytest.raises(ValueError, match="no page index"):
        page_index.list_indexed_tags(spark, root)
    assert page_index.index_catalog(spark, root) == 1 == page_index.index_catalog(spark, root)
    add(1, "7.0", "9.0")
    # Pages stay on the indexed version until the next index is complete.
    assert [t for _, t, _ in shown(page_index.list_indexed_tags(spark, root))] == ["8.0", "7.0"]
    store.compact(spark, root)
    assert page_index.index_catalog(spark, root) == 3
    assert [t for _, t, _ in shown(page_index.list_indexed_tags(spark, root, version="7"))] == ["7.0"]
    assert [t for _, t, _ in shown(page_index.list_indexed_tags(spark, root))] == ["9.0", "8.0", "7.0"]
    assert page_index.drop_old_indexes(spark, root) == [1]
    assert rows(store.read_catalog(spark, root).select(F.count("tag")), "*") == [(3,)]


def test_an_empty_catalogue(spark, tmp_path):
    docs = catalog.tag_documents(spark.createDataFrame([], "seq long, tag string"))
    page_index.write_index(docs, str(tmp_path))
    assert shown(page_index.indexed_page(spark, str(tmp_path))) == [] == shown(page_index.indexed_page(spark, str(tmp_path), after="x"))
