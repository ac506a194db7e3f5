import json
import threading

import pytest
from conftest import rows

from fleetframe.operators.catalog import tag_documents
from fleetframe.sources import catalog as store
from fleetframe.sources.commits import CommitLog


def docs(spark, *tags, day=1):
    from pyspark.sql import functions as F

    made = tag_documents(spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "seq long, tag string"))
    return made.withColumn("imported_at", F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp"))


def tags(spark, root, version=None):
    return [t for (t,) in rows(store.read_catalog(spark, root, version), "tag")]


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "table")
    for i in range(3):
        store.append_batch(docs(spark, "7.0", f"7.0.{i}", day=i + 1), path, "load", i)
    return path


CURRENT = ["7.0", "7.0.0", "7.0.1", "7.0.2"]


def test_versions_stay_readable(spark, root):
    assert CommitLog(spark, root).versions() == [1, 2, 3]
    assert tags(spark, root, 1) == ["7.0", "7.0.0"] and tags(spark, root) == CURRENT
    with pytest.raises(ValueError, match="version 9 is not kept"):
        store.read_catalog(spark, root, 9)
    assert tags(spark, root + "-not-there") == []


def test_a_reader_keeps_its_version_while_others_compact(spark, root):
    before = store.read_catalog(spark, root)
    store.append_batch(docs(spark, "8.0", day=9), root, "load", 3)
    assert store.compact(spark, root).version == 5
    assert rows(before, "tag") == [(t,) for t in CURRENT]
    assert tags(spark, root) == [*CURRENT, "8.0"] and len(CommitLog(spark, root).read().folders) == 1
    # What was just written or read may be in use and stays.
    assert store.vacuum(spark, root, keep_versions=1) == []
    assert rows(before, "tag") == [(t,) for t in CURRENT]
    gone = store.vacuum(spark, root, keep_versions=1, keep_seconds=0)
    assert len(gone) == 4 and CommitLog(spark, root).versions() == [5]
    assert tags(spark, root) == [*CURRENT, "8.0"] and spark.read.parquet(root).count() == 5


def test_of_two_compactions_one_is_committed(spark, root, monkeypatch):
    plain, inner = store._write, []

    def write(log, df, place):
        folder = plain(log, df, place)
        if "compacted" in place and not inner:
            inner.append(None)
            inner.append(store.compact(spark, root))
            store.append_batch(docs(spark, "8.0", day=9), root, "other", 0)
        return folder

    monkeypatch.setattr(store, "_write", write)
    last = store.compact(spark, root)
    log = CommitLog(spark, root)
    assert inner[1].version == 4 and last.version == log.read().version == 5
    assert [log.read(n).note["operation"] for n in log.versions()] == ["append"] * 3 + ["compact", "append"]
    assert tags(spark, root) == [*CURRENT, "8.0"]
    assert len(store.vacuum(spark, root, 1, 0)) == 3  # the loser has dropped its own folder


def test_appends_during_a_compaction_stay(spark, root, monkeypatch):
    plain = store._write

    def write(log, df, place):
        folder = plain(log, df, place)
        if "compacted" in place:
            plain_append()
        return folder

    def plain_append():
        monkeypatch.setattr(store, "_write", plain)
        store.append_batch(docs(spark, "7.0", "9.0", day=20), root, "other", 0)

    monkeypatch.setattr(store, "_write", write)
    store.compact(spark, root)
    assert tags(spark, root) == [*CURRENT, "9.0"]
    at = {r.tag: r.imported_at.day for r in store.read_catalog(spark, root).collect()}
    assert at["7.0"] == 20 and at["7.0.2"] == 3


def test_concurrent_commits_are_all_kept(spark, tmp_path):
    root, failed = str(tmp_path / "t"), []

    def load(writer):
        try:
            for n in range(4):
                CommitLog(spark, root).commit(lambda latest, n=n: (*latest.folders, f"writer={writer}/batch={n}"), writer, n)
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=load, args=(f"w{i}",)) for i in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    last = CommitLog(spark, root).read()
    assert not failed and last.version == 20
    assert sorted(last.folders) == sorted(f"writer=w{i}/batch={n}" for i in range(5) for n in range(4))
    assert last.applied == {f"w{i}": 3 for i in range(5)}


@pytest.mark.parametrize("step", ["before data", "before commit", "before link", "after commit"])
@pytest.mark.parametrize("operation", ["append", "compact"])
def test_a_run_that_breaks_off(spark, root, monkeypatch, step, operation):
    run = (lambda: store.append_batch(docs(spark, "8.0", day=9), root, "load", 3, once=True)) if operation == "append" else (lambda: store.compact(spark, root))

    def stop(*_, **__):
        raise KeyboardInterrupt(step)

    with monkeypatch.context() as patch:
        if step == "before data":
            patch.setattr(store, "_write", stop)
        elif step == "before commit":
            patch.setattr(CommitLog, "commit", stop)
        else:
            plain = CommitLog._put_if_absent
            if step == "before link":
                patch.setattr(CommitLog, "_put_if_absent", lambda self, name, text: (plain(self, f"draft-{name}x", text), stop()))
            else:
                patch.setattr(CommitLog, "_put_if_absent", lambda self, name, text: (plain(self, name, text), stop()))
        with pytest.raises(KeyboardInterrupt):
            run()
    done = [*CURRENT, "8.0"] if operation == "append" and step == "after commit" else CURRENT
    assert tags(spark, root) == done
    run()
    assert tags(spark, root) == ([*CURRENT, "8.0"] if operation == "append" else CURRENT)
    store.vacuum(spark, root, 1, 0)
    assert spark.read.parquet(root).count() == {"append": 7, "compact": 4}[operation]


def test_a_batch_taken_in_by_a_compaction_is_not_added_again(spark, root):
    store.compact(spark, root)
    store.append_batch(docs(spark, "7.0", day=1), root, "later", 0)
    again = store.append_batch(docs(spark, "7.0", "stray", day=30), root, "load", 2, once=True)
    assert again.version == 5 and tags(spark, root) == CURRENT


def test_a_table_without_a_log_is_taken_over(spark, tmp_path):
    root = str(tmp_path / "old")
    docs(spark, "7.0").write.parquet(f"{root}/writer=a/batch=0")
    docs(spark, "7.0", "8.0", day=2).write.parquet(f"{root}/writer=b/batch=4")
    assert tags(spark, root) == ["7.0", "8.0"] and CommitLog(spark, root).read().version == 0
    store.append_batch(docs(spark, "9.0", day=3), root, "a", 0)
    assert tags(spark, root) == ["7.0", "8.0", "9.0"] and CommitLog(spark, root).read().version == 1


def test_manifests_are_plain_json(spark, root, tmp_path):
    body = json.loads((tmp_path / "table" / "_commits" / f"{2:020d}.json").read_text())
    assert body["applied"] == {"load": 1} and len(body["folders"]) == 2 and body["note"] == {"operation": "append"}


def test_the_latest_version_is_found_without_a_listing(spark, root, tmp_path, monkeypatch):
    log = CommitLog(spark, root)
    assert log.read().version == 3
    with monkeypatch.context() as patch:
        patch.setattr(CommitLog, "names", lambda *_: pytest.fail("listed"))
        assert log.read().version == 3
        for n in (4, 5):
            CommitLog(spark, root).commit(lambda latest: latest.folders, "load", n)
        assert log.read().version == 5
    # A log that was begun anew, and one whose early versions went, are found too.
    for n in (5, 4, 3):
        (tmp_path / "table" / "_commits" / f"{n:020d}.json").unlink()
    assert log.read().version == 2 and log.versions() == [1, 2]
    (tmp_path / "table" / "odd, name").mkdir()
    assert set(log.names(log.root)) == {"_commits", "writer=load", "odd, name"} and log.names(log.root, "odd") == ["odd, name"]
