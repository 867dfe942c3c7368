"""Tables that switch together, repeated batches and rival writers."""

from __future__ import annotations

import threading

import pytest

from millrace.sources import versions
from millrace.streaming import sessions

SCHEMA = "client_id string, source_file string, n int"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_tables_switch_together(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path))
    store.commit({"staging": table(spark, [("a", "f", 1), ("a", "g", 2)]), "chunks": table(spark, [("a", "f", 10), (None, "f", 11)])})
    before = store.manifest()
    new = table(spark, [("a", "f", 3)])
    assert store.commit({"staging": new, "chunks": table(spark, [("a", "f", 30)])}, new) == 2
    assert rows(store.read("staging")) == [("a", "f", 3), ("a", "g", 2)]
    assert rows(store.read("chunks")) == [("a", "f", 30), (None, "f", 11)]
    assert rows(store.read("staging", before)) == [("a", "f", 1), ("a", "g", 2)] and rows(store.read("chunks", before)) == [("a", "f", 10), (None, "f", 11)]
    store.commit({}, table(spark, [(None, "f", 0)]))
    assert rows(store.read("chunks")) == [("a", "f", 30)]


def test_a_commit_that_fails_changes_nothing(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path))
    store.commit({"staging": table(spark, [("a", "f", 1)]), "chunks": table(spark, [])})
    bad = table(spark, [("a", "f", 2)]).selectExpr("client_id", "source_file", "raise_error('lost') AS n").selectExpr("client_id", "source_file", "CAST(n AS INT) AS n")
    with pytest.raises(Exception, match="lost"):
        store.commit({"staging": table(spark, [("a", "f", 3)]), "chunks": bad}, table(spark, [("a", "f", 0)]))
    assert store.versions() == [1] and rows(store.read("staging")) == [("a", "f", 1)] and rows(store.read("chunks")) == []


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path))
    for _ in range(2):
        assert store.commit({"log": table(spark, [("a", "f", 1)])}, batch=("stream", 0)) == 1
    store.commit({"log": table(spark, [("a", "f", 2)])}, batch=("other", 0))
    assert store.commit({"log": table(spark, [("a", "f", 9)])}, batch=("stream", 0)) == 2
    assert rows(store.read("log")) == [("a", "f", 1), ("a", "f", 2)]


def test_rival_writers_lose_nothing(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path))
    failed = []

    def write(i):
        try:
            versions.Store(spark, str(tmp_path)).commit({"log": table(spark, [("a", f"f{i}", i)])})
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and rows(store.read("log")) == [("a", f"f{i}", i) for i in range(4)] and store.versions() == [1, 2, 3, 4]


def test_compact_and_vacuum(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path))
    for i in range(4):
        new = table(spark, [("a", f"f{i % 2}", i)])
        store.commit({"log": new}, new)
    wanted = rows(store.read("log"))
    store.compact()
    assert len(store.manifest()["tables"]["log"]["parts"]) == 1 and store.manifest()["removed"] == [] and rows(store.read("log")) == wanted == [("a", "f0", 2), ("a", "f1", 3)]
    store.vacuum(1)
    assert store.versions() == [5] and rows(store.read("log")) == wanted and len(list((tmp_path / "data").iterdir())) == 1


def test_nothing_is_stored_yet(spark, tmp_path):
    store = versions.Store(spark, f"{tmp_path}/new")
    assert store.versions() == [] and store.compact() == 0 and store.manifest()["tables"] == {}


@pytest.mark.parametrize("dies", ["before", "after"])
def test_a_killed_batch_is_done_once(spark, tmp_path, dies):
    """A stream that dies before or after a batch's commit, and so repeats it, leaves each file's rows once."""
    store = versions.Store(spark, f"{tmp_path}/store")
    for i in range(3):
        table(spark, [("a", f"f{i}", i)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    crash = [True]

    def steps(batch, batch_id):
        if batch_id == 1 and crash[0] and dies == "before":
            raise RuntimeError("killed")
        store.commit({"staging": batch, "chunks": batch.withColumn("n", batch.n * 10)}, batch.select("client_id", "source_file"), ("files", batch_id))
        if batch_id == 1 and crash[0] and dies == "after":
            raise RuntimeError("killed")

    def run():
        files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return sessions.file_chain(files, steps, f"{tmp_path}/cp")

    with pytest.raises(Exception, match="killed"):
        run().awaitTermination(200)
    crash[0] = False
    run().awaitTermination(200)
    assert rows(store.read("staging")) == [("a", f"f{i}", i) for i in range(3)]
    assert rows(store.read("chunks")) == [("a", f"f{i}", 10 * i) for i in range(3)]
    assert store.manifest()["batches"] == {"files": 2} and store.versions() == [1, 2, 3]
