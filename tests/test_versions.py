"""Versioned tables: a failure anywhere leaves the old or the new version, two writers can't both win, only touched buckets move."""

import os
import threading

import pytest

from catalogwatch.sources.versions import Folder, Records, VersionedTable, VersionTaken, publish_payload, read_payload

DDL = "url string, at int, s string, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(u, at, s, "b") for u, at, s in rows], DDL)


def held(table, version=None):
    return {r["url"]: (r["at"], r["s"]) for r in table.read(version).collect()}


OLD = {f"u{i}": (1, f"old{i}") for i in range(40)}
NEW = {"u1": (2, "new"), "u2": (0, "late"), "u3": (1, "zz"), "x": (5, "added")}
AFTER = {**OLD, "u1": (2, "new"), "x": (5, "added"), "u3": (1, "zz")}


def start(spark, path, buckets=8):
    table = VersionedTable(spark, str(path), "url", buckets)
    assert table.upsert(frame(spark, [(u, *v) for u, v in OLD.items()]), ["at", "s"]) == 0
    return table


class Crash(Exception):
    pass


@pytest.mark.parametrize("where", ["begin", "read", "written", "committed"])
def test_failure_at_any_step_leaves_one_version_whole(spark, tmp_path, where):
    table = start(spark, tmp_path / "t")

    def step(name):
        if name == where:
            raise Crash(name)

    rows = frame(spark, [(u, *v) for u, v in NEW.items()])
    with pytest.raises(Crash):
        table.upsert(rows, ["at", "s"], step=step)
    assert held(table) == (AFTER if where == "committed" else OLD)
    # Done again, the end is the same whether or not the first one came through.
    table.upsert(rows, ["at", "s"])
    assert held(table) == AFTER


def test_failure_while_files_are_written(spark, tmp_path):
    table = start(spark, tmp_path / "t")
    bad = frame(spark, [(u, *v) for u, v in NEW.items()]).selectExpr("url", "at", "if(at = 5, raise_error('lost'), s) AS s", "bucket")
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad, ["at", "url"])
    assert held(table) == OLD and table.records.versions() == [0]


def test_two_writers(spark, tmp_path):
    table, other = start(spark, tmp_path / "t"), VersionedTable(spark, str(tmp_path / "t"), "url")
    mine, theirs = frame(spark, [("u1", 3, "mine"), ("m", 1, "m")]), frame(spark, [("u1", 2, "theirs"), ("u4", 9, "theirs")])
    met = []

    def step(name):
        if name == "written" and not met:
            met.append(other.upsert(theirs, "at"))

    with pytest.raises(VersionTaken):
        table.upsert(mine, "at", retries=0, step=step)
    assert held(table) == {**OLD, "u1": (2, "theirs"), "u4": (9, "theirs")}
    met.clear()
    theirs = frame(spark, [("u5", 9, "again")])
    assert table.upsert(mine, "at", step=step) == 3 and met == [2]
    assert held(table) == {**OLD, "u1": (3, "mine"), "u4": (9, "theirs"), "u5": (9, "again"), "m": (1, "m")}


def test_readers_keep_their_version_and_untouched_buckets_their_files(spark, tmp_path):
    table = start(spark, tmp_path / "t", 16)
    before = table.read()
    table.upsert(frame(spark, [("u1", 9, "n")]), "at")
    assert {r["url"]: r["at"] for r in before.collect()}["u1"] == 1 and held(table)["u1"] == (9, "n") and held(table, 0) == OLD
    a, b = (table.records.read(v)["buckets"] for v in (0, 1))
    assert sum(a[k] != b[k] for k in a) == 1
    written = [f for _, _, fs in os.walk(tmp_path / "t" / "data" / next(b[k] for k in b if a[k] != b[k])) for f in fs if f.endswith(".parquet")]
    assert len(written) == 1


def test_expired_versions(spark, tmp_path):
    table = start(spark, tmp_path / "t", 4)
    for at in (5, 6, 7):
        table.upsert(frame(spark, [("u1", at, "n")]), "at")
    folders = lambda: sum(len(d) for p, d, _ in os.walk(tmp_path / "t" / "data") if p.count(os.sep) == str(tmp_path / "t" / "data").count(os.sep) + 1)
    assert table.expire(2) == [0, 1] and table.records.versions() == [2, 3]
    assert held(table) == {**OLD, "u1": (7, "n")} and held(table, 2)["u1"] == (6, "n")
    assert folders() == 3 + 2


def test_odd_rows(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "url", 3)
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.upsert(frame(spark, []), "at") == 0 and held(table) == {}
    assert table.upsert(frame(spark, []), "at") == 0
    table.upsert(frame(spark, [(None, 1, "a"), (None, 2, "b"), ("u", 1, None), ("u", 1, None)]), ["at", "s"])
    assert held(table) == {None: (2, "b"), "u": (1, None)}
    wider = spark.createDataFrame([("u", 2, 7)], "url string, at int, extra int")
    table.upsert(wider, "at")
    assert {r["url"]: (r["s"], r["extra"]) for r in table.read().collect()} == {None: ("b", None), "u": (None, 7)}
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([("u", 1, 1)], "url string, at int, bucket_of_key int"), "at")


@pytest.mark.parametrize("mounted", [True, False])
def test_one_of_many_creates_a_file(spark, tmp_path, mounted):
    done, lost = [], []

    def create(k):
        folder = Folder(spark, f"file://{tmp_path}/f")
        folder.local = folder.local if mounted else None
        try:
            folder.create("x.json", str(k))
            done.append(k)
        except VersionTaken:
            lost.append(k)

    os.makedirs(tmp_path / "f")
    threads = [threading.Thread(target=create, args=(k,)) for k in range(8)] if mounted else []
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if not mounted:
        create(0), create(1)
    folder = Folder(spark, f"file://{tmp_path}/f")
    assert len(done) == 1 and len(lost) == (7 if mounted else 1)
    folder.local = folder.local if mounted else None
    assert folder.read("x.json") == str(done[0]) and [n for n in folder.names() if n.endswith(".json") and n[0] != "."] == ["x.json"]


def test_payloads(spark, tmp_path):
    root = str(tmp_path / "p")
    a, b = frame(spark, [("u", 1, "a")]), frame(spark, [("v", 2, "b")])
    assert [publish_payload(a, root, "1"), publish_payload(b, root, "2")] == [0, 1]
    assert read_payload(spark, root).collect() == b.collect() and read_payload(spark, root, "1").collect() == a.collect()
    broken = a.selectExpr("raise_error('lost') AS url", "at", "s", "bucket")
    with pytest.raises(Exception, match="lost"):
        publish_payload(broken, root, "3")
    assert read_payload(spark, root).collect() == b.collect()
    publish_payload(b, root, "1")
    assert read_payload(spark, root, "1").collect() == b.collect() and len(Records(spark, f"{root}/latest").versions()) == 3
