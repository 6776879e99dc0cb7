"""Stored tables: changes, snapshots, failures between the steps, two writers."""

from __future__ import annotations

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import tables
from tidemark.sources.tables import Conflict, Table


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return Table.create(spark.createDataFrame([(i, f"s{i}", float(i)) for i in range(40)] + [(None, "none", 0.5)], "id long, s string, v double"), str(tmp_path / "t"), "id", 5)


def test_changes_are_stored_and_versions_stay_readable(spark, table):
    first = table.read()
    table.update(spark.createDataFrame([(3, "x", None), (3, "y", None), (99, "z", 1.0)], "id long, s string, v double"))
    table.delete(spark.createDataFrame([(4,), (4,), (77,)], "id long"))
    table.upsert(spark.createDataFrame([(5, "five", 5.5, 1), (5, "older", 9.0, 0), (100, "new", 1.0, 0), (None, "null", 2.0, 0)], "id long, s string, v double, at int"), "at")
    want = {i: (i, f"s{i}", float(i)) for i in range(40) if i != 4} | {3: (3, "y", 3.0), 5: (5, "five", 5.5), 100: (100, "new", 1.0), None: (None, "null", 2.0)}
    assert rows(table.read()) == sorted(want.values(), key=repr)
    assert first.count() == 41 and rows(table.read(1)) == rows(first) and table.versions() == [1, 2, 3, 4]


def test_only_touched_partitions_are_written(spark, table):
    before = table.snapshot()["parts"]
    table.delete(spark.createDataFrame([(7,)], "id long"))
    after = table.snapshot()["parts"]
    assert sum(before[p] != after.get(p) for p in before) == 1


def test_failure_before_the_commit_changes_nothing(spark, table, monkeypatch):
    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Table, "_commit", fail)
        with pytest.raises(RuntimeError):
            table.delete(spark.createDataFrame([(7,)], "id long"))
    assert table.read().count() == 41 and table.versions() == [1]
    assert table.vacuum(age=0.0) == 1 and table.read().count() == 41  # what the lost change had written


def test_half_written_version_is_not_read(spark, table, monkeypatch):
    table.files.create("versions/0000000002.json", '{"version": 2, "par')
    with pytest.raises(Conflict):
        table.snapshot()
    monkeypatch.setattr(tables, "GRACE", -1.0)
    assert table.read().count() == 41
    table.delete(spark.createDataFrame([(7,)], "id long"))
    assert table.versions()[-1] == 3 and table.read().count() == 40


def test_a_batch_is_applied_once(spark, table):
    more = spark.createDataFrame([(200, "a", 1.0)], "id long, s string, v double")
    for _ in range(3):
        table.append(more, token=("stream", 0))
    table.append(more, token=("stream", 1))
    assert table.read().where("id = 200").count() == 2


def test_two_loaders_add_each_key_once(spark, table):
    load = spark.createDataFrame([(i, "l", 0.0) for i in range(30, 60)] * 2, "id long, s string, v double")
    added = []
    threads = [threading.Thread(target=lambda: added.append(Table(spark, table.path).insert_once(load))) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(added) == [0, 20]
    assert table.read().groupBy("id").count().where("count > 1").count() == 0 and table.read().count() == 61


def test_a_load_reads_only_its_buckets(spark, table):
    few = spark.createDataFrame([(1000, "l", 0.0)], "id long, s string, v double")
    snap = table.snapshot()
    assert len(snap["parts"]) == 5 and len(table._holding(snap, few.select("id"))) == 1
    files = table._rows(snap, table._holding(snap, few.select("id"))).inputFiles()
    assert 0 < len(files) < len(table.read().inputFiles())


def test_days_leave_without_being_read(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    data = [(i, start + dt.timedelta(hours=i)) for i in range(240)] + [(1000, None)]
    table = Table.create(spark.createDataFrame(data, "id long, at timestamp"), str(tmp_path / "d"), "id", 2, "at")
    before = table.snapshot()["parts"]
    assert table.retain("2024-01-11 06:00:00", 5) == (114, 127)
    after = table.snapshot()["parts"]
    assert {p.rsplit("-", 1)[0] for p in after} == {f"2024-01-{d:02d}" for d in range(6, 11)}
    assert all(after[p] == before[p] for p in after if not p.startswith("2024-01-06"))
    table.upsert(spark.createDataFrame([(200, start), (5, start)], "id long, at timestamp"))  # one moves to another day, one is new
    got = {r["id"]: r["at"] for r in table.read().collect()}
    assert len(got) == 115 and got[200] == got[5] == start and table.read().count() == 115
    table.delete(table.read().where(F.col("id") > 150).select("id"))
    assert table.read().where("id > 150").count() == 0
    assert table.retain("2023-01-01 00:00:00", 5)[1] == 0
