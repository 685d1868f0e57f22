"""Versions of a snapshot and batches of appends: what a job that fails or is repeated leaves behind."""

from __future__ import annotations

import pathlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from muster.plans import records
from muster.sources import snapshots, tables


def files(path):
    return {str(p.relative_to(path)): (p.stat().st_mtime_ns, p.read_bytes()) for p in pathlib.Path(path).rglob("*.parquet")}


def staff(domain):
    return domain.employees().select("*")


def contents(df):
    return sorted(rows(df.select("matricule", "last_name", F.col("date_left").cast("string"))), key=repr)


@pytest.fixture
def stored(spark, domain, tmp_path):
    path = str(tmp_path / "staff")
    snapshots.create(staff(domain), "employees", path, buckets=8)
    return path


def leave(spark, *keys):
    return spark.createDataFrame([(i, str(k), "2019-05-05") for i, k in enumerate(keys)], "seq bigint, matricule string, date_left string")


def test_a_change_writes_only_the_buckets_it_touches(spark, stored):
    before, old = files(stored), contents(snapshots.read(spark, "employees", stored))
    active = snapshots.read(spark, "employees", stored).filter("date_left IS NULL").select("matricule").limit(1).first()[0]
    refused = records.change_snapshot(spark, stored, "terminate", leave(spark, active))
    assert refused.count() == 0 and snapshots.newest(spark, stored) == 2
    after = files(stored)
    assert {n: after[n] for n in before} == before  # nothing that was there is touched
    new = {n for n in after if n not in before}
    assert len({n.split("/bucket=")[1].split("/")[0] for n in new if n.startswith("data/")}) == 1
    now = contents(snapshots.read(spark, "employees", stored))
    assert [x for x in now if x not in old] == [(active, dict((r[0], r[1]) for r in old)[active], "2019-05-05")]
    assert len(now) == len(old)
    assert contents(snapshots.read(spark, "employees", stored, version=1)) == old


def test_a_failed_job_is_invisible_and_can_be_run_again(spark, stored, monkeypatch):
    old = contents(snapshots.read(spark, "employees", stored))
    keys = spark.createDataFrame([(10,), (11,), (12,)], "matricule bigint")

    def gone(employees):
        return employees.filter("matricule NOT IN (10, 11, 12)")

    publish = snapshots._publish
    monkeypatch.setattr(snapshots, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        snapshots.change(spark, "employees", stored, keys, gone)
    assert snapshots.newest(spark, stored) == 1 and contents(snapshots.read(spark, "employees", stored)) == old
    monkeypatch.setattr(snapshots, "_publish", publish)
    assert snapshots.change(spark, "employees", stored, keys, gone) == 2
    assert contents(snapshots.read(spark, "employees", stored)) == [r for r in old if r[0] not in (10, 11, 12)]


def test_two_writers_cannot_publish_one_version(spark, stored):
    keys = spark.createDataFrame([(10,)], "matricule bigint")

    def meanwhile(employees):
        snapshots.change(spark, "employees", stored, spark.createDataFrame([(11,)], "matricule bigint"),
                         lambda e: e.filter("matricule <> 11"))
        return employees.filter("matricule <> 10")

    with pytest.raises(Exception, match="(?i)exists"):
        snapshots.change(spark, "employees", stored, keys, meanwhile)
    assert snapshots.newest(spark, stored) == 2
    with pytest.raises(ValueError, match="version 2"):
        snapshots.change(spark, "employees", stored, keys, lambda e: e, after=1)


def test_batches_without_usable_keys_change_nothing(spark, stored):
    refused = records.change_snapshot(spark, stored, "terminate", leave(spark, "x", "-5.5"))
    assert snapshots.newest(spark, stored) == 1 and refused.count() == 2


def test_empty_snapshot_fills_up(spark, domain, tmp_path):
    path = str(tmp_path / "empty")
    snapshots.create(staff(domain).limit(0), "employees", path, buckets=4)
    assert snapshots.read(spark, "employees", path).count() == 0
    some = staff(domain).limit(5).cache()
    snapshots.change(spark, "employees", path, some, lambda e: e.union(some))
    assert contents(snapshots.read(spark, "employees", path)) == contents(some)
    with pytest.raises(ValueError):
        snapshots.create(some, "employees", path)


def test_a_batch_counts_once(spark, domain, tmp_path, monkeypatch):
    path, moves = str(tmp_path / "moves"), domain.recruitment()
    first, second = moves.filter("id % 2 = 0"), moves.filter("id % 2 = 1")
    tables.append_movements(first, "recruitment", path, batch="a")
    done = files(path)
    for _ in range(2):
        tables.append_movements(second, "recruitment", path, batch="b")
    tables.append_movements(first, "recruitment", path, batch="a")
    kept = tables.scan_batches(spark, "recruitment", path)
    assert kept.count() == moves.count() and kept.select("id").distinct().count() == moves.select("id").distinct().count()
    assert {n: files(path)[n] for n in done} == done

    class Killed(Exception):
        pass

    third = moves.limit(3).withColumn("id", F.col("id") + 1_000_000)
    create = type(spark).createDataFrame
    with monkeypatch.context() as m:
        def fail(self, data, *a, **k):
            if data == [("c",)]:
                raise Killed
            return create(self, data, *a, **k)

        m.setattr(type(spark), "createDataFrame", fail)
        with pytest.raises(Killed):
            tables.append_movements(third, "recruitment", path, batch="c")
    assert tables.scan_batches(spark, "recruitment", path).count() == moves.count()  # rows are there, the batch is not
    assert tables.append_movements(third, "recruitment", path, batch="c").count() == moves.count() + 3


def test_no_batches_yet(spark, tmp_path):
    assert tables.scan_batches(spark, "recruitment", str(tmp_path / "none")).count() == 0
