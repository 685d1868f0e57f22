"""Where work tables go: a folder that all executors share, or nowhere."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from muster.session import checkpoint_dir, workspace


def session(master="yarn", **conf):
    own = SimpleNamespace(folder=None)
    context = SimpleNamespace(
        getCheckpointDir=lambda: own.folder, setCheckpointDir=lambda path: setattr(own, "folder", path),
        master=master)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)), sparkContext=context)


def test_the_named_folder_comes_first():
    spark = session(**{"spark.checkpoint.dir": "hdfs:///work/", "spark.sql.warehouse.dir": "hdfs:///house"})
    assert checkpoint_dir(spark) == "hdfs:///work/" == spark.sparkContext.getCheckpointDir()
    assert workspace(spark, "t").startswith("hdfs:///work/muster/t-")


def test_then_the_warehouse():
    assert checkpoint_dir(session(**{"spark.sql.warehouse.dir": "hdfs:///house"})) == "hdfs:///house/_muster"


def test_else_it_raises():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace(session(), "t")


def test_a_local_warehouse_does_on_one_machine_only():
    conf = {"spark.sql.warehouse.dir": "file:/tmp/house"}
    assert checkpoint_dir(session("local[8]", **conf)) == "file:/tmp/house/_muster"
    with pytest.raises(ValueError, match="one machine"):
        checkpoint_dir(session(**conf))
