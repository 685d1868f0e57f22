"""Session helpers: where lineage is cut and where jobs keep their tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder ``spark.checkpoint.dir`` names; where it is unset, one in the session's warehouse.

    The named folder is shared by all executors of a cluster. A warehouse is so unless it is a local folder, which does on one
    machine only: on a cluster that is an error. No folder of one machine is ever made up.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if not warehouse:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir: {warehouse} is a folder of one machine")
        named = f"{warehouse.rstrip('/')}/_muster"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for tables and models a job writes."""
    return f"{checkpoint_dir(spark).rstrip('/')}/muster/{name}-{uuid.uuid4().hex}"


def steady(spark: SparkSession) -> SparkSession:
    """A session of the same context and settings for loops of many small steps, with plans that stand as they are made.

    Where plans adapt, the driver gives every shuffle and broadcast a thread that outlives it by a minute, and plans the rest
    anew after each: hundreds of threads and of copies of a plan in a loop. Whoever loops sets the number of partitions.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return own


def stored(df, name: str, session: SparkSession | None = None):
    """``df`` written once to the shared folder and read back, in ``session`` if given: computed once, and no lineage behind it."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)
