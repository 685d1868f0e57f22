"""Orderings, limits and numbering of row-level tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.session import checkpoint_dir


def newest_first(df: DataFrame, date: str, tie: str) -> DataFrame:
    """Whole table, newest record first; the key breaks ties so the order is the same every run."""
    return df.orderBy(F.desc(date), tie)


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First ``n`` rows by key (per-partition top-n, no full sort)."""
    return df.orderBy(key).limit(n)


def first_match(df: DataFrame, condition: Column, key: str) -> DataFrame:
    return df.filter(condition).orderBy(key).limit(1)


def number_rows(df: DataFrame, by: str, order: Sequence[Column], name: str) -> DataFrame:
    """Exact 1-based position of each row among the rows of its key.

    The rows are spread by a range sort over (key, order), so a key of any size lies in as many pieces as it
    needs, and a row's position is its place in its piece plus the rows of the key's earlier pieces. The sorted
    rows are checkpointed, so a lost executor cannot shift the pieces between the two reads. The piece counts
    have one row per key and piece.
    """
    checkpoint_dir(df.sparkSession)
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(pieces, F.col(by), *order)
        .sortWithinPartitions(F.col(by), *order)
        .withColumns({"_piece": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
        .checkpoint()
    )
    earlier = Window.partitionBy(by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(by, "_piece")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(F.col(by).alias("_key"), F.col("_piece").alias("_part"), "_first", "_before")
    )
    same = placed[by].eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_part"))
    numbered = placed.join(starts, same).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return numbered.select(*df.columns, name)
