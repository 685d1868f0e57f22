"""Joins with a table of unique keys that stay even when a few keys hold much of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with this part of all rows is met by broadcast; there are at most so many such keys.
SHARE = 1000


def meet(left: DataFrame, right: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """Inner join of ``left`` with ``right``, whose keys are unique and not null.

    Keys that hold a ``share``-th or more of ``left`` are at most ``share``: their rows of ``right`` are broadcast, and ``left``
    stays where it is. All others meet in a shuffle, in which none holds more than that part. ``left`` is read twice and
    counted once, so it should be a stored table.
    """
    uses = left.groupBy(key).agg(F.count("*").alias("_uses"))
    total = left.agg(F.count("*"))
    hot = uses.filter(F.col("_uses") * share >= total.scalar()).select(key)
    few = right.join(F.broadcast(hot), key, "left_semi")
    near = left.join(F.broadcast(few), key)
    far = left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    return near.unionByName(far)
