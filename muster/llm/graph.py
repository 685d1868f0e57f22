"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two joins on the edge table, which only shrinks or keeps its size; rounds grow with the logarithm of the
longest chain. Edges stay in Spark and are written to the shared folder once a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    mark = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))
    return tuple(edges.agg(F.count("*"), F.sum(mark), F.countDistinct("u")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge, but for the roots: the smallest node of its component.

    ``edges`` has columns u and v of one orderable type; direction, repeats and loops don't matter. Without edges the
    result is empty.
    """
    star = stored(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _state(star)
    while state[0]:
        star = stored(_small_star(_large_star(star)), "edges")
        before, state = state, _state(star)
        if state == before and state[0] == state[2]:
            break
    return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
