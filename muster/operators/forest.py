"""Random forests of any depth, grown level by level for all trees at once.

A row takes part in a tree with a weight drawn for the two (Poisson, as a bootstrap of many rows has it). The table of node
assignments holds one row for each of them. A level is a few DataFrame operations: sums per (tree, node, feature, bin), running
sums over the bins of one feature of one node, the best split of each node, and a join that moves rows to its children. Nodes of one
value, and those no split improves, are leaves and their rows leave the table. The loop ends when no row is left, so depth has no
limit and a leaf may be a single row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.operators.trees import NODE_SCHEMA, TreeModel, binned, cut_points
from muster.session import stored


@dataclass(frozen=True)
class Forest:
    trees: int
    seed: int = 42
    bins: int = 1024


def drawn(rows: DataFrame, spec: Forest) -> DataFrame:
    """(tree, mark, w, x, y): the rows of every tree with how often it draws them."""
    u = "(shiftrightunsigned(xxhash64(mark, tree, {}), 11) / 9007199254740992D)".format(spec.seed)
    below, cdf = 0.0, []
    for k in range(16):  # 1 - P(weight < 16) is less than the spacing of u
        below += math.exp(-1) / math.factorial(k)
        cdf.append(f"CAST({u} >= {min(below, 1.0)!r}D AS INT)")
    each = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(spec.trees - 1))))
    return each.withColumn("w", F.expr(" + ".join(cdf)).cast("double")).filter("w > 0")


def _best(assigned: DataFrame, features: int) -> DataFrame:
    """(tree, node, s, c, gain, feature, bin): sums of every node, and its best split if one helps."""
    node = ["tree", "node"]
    sums = [F.sum("w").alias("c"), F.sum(F.col("w") * F.col("y")).alias("s")]
    whole = assigned.groupBy(*node).agg(*sums, F.min("y").alias("low"), F.max("y").alias("high"))
    each = assigned.select(*node, "w", "y", F.posexplode("x").alias("feature", "bin"))
    bins = each.groupBy(*node, "feature", "bin").agg(*sums)
    run = Window.partitionBy(*node, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ends = Window.partitionBy(*node, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = bins.select(*node, "feature", "bin", F.sum("c").over(run).alias("cl"), F.sum("s").over(run).alias("sl"),
                       F.sum("c").over(ends).alias("c"), F.sum("s").over(ends).alias("s"))
    gain = F.expr("sl * sl / cl + (s - sl) * (s - sl) / (c - cl) - s * s / c").alias("gain")
    split = left.filter("cl < c").select(*node, gain, (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    best = split.groupBy(*node).agg(F.max(F.struct("gain", "f", "b")).alias("best"))
    found = whole.join(best, node, "left")
    helps = F.expr("low < high AND best.gain > 0")
    return found.select(*node, "s", "c", F.when(helps, F.col("best.gain")).alias("gain"),
                        F.when(helps, -F.col("best.f")).alias("feature"), F.when(helps, -F.col("best.b")).alias("bin"))


def fit(rows: DataFrame, spec: Forest, features: Sequence[str], target: str, kind: str) -> TreeModel:
    """The forest of ``rows``. Without rows with a target the model predicts null."""
    cuts = cut_points(rows.filter(F.col(target).isNotNull()), features, spec.bins)
    x = F.array(*[F.col(f"x{i}") for i in range(len(features))]).alias("x")
    marked = stored(binned(rows, features, target, cuts).select(F.monotonically_increasing_id().alias("mark"), x, "y"), "forest-rows")
    assigned = stored(drawn(marked, spec).withColumn("node", F.lit(0)), "forest-level")
    points = F.array(*[F.array(*[F.lit(float(v)) for v in c]) if len(c) else F.array().cast("array<double>") for c in cuts])
    by_tree, levels, depth = Window.partitionBy("tree"), [], 0
    while True:
        best = _best(assigned, len(features))
        place = F.count("feature").over(by_tree.orderBy("node")) - 1
        first = F.max("node").over(by_tree) + 1
        level = stored(best.withColumn("left", F.when(F.col("feature").isNotNull(), first + 2 * place).cast("int")), "forest-nodes")
        inner = F.col("feature").isNotNull()
        threshold = F.when(inner, F.get(F.get(points, F.col("feature")), F.col("bin")))
        levels.append(level.select(
            "tree", "node", F.lit(depth).alias("depth"), F.coalesce("feature", F.lit(-1)).alias("feature"), threshold.alias("threshold"),
            F.coalesce("left", F.lit(0)).alias("left"), (F.col("s") / F.col("c")).alias("value"),
            F.coalesce("gain", F.lit(0.0)).alias("gain"), F.col("c").alias("cover")))
        split = level.filter(inner).select("tree", "node", "feature", "bin", "left")
        if split.isEmpty():
            break
        moved = assigned.join(split, ["tree", "node"])
        child = F.expr("left + CAST(x[feature] > bin AS INT)")
        assigned = stored(moved.select("tree", "mark", "w", "x", "y", child.alias("node")), "forest-level")
        depth += 1
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.union(level)
    schema = [f"CAST({c} AS {t}) {c}" for c, t in (field.split() for field in NODE_SCHEMA.split(", "))]
    return TreeModel(kind, stored(nodes.selectExpr(*schema), "forest"), list(features), mean=True)
