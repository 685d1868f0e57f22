"""Regularised gradient boosting with second-order steps, histograms and column sampling.

Columns are binned once. The binned rows are dealt to tasks that run side by side (a barrier stage) and stay in their memory for a
segment of rounds. At each level of a tree every task adds up gradients and hessians of its rows per (node, feature, bin), for the
smaller child of each split only; the tasks exchange these histograms, add them in the same order, find the same splits and move
their rows. What is exchanged depends on nodes, features and bins, not on rows, and a level costs one exchange and no job.

A split's gain and a leaf's weight follow the second-order objective with an L1 penalty ``alpha`` (soft threshold on the gradient
sum) and an L2 penalty ``lam`` (added to the hessian sum); a child needs a hessian of ``child_weight``. Loss is squared error.

After each segment its trees are written as a table of nodes. A lost executor makes Spark run the stage of the segment again; a job
that is started again on the same folder takes the complete segments from there. Either way rows replay the trees that exist, in
order, so that every sum has the bits it had: the model is that of an unbroken run.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.trees import NODE_SCHEMA, TreeModel, binned, cut_points
from muster.session import workspace

#: Rows a task holds; more rows take more tasks, which all run at once.
ROWS_PER_TASK = 1 << 20
#: Rounds between two writes.
SEGMENT = 200


@dataclass(frozen=True)
class Boosting:
    rounds: int
    rate: float
    depth: int
    child_weight: float = 1.0
    rows: float = 1.0
    columns: float = 1.0
    alpha: float = 0.0
    lam: float = 1.0
    seed: int = 42
    bins: int = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def drawn(marks: np.ndarray, spec: Boosting, round_: int) -> np.ndarray:
    """Which rows a round learns from, by a hash of row and round."""
    salt = _mixed(np.array([(spec.seed << 32) + round_ + 1], np.uint64))
    return (_mixed(marks + salt) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 < spec.rows


def drawn_columns(n: int, spec: Boosting, round_: int) -> np.ndarray:
    """Which features a tree may split on, ascending."""
    keep = max(int(spec.columns * n), 1)
    return np.sort(np.random.default_rng([spec.seed, round_]).permutation(n)[:keep])


def shrunk(gradient: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(gradient) * np.maximum(np.abs(gradient) - alpha, 0.0)


def gain_of(gradient: np.ndarray, hessian: np.ndarray, spec: Boosting) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(hessian + spec.lam > 0, shrunk(gradient, spec.alpha) ** 2 / (hessian + spec.lam), 0.0)


def best_splits(sums: np.ndarray, spec: Boosting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of histograms (node, feature, bin, gradient and hessian): gain, feature and last left bin of each node's best split.

    The first feature and bin win a tie; a gain of 0 is no split.
    """
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    gain = (gain_of(left[..., 0], left[..., 1], spec) + gain_of(right[..., 0], right[..., 1], spec)
            - gain_of(whole[..., 0], whole[..., 1], spec)) / 2
    fits = (left[..., 1] >= spec.child_weight) & (right[..., 1] >= spec.child_weight) & (left[..., 1] > 0) & (right[..., 1] > 0)
    gain = np.where(fits, gain, -np.inf).reshape(len(sums), -1)
    at = gain.argmax(axis=1)
    return gain[np.arange(len(at)), at], at // sums.shape[2], at % sums.shape[2]


class Rows:
    """The rows of one task, and what a round knows of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, base: float):
        self.x, self.y, self.margin = x, y, np.full(len(y), base)
        mark = np.zeros(len(y), np.uint64)
        for column in (*x.T, y):
            mark = _mixed(mark * np.uint64(31) + np.ascontiguousarray(column).astype(np.float64).view(np.uint64))
        # rows come sorted, so equal ones are neighbours: their order tells them apart
        head = np.append(True, mark[1:] != mark[:-1])
        self.marks = mark + (np.arange(len(y)) - np.maximum.accumulate(np.where(head, np.arange(len(y)), 0))).astype(np.uint64)

    def histograms(self, node: np.ndarray, wanted: np.ndarray, gradient: np.ndarray, columns: np.ndarray, bins: int) -> np.ndarray:
        """Sums of gradients and hessians of the rows at each ``wanted`` node, per feature and bin."""
        slot = np.full(int(max(node.max(initial=-1), wanted.max(initial=-1))) + 2, -1)
        slot[wanted] = np.arange(len(wanted))
        at = slot[node]
        own = np.flatnonzero(at >= 0)
        key = ((at[own, None] * len(columns) + np.arange(len(columns))) * bins + self.x[np.ix_(own, columns)]).ravel()
        size = len(wanted) * len(columns) * bins
        sums = np.empty((size, 2))
        sums[:, 0] = np.bincount(key, np.repeat(gradient[own], len(columns)), size)
        sums[:, 1] = np.bincount(key, minlength=size)
        return sums.reshape(len(wanted), len(columns), bins, 2)

    def leaf_of(self, tree: list[tuple], cuts: int) -> np.ndarray:
        """The node at which every row ends, by bins."""
        feature = np.array([n[0] for n in tree])
        last, left = np.array([n[1] for n in tree]), np.array([n[2] for n in tree])
        node = np.zeros(len(self.y), np.int64)
        for _ in range(cuts):
            inner = feature[node] >= 0
            right = self.x[np.arange(len(node)), np.maximum(feature[node], 0)] > last[node]
            node = np.where(inner, left[node] + right, node)
        return node


def added(histograms: np.ndarray, context: BarrierTaskContext | None) -> np.ndarray:
    """The sum of all tasks' histograms, in the order of the tasks; only filled bins travel."""
    if context is None:
        return histograms
    flat = histograms.reshape(-1, 2)
    filled = np.flatnonzero(flat[:, 1])
    own = filled.astype(np.int64).tobytes() + flat[filled].tobytes()
    out = np.zeros_like(flat)
    for message in context.allGather(base64.b64encode(own).decode()):
        raw = base64.b64decode(message)
        n = len(raw) // 24
        out[np.frombuffer(raw, np.int64, n)] += np.frombuffer(raw, np.float64, 2 * n, 8 * n).reshape(-1, 2)
    return out.reshape(histograms.shape)


def grown(rows: Rows, spec: Boosting, round_: int, bins: int, context: BarrierTaskContext | None) -> list[tuple]:
    """One tree as nodes (feature, last left bin, left child, value, gain, cover, depth), level by level."""
    columns = drawn_columns(rows.x.shape[1], spec, round_)
    used = drawn(rows.marks, spec, round_)
    gradient = rows.margin - rows.y
    node = np.where(used, 0, -1)
    tree: list[tuple] = [()]
    level, sums = np.array([0]), added(rows.histograms(node, np.array([0]), gradient, columns, bins), context)
    for depth in range(spec.depth + 1):
        whole = sums[:, 0].sum(axis=1)
        weight = np.where(whole[:, 1] + spec.lam > 0, -shrunk(whole[:, 0], spec.alpha) / np.maximum(whole[:, 1] + spec.lam, 1e-300), 0.0)
        if depth < spec.depth:
            gain, feature, last = best_splits(sums, spec)
        else:
            gain = np.full(len(level), -np.inf)
        split = np.flatnonzero(gain > 0)
        chosen = set(split.tolist())
        for i, at in enumerate(level.tolist()):
            if i not in chosen:
                tree[at] = (-1, 0, 0, spec.rate * weight[i], 0.0, whole[i, 1], depth)
                continue
            tree[at] = (int(columns[feature[i]]), int(last[i]), len(tree), 0.0, gain[i], whole[i, 1], depth)
            tree += [(), ()]
        if not len(split):
            break
        lefts = np.array([tree[at][2] for at in level[split].tolist()])
        moved = np.full(len(tree), -1)
        moved[level[split]] = np.arange(len(split))
        at = np.where(node >= 0, moved[node], -1)
        own = np.flatnonzero(at >= 0)
        right = rows.x[own, columns[feature[split]][at[own]]] > last[split][at[own]]
        node = np.full(len(node), -1)
        node[own] = lefts[at[own]] + right
        left = np.cumsum(sums[split], axis=2)[np.arange(len(split)), feature[split], last[split], 1]
        small = np.where(left * 2 <= whole[split, 1], 0, 1)
        half = added(rows.histograms(node, lefts + small, gradient, columns, bins), context)
        both = np.empty((2 * len(split), *half.shape[1:]))
        both[np.arange(len(split)) * 2 + small] = half
        both[np.arange(len(split)) * 2 + 1 - small] = sums[split] - half
        level, sums = np.stack([lefts, lefts + 1], 1).ravel(), both
    return tree


def _segment(rows: DataFrame, spec: Boosting, base: float, cuts: Sequence[np.ndarray], before: list[list[tuple]], rounds: range) -> DataFrame:
    """The trees of some rounds as nodes, learned by tasks that run side by side."""
    bins = max(len(c) for c in cuts) + 1
    shared = rows.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        kept = list(batches)
        own = [np.stack([c.to_numpy() for c in b.columns[:-1]], 1) for b in kept]
        y = np.concatenate([b.columns[-1].to_numpy() for b in kept] or [np.zeros(0)])
        held = Rows(np.concatenate(own) if own else np.zeros((0, len(cuts)), np.int32), y, base)
        alone = len(context.getTaskInfos()) == 1
        for tree in shared.value:
            held.margin += np.array([n[3] for n in tree])[held.leaf_of(tree, spec.depth)]
        out = []
        for round_ in rounds:
            tree = grown(held, spec, round_, bins, None if alone else context)
            held.margin += np.array([n[3] for n in tree])[held.leaf_of(tree, spec.depth)]
            out += [(round_, i, n[6], n[0], float(cuts[n[0]][n[1]]) if n[0] >= 0 else None, n[2], n[3], n[4], n[5], n[1])
                    for i, n in enumerate(tree)]
        if context.partitionId() == 0 and out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = ["tree", "node", "depth", "feature", "threshold", "left", "value", "gain", "cover", "last"]
    i32, f64 = pa.int32(), pa.float64()
    types = [i32, i32, i32, i32, f64, i32, f64, f64, f64, i32]
    return rows.mapInArrow(run, f"{NODE_SCHEMA}, last int", barrier=True)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A folder that was written to its end, or nothing."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return None
    return found if found.count() else None


def _begun(rows: DataFrame, spec: Boosting, features: Sequence[str], target: str, path: str) -> tuple[DataFrame, dict]:
    """Binned rows and what was decided before the first round; taken from ``path`` if they are there."""
    spark = rows.sparkSession
    known = _read(spark, f"{path}/start")
    if known is None:
        cuts = cut_points(rows.filter(F.col(target).isNotNull()), features, spec.bins)
        binned(rows, features, target, cuts).write.mode("overwrite").parquet(f"{path}/binned")
        kept = spark.read.parquet(f"{path}/binned")
        n, base = kept.agg(F.count("*"), F.avg("y")).first()
        start = {"spec": asdict(spec), "features": list(features), "target": target, "rows": n, "base": base or 0.0,
                 "cuts": [c.tolist() for c in cuts]}
        spark.createDataFrame([(json.dumps(start),)], "start string").coalesce(1).write.mode("overwrite").parquet(f"{path}/start")
        known = spark.read.parquet(f"{path}/start")
    start = json.loads(known.first()["start"])
    if (start["spec"], start["features"], start["target"]) != (asdict(spec), list(features), target):
        raise ValueError(f"{path} holds the rounds of another model")
    return spark.read.parquet(f"{path}/binned"), start


def fit(
    rows: DataFrame, spec: Boosting, features: Sequence[str], target: str, kind: str,
    path: str | None = None, segment: int = SEGMENT, tasks: int | None = None,
) -> TreeModel:
    """Boosted trees of ``rows``. ``path`` keeps the rounds: a call with the same folder goes on where the last one ended.

    Without rows with a target the model predicts 0.
    """
    spark = rows.sparkSession
    path = path or workspace(spark, "boosting")
    kept, start = _begun(rows, spec, features, target, path)
    cuts = [np.array(c, np.float64) for c in start["cuts"]]
    columns = kept.columns
    dealt = kept.repartition(tasks or -(-max(start["rows"], 1) // ROWS_PER_TASK), *columns).sortWithinPartitions(*columns)
    trees: list[list[tuple]] = []
    for first in range(0, spec.rounds if start["rows"] else 0, segment):
        rounds = range(first, min(first + segment, spec.rounds))
        at = f"{path}/rounds-{first:06}-{rounds.stop:06}"
        done = _read(spark, at)
        if done is None:
            _segment(dealt, spec, start["base"], cuts, trees, rounds).write.mode("overwrite").parquet(at)
            done = spark.read.parquet(at)
        nodes = done.orderBy("tree", "node").toArrow().to_pydict()
        trees += [[] for _ in rounds]
        for tree, *node in zip(*[nodes[c] for c in ("tree", "feature", "last", "left", "value")], strict=True):
            trees[tree].append(tuple(node))
    whole = spark.read.schema(NODE_SCHEMA).parquet(*[
        f"{path}/rounds-{i:06}-{min(i + segment, spec.rounds):06}" for i in range(0, spec.rounds, segment)
    ]) if trees else spark.createDataFrame([], NODE_SCHEMA)
    return TreeModel(kind, whole, list(features), start["base"])
