"""Quality classifier: a sparse ensemble of rules.

A random forest is grown on labelled statistics; every path from a root to a node becomes a conjunction of thresholds, equal
conjunctions fall together, and a logistic regression with a lasso penalty weighs them. Rules of weight zero go. What is left
is one Spark expression: the logistic function of a sum of ``CASE WHEN`` terms over the statistics.

Trees and weights are learned with MLlib from a bounded sample of labelled rows (``MAX_ROWS``), scores cover all rows and
whole texts. Labels, languages, sources and ids never enter a score. Empty and null texts have all-zero statistics and are
scored like others. Without labels of both kinds the score of every text is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.columns import spare
from muster.llm.statistics import FEATURES, labelled, statistics
from muster.session import stored

#: Labelled rows that are learned from at most.
MAX_ROWS = 20_000
TREES, DEPTH, PENALTY = 24, 4, 0.0005
ACCEPTED = 0.7

#: (feature, above, cut)
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float


def _simple(path: list[tuple[int, bool, float]]) -> Rule:
    """The tightest bound of each feature and side."""
    bounds: dict[tuple[int, bool], float] = {}
    for feature, above, cut in path:
        held = bounds.get((feature, above), cut)
        bounds[feature, above] = max(held, cut) if above else min(held, cut)
    return tuple((FEATURES[f], above, cut) for (f, above), cut in sorted(bounds.items()))


def paths(node, path: tuple = ()) -> list[Rule]:
    """Conjunctions of all nodes below the root of a tree of the fitted forest."""
    own = [_simple(list(path))] if path else []
    if node.subtreeDepth() == 0:
        return own
    split = node.split()
    f, cut = split.featureIndex(), float(split.threshold())
    return own + paths(node.leftChild(), (*path, (f, False, cut))) + paths(node.rightChild(), (*path, (f, True, cut)))


def tests_of(rules: list[Rule]) -> list[tuple[str, bool, float]]:
    """The distinct threshold tests of all rules."""
    return sorted({test for rule in rules for test in rule})


def design(rules: list[Rule], stats: Column) -> Column:
    """Which rules hold, as 1 and 0: one small expression, however many rules there are."""
    tests = tests_of(rules)
    number = {test: k for k, test in enumerate(tests)}
    members = [[number[test] for test in rule] for rule in rules]

    @F.arrow_udf("array<double>")
    def own(rows: pa.Array) -> pa.Array:
        values = {f: np.asarray(rows.field(f)) for f in {f for f, _, _ in tests}}
        passed = np.array([values[f] > cut if above else values[f] <= cut for f, above, cut in tests])
        held = np.empty((len(rows), len(rules)))
        for k, rule in enumerate(members):
            held[:, k] = passed[rule].all(axis=0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(rules), pa.int32()), pa.array(held.ravel()))

    return own(stats)


def fit(
    documents: DataFrame, labels: DataFrame, *, rows: int = MAX_ROWS, trees: int = TREES, depth: int = DEPTH,
    penalty: float = PENALTY, learn: Column | None = None, **names,
) -> Ensemble:
    """An ensemble from ``labels.quality``; ``learn`` tells which ids may be learned from."""
    sample = labelled(documents, labels, "quality", rows, learn=learn, **names)
    own = sample.select("doc_id", "label", statistics(F.col("text")).alias("s"))
    table = stored(own.select("doc_id", "label", F.struct(*[F.col("s")[f].cast("double").alias(f) for f in FEATURES]).alias("s"))
                   .repartition(4, "doc_id").sortWithinPartitions("doc_id"), "labelled")
    n, ones = table.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        share = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
        return Ensemble([], [], float(np.log(share / (1 - share))))
    flat = table.select("label", *[F.col("s")[f].alias(f) for f in FEATURES])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(flat).select("label", "features")
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=256, featureSubsetStrategy="0.5", subsamplingRate=0.7, seed=7,
        minInstancesPerNode=5,
    ).fit(vectors)
    rules = sorted({r for tree in forest._java_obj.trees() for r in paths(tree.rootNode())})
    if not rules:
        return Ensemble([], [], float(np.log(ones / (n - ones))))
    del forest
    held = table.select("label", array_to_vector(design(rules, F.col("s"))).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60, tol=1e-5).fit(held)
    weights = lasso.coefficients.toArray()
    used = np.flatnonzero(np.abs(weights) > 1e-6).tolist()
    return Ensemble([rules[k] for k in used], [float(weights[k]) for k in used], float(lasso.intercept))


def passed(model: Ensemble, stats: Column) -> Column:
    """The outcome of each distinct test of the model's rules, in the order of ``tests_of``."""
    own = [(stats[feature].cast("double"), above, cut) for feature, above, cut in tests_of(model.rules)]
    return F.array(*[value > cut if above else value <= cut for value, above, cut in own]).cast("array<boolean>")


def score(model: Ensemble, outcomes: Column) -> Column:
    """Probability of label 1, from what ``passed`` tells."""
    number = {test: k for k, test in enumerate(tests_of(model.rules))}
    total = F.lit(model.intercept)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        holds = reduce(Column.__and__, [outcomes[number[test]] for test in rule])
        total = total + F.when(holds, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def classify(documents: DataFrame, model: Ensemble, *, text: str = "text", out: str = "quality_score") -> DataFrame:
    """``documents`` with a column ``out`` (one of that name is replaced): the score of label 1."""
    stats, outcomes = spare(documents, "own_statistics"), spare(documents, "own_outcomes")
    own = documents.withColumn(stats, statistics(F.col(text)))
    own = own.withColumn(outcomes, passed(model, F.col(stats)))
    return own.withColumn(out, score(model, F.col(outcomes))).drop(stats, outcomes)
