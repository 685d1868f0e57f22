"""Regression trees as tables: binned training rows, one row per node, and scoring inside a Spark expression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One row per node, numbered from 0 within its tree. A row goes to ``left`` if its value is at most ``threshold`` (null counts as
#: less than all numbers, NaN as more), else to the node behind it. Leaves have feature -1.
NODE_SCHEMA = ("tree int, node int, depth int, feature int, threshold double, left int, value double, gain double, cover double")


def cut_points(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Ascending candidate thresholds of every feature: the distinct ones of its ``bins`` quantiles, values that occur.

    One pass; what reaches the driver is ``bins`` numbers a feature.
    """
    fractions = F.array(*[F.lit((i + 0.5) / bins) for i in range(bins)])
    found = rows.agg(*[
        F.percentile_approx(F.col(c).cast("double"), fractions, 100 * bins).alias(f"q{i}") for i, c in enumerate(features)
    ]).first()
    return [np.unique(np.array([v for v in found[f"q{i}"] or [] if v == v], np.float64)) for i in range(len(features))]


def binned(rows: DataFrame, features: Sequence[str], target: str, cuts: Sequence[np.ndarray]) -> DataFrame:
    """(x0, x1, ..., y): how many candidate thresholds lie below each value; rows without a target are left out.

    Null is below all of them and NaN above.
    """
    names = [f"x{i}" for i in range(len(features))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for column, at in zip(batch.columns, cuts):
                known = column.is_valid().to_numpy(zero_copy_only=False)
                places = np.searchsorted(at, column.fill_null(0.0).to_numpy(), "left")
                columns.append(pa.array(np.where(known, places, 0).astype(np.int32)))
            yield pa.record_batch([*columns, batch.columns[-1]], [*names, "y"])

    values = [F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)]
    known = rows.filter(F.col(target).isNotNull()).select(*values, F.col(target).cast("double").alias("y"))
    return known.mapInArrow(place, ", ".join(f"{n} int" for n in names) + ", y double")


def _arrays(nodes: DataFrame) -> DataFrame:
    """The whole table as one row of arrays, children and roots by their place in them."""
    order = Window.partitionBy().orderBy("tree", "node")
    at = nodes.withColumn("at", F.row_number().over(order) - 1)
    fields = {"feature": F.col("feature"), "threshold": F.col("threshold"), "left": F.col("left") + F.col("at") - F.col("node"),
              "value": F.col("value")}
    sorted_ = F.array_sort(F.collect_list(F.struct("at", *[c.alias(n) for n, c in fields.items()]))).alias("n")
    roots = F.array_sort(F.collect_list(F.when(F.col("node") == 0, F.col("at")))).alias("root")
    whole = at.agg(sorted_, roots, F.max("depth").alias("depth"))
    return whole.select(F.struct(*[F.col("n")[n].alias(n) for n in fields], "root", F.coalesce("depth", F.lit(0)).alias("depth")).alias("m"))


def walked(nodes: DataFrame, features: Sequence[str], base: float, mean: bool) -> tuple[Column, Column]:
    """(model, prediction): a scalar that holds the node arrays, and the walk through them of a row that has it as ``_m``.

    Trees are added up in order, from ``base``; ``mean`` divides by their number.
    """
    x = ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in features)
    step = "IF(_m.feature[n] < 0, n, _m.left[n] + IF(coalesce(_x[_m.feature[n]] > _m.threshold[n], false), 1, 0))"
    leaf = f"aggregate(sequence(1, greatest(_m.depth, 1)), r, (n, i) -> {step})"
    total = f"aggregate(_m.root, CAST({base!r} AS DOUBLE), (s, r) -> s + _m.value[{leaf}])"
    if mean:
        total = f"try_divide({total}, size(_m.root))"
    return _arrays(nodes).scalar(), F.expr(f"transform(array(array({x})), _x -> {total})[0]")


@dataclass(frozen=True)
class TreeModel:
    """Predictor whose trees are a table of nodes; ``mean`` for forests, sums from ``base`` for boosting.

    The nodes become one literal of the plan, about 30 bytes each, so a model is what may be broadcast: boosted trees are bounded
    by rounds and depth, a forest by trees and training rows.
    """

    kind: str
    nodes: DataFrame
    features: Sequence[str]
    base: float = 0.0
    mean: bool = False

    def predict(self, rows: DataFrame) -> DataFrame:
        model, prediction = walked(self.nodes, self.features, self.base, self.mean)
        return rows.withColumn("_m", model).withColumn("prediction", prediction).drop("_m")

    def importance(self, spark: SparkSession) -> DataFrame:
        """Each feature's part of the gain of all splits; a model without splits has none."""
        names = spark.createDataFrame(list(enumerate(self.features)), "id int, feature string")
        gains = self.nodes.filter("feature >= 0").groupBy(F.col("feature").alias("id")).agg(F.sum("gain").alias("gain"))
        rows = names.join(gains, "id", "left").select("feature", F.coalesce("gain", F.lit(0.0)).alias("gain"))
        total = gains.agg(F.sum("gain")).scalar()
        return rows.select("feature", F.coalesce(F.try_divide("gain", total), F.lit(0.0)).alias("importance"))
