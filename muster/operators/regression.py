"""Salary models: lines on MLlib, boosted trees and forests as tables of nodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators import boosting, forest
from muster.operators.boosting import Boosting
from muster.operators.forest import Forest
from muster.operators.projection import TrainedModel
from muster.operators.trees import TreeModel
from muster.schemas import EXPORT_FEATURES, MONTHLY_FEATURES, TARGET, YEARLY_FEATURES


@dataclass(frozen=True)
class ModelSpec:
    """What to fit: engine kind, estimator, features (empty = all but the target) and parameters."""

    kind: str
    estimator: type
    features: Sequence[str] = ()
    params: Mapping[str, Any] = field(default_factory=dict)

    def with_params(self, **params: Any) -> ModelSpec:
        return ModelSpec(self.kind, self.estimator, self.features, {**self.params, **params})


# Hyper-parameters of the salary models.
LINEAR = ModelSpec("monthly", LinearRegression, (), {"solver": "normal", "regParam": 0.0})
FOREST = ModelSpec("monthly", Forest, (), {"trees": 200, "seed": 42})
GBT_MONTHLY = ModelSpec("monthly", Boosting, MONTHLY_FEATURES, {
    "rounds": 800, "rate": 0.05, "depth": 5, "child_weight": 2.0, "rows": 0.85, "columns": 0.85, "alpha": 0.05, "lam": 0.5,
})
GBT_EXPORT = ModelSpec("monthly", Boosting, EXPORT_FEATURES, {
    "rounds": 300, "rate": 0.05, "depth": 6, "rows": 0.8, "columns": 0.8,
})
GBT_YEARLY = ModelSpec("yearly", Boosting, YEARLY_FEATURES, {
    "rounds": 100, "rate": 0.1, "depth": 3, "child_weight": 2.0, "rows": 0.8, "columns": 0.8, "alpha": 0.1, "lam": 1.0,
})


def select_features(df: DataFrame, features: Sequence[str], target: str = TARGET) -> DataFrame:
    return df.select("entity", *features, target)


def other_columns(df: DataFrame, drop: Sequence[str] = ("entity", "split"), target: str = TARGET) -> list[str]:
    """Feature set 'everything but the target'."""
    return [c for c in df.columns if c != target and c not in drop]


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores by population deviation; a constant column becomes 0."""
    stats = df.agg(F.struct(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"dev_{c}") for c in columns],
    ).alias("s"))

    scaled = {
        c: F.expr(f"({c} - _s.mean_{c}) / CASE WHEN _s.dev_{c} = 0 THEN 1D ELSE _s.dev_{c} END") for c in columns
    }
    return df.withColumn("_s", stats.scalar()).withColumns(scaled).drop("_s")


def scaling_stage(train: DataFrame, features: Sequence[str]) -> SQLTransformer:
    """The same z-score as a pipeline stage, its statistics (one row) fixed at fit time."""
    row = train.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in features],
        *[F.stddev_pop(c).alias(f"dev_{c}") for c in features],
    ).first()
    scaled = ", ".join(
        f"(CAST({c} AS DOUBLE) - {float(row[f'mean_{c}'])!r}D) / {float(row[f'dev_{c}'] or 1.0)!r}D AS scaled_{c}"
        for c in features
    )
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


def fit(train: DataFrame, spec: ModelSpec, scale_on: DataFrame | None = None, path: str | None = None) -> TrainedModel | TreeModel:
    """Fit scaler, assembler and regressor as one pipeline, or trees, which need neither.

    The scaler learns from the training rows; pass the whole frame as ``scale_on`` to scale on it (trees split between values, so
    scaling changes none of them). ``path`` keeps the rounds of boosting for a job that is started again.
    """
    features = list(spec.features) or other_columns(train)
    if spec.estimator is Boosting:
        return boosting.fit(train, Boosting(**spec.params), features, TARGET, spec.kind, path)
    if spec.estimator is Forest:
        return forest.fit(train, Forest(**spec.params), features, TARGET, spec.kind)
    rows = train.select(*features, F.col(TARGET).cast("double").alias(TARGET)).persist()
    try:
        stages = [
            scaling_stage(rows if scale_on is None else scale_on, features),
            VectorAssembler(inputCols=[f"scaled_{c}" for c in features], outputCol="features"),
            spec.estimator(featuresCol="features", labelCol=TARGET, **spec.params),
        ]
        return TrainedModel(spec.kind, Pipeline(stages=stages).fit(rows), features)
    finally:
        rows.unpersist()


def coefficients(spark: SparkSession, model: TrainedModel) -> DataFrame:
    """Weight of each (scaled) feature of a linear model, and its intercept."""
    regressor = model.pipeline.stages[-1]
    weights = [(f, float(w)) for f, w in zip(model.features, regressor.coefficients)]
    return spark.createDataFrame(
        [*weights, ("intercept", float(regressor.intercept))], "feature string, coefficient double"
    )


def rank_importance(spark: SparkSession, model: TreeModel) -> DataFrame:
    """Features of a tree model by their part of all gain, highest first."""
    return model.importance(spark).orderBy(F.desc("importance"), "feature")


def fit_line(df: DataFrame, x: str, y: str = TARGET) -> DataFrame:
    """One-row table (``x``, ``intercept``) of the least-squares line, for a ``LinearFormula``."""
    return df.agg(
        F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias(x),
        F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
    )
