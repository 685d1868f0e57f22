"""Saved models: one folder holds the pipeline, or the nodes of trees, and their description."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.projection import TrainedModel
from muster.operators.trees import TreeModel
from muster.schemas import METRIC_FIELDS

DEFAULT_METRICS = {"r2": 0.0, "mse": 0.0, "mape": 0.0}


def save_model(model: TrainedModel | TreeModel, metrics: DataFrame, path: str) -> None:
    """Write pipeline or nodes, then kind, features and metrics.

    ``metrics`` is one row, flat (``r2, mse, ...``) or nested (``monthly``, ``yearly`` structs). The
    description comes last, so a folder that has one is complete.
    """
    trees = isinstance(model, TreeModel)
    if trees:
        model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    else:
        model.pipeline.write().overwrite().save(f"{path}/pipeline")
    description = metrics.select(
        F.lit(model.kind).alias("kind"),
        F.array(*[F.lit(f) for f in model.features]).alias("features"),
        F.struct(*metrics.columns).alias("metrics"),
        F.lit(trees).alias("trees"),
        F.lit(model.base if trees else 0.0).alias("base"),
        F.lit(trees and model.mean).alias("mean"),
    )
    description.coalesce(1).write.mode("overwrite").parquet(f"{path}/description")


def _description(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/description")
    except AnalysisException:
        return None


def load_model(spark: SparkSession, yearly_path: str, monthly_path: str) -> TrainedModel | TreeModel:
    """The yearly model if there is one, else the monthly one; its ``kind`` tells which."""
    for path in (yearly_path, monthly_path):
        found = _description(spark, path)
        if found is not None:
            row = found.select("kind", "features", "trees", "base", "mean").first()
            if row["trees"]:
                nodes = spark.read.parquet(f"{path}/nodes")
                return TreeModel(row["kind"], nodes, list(row["features"]), row["base"], row["mean"])
            return TrainedModel(row["kind"], PipelineModel.load(f"{path}/pipeline"), list(row["features"]))
    raise FileNotFoundError(f"no model at {yearly_path} or {monthly_path}")


def load_metrics(spark: SparkSession, yearly_path: str, monthly_path: str) -> DataFrame:
    """Stored metrics of the model that would be loaded; zeros where none can be read."""
    for path in (yearly_path, monthly_path):
        found = _description(spark, path)
        if found is not None:
            return found.select("metrics.*")
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in DEFAULT_METRICS.items()])


def flatten_metrics(metrics: DataFrame) -> DataFrame:
    """Both stored shapes as the six served figures: R2 to 4 places, the rest to 2, missing as 0."""
    nested = "monthly" in metrics.columns

    def figure(name: str):
        part, field = name.split("_", 1)
        if nested:
            present = part in metrics.columns and field in metrics.schema[part].dataType.fieldNames()
            value = F.col(f"{part}.{field}") if present else F.lit(0.0)
        else:
            value = F.col(field) if part == "monthly" and field in metrics.columns else F.lit(0.0)
        return F.round(F.coalesce(value, F.lit(0.0)), 4 if field == "r2" else 2).alias(name)

    return metrics.select(*[figure(name) for name in METRIC_FIELDS])
