"""Training jobs: sources -> features -> split -> fit -> evaluate -> save."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.operators import joins, regression, rollups, scoring, series
from muster.operators.projection import Predictor, TrainedModel
from muster.operators.regression import ModelSpec
from muster.operators.trees import TreeModel
from muster.schemas import TARGET
from muster.sources.models import save_model


@dataclass(frozen=True)
class Training:
    model: TrainedModel | TreeModel
    scored: DataFrame
    metrics: DataFrame


def yearly_frame(salary: DataFrame, departures: DataFrame, recruitments: DataFrame) -> DataFrame:
    """Monthly sources to the yearly feature frame."""
    merged = joins.merge_yearly(
        rollups.yearly_salary(salary),
        rollups.yearly_sum(departures, "nb_departures"),
        rollups.yearly_sum(recruitments, "Recruitments"),
    )
    return series.yearly_features(merged)


def monthly_frame(salary: DataFrame, departures: DataFrame, recruitments: DataFrame) -> DataFrame:
    return series.monthly_features(joins.merge_monthly_left(departures, recruitments, salary))


def merged_frame(salary: DataFrame, departures: DataFrame, recruitments: DataFrame) -> DataFrame:
    return joins.merge_monthly_left(departures, recruitments, salary)


def inner_frame(salary: DataFrame, departures: DataFrame, recruitments: DataFrame) -> DataFrame:
    """Months all three sources have; every column but the target is a feature."""
    return joins.merge_monthly_inner(departures, recruitments, salary)


def export_frame(salary: DataFrame, departures: DataFrame, recruitments: DataFrame) -> DataFrame:
    return series.export_features(joins.merge_monthly_left(departures, recruitments, salary))


def evaluate(rows: DataFrame, model: Predictor) -> DataFrame:
    """Rows with ``actual`` and ``predicted`` (as the model gives it, not floored at 0)."""
    return model.predict(rows).withColumn("actual", F.col(TARGET)).withColumnRenamed("prediction", "predicted")


def train_yearly(
    frame: DataFrame, spec: ModelSpec = regression.GBT_YEARLY, path: str | None = None,
) -> Training:
    """Fit and evaluate on the same rows; flat metrics. ``path`` lets a job that was killed go on where it ended."""
    model = regression.fit(frame, spec, path=path)
    scored = evaluate(frame, model)
    metrics = scoring.regression_metrics(scored).select("r2", "mse", "rmse", "mae", "mape")
    return Training(model, scored, metrics)


def train_holdout(
    frame: DataFrame, spec: ModelSpec, chronological: bool = True, scale_on_all: bool = False,
    path: str | None = None,
) -> Training:
    """Fit on four fifths and evaluate on the rest; nested monthly and yearly metrics. ``path`` as in ``train_yearly``."""
    order = ["Year", "Month"]
    halves = (
        series.split_chronological(frame, order) if chronological
        else series.split_random(frame, ["entity", *order])
    )
    train = halves.filter("split = 'train'")
    model = regression.fit(train, spec, scale_on=frame if scale_on_all else None, path=path)
    scored = evaluate(halves.filter("split = 'test'"), model)
    yearly = scoring.predictions_to_yearly(scored.withColumnRenamed("predicted", "predicted_salary"))
    monthly_part = scoring.regression_metrics(scored).select(F.struct("mse", "rmse", "mae", "r2").alias("monthly"))
    yearly_part = scoring.regression_metrics(
        yearly, "actual_yearly_salary", "predicted_yearly_salary"
    ).select(F.struct("mse", "r2"))
    metrics = monthly_part.withColumn("yearly", yearly_part.scalar())
    return Training(model, scored, metrics)


def train_report(scored: DataFrame) -> DataFrame:
    """Actual, predicted and error percent per row, with an average line."""
    error = F.abs(F.try_divide(F.col("predicted") - F.col("actual"), F.col("actual"))) * 100
    rows = scored.select(
        "entity", F.col("Year").cast("string").alias("line"), "actual", "predicted",
        error.alias("error_percent"),
    )
    average = rows.agg(F.avg("error_percent").alias("error_percent")).select(
        F.lit(None).cast("int").alias("entity"), F.lit("AVERAGE").alias("line"),
        F.lit(None).cast("double").alias("actual"), F.lit(None).cast("double").alias("predicted"),
        "error_percent",
    )
    return rows.unionByName(average)


def train_and_save(training: Training, path: str) -> DataFrame:
    """Store model and metrics together; returns the metrics."""
    save_model(training.model, training.metrics, path)
    return training.metrics
