"""Prediction job over a table of requests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.operators.projection import Predictor, project_monthly_batch
from muster.operators.scenarios import check_requests, split
from muster.operators.series import last_known
from muster.plans.backtest import bias_correction
from muster.schemas import SCENARIO_FIELDS
from muster.sources.documents import result_json
from muster.sources.models import flatten_metrics
from muster.sources.tables import append_history


@dataclass(frozen=True)
class Predictions:
    monthly: DataFrame
    yearly: DataFrame
    refused: DataFrame
    documents: DataFrame


def predict_batch(
    requests: DataFrame, history: DataFrame, model: Predictor, metrics: DataFrame,
    by: Sequence[str] = ("entity",),
) -> Predictions:
    """Check, project, correct for bias and assemble results for every request.

    ``requests`` has ``scenario_id``, the ``by`` columns and the five fields as text; further columns
    (``user_id``) pass through.
    """
    accepted, refused = split(check_requests(requests))
    monthly, yearly = bias_correction(accepted, history, model, by)
    documents = result_json(yearly, flatten_metrics(metrics), accepted.columns)
    return Predictions(monthly, yearly, refused, documents)


def forecast_from_last_known(monthly: DataFrame, moves: DataFrame, year: int, model: Predictor) -> DataFrame:
    """One year of the training-side projection for every organisation, from its headcount of the last month on record.

    ``moves`` has one row per ``entity`` with the year's ``recruitments`` and the ``departures`` of each month.
    """
    opening = last_known(monthly).select("entity", F.col("last_employees").cast("bigint").alias("initial_employees"))
    scenarios = moves.join(opening, "entity").withColumns({"start_year": F.lit(year), "end_year": F.lit(year)})
    return project_monthly_batch(scenarios, model)


def keep_history(
    predictions: Predictions, users: DataFrame, path: str, created_at: Column | None = None,
) -> DataFrame:
    columns = ["scenario_id", "user_id", *SCENARIO_FIELDS, "result_json"]
    return append_history(predictions.documents.select(columns), users, path, created_at)
