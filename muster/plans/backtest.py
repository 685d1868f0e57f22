"""Testing a model against every year on record, and correcting for its bias."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.operators.joins import attach_factor
from muster.operators.projection import Predictor, project, project_monthly, project_yearly
from muster.operators.scenarios import spread
from muster.operators.scoring import (
    backtest_footer,
    backtest_metrics,
    backtest_rows,
    correction_factor,
    signed_bias,
)
from muster.operators.series import first_row_per_year


def history_scenarios(history: DataFrame) -> DataFrame:
    """Each year on record as a one-year scenario with that year's own inputs."""
    return history.select(
        "entity",
        F.col("year").alias("start_year"), F.col("year").alias("end_year"),
        F.col("recruitment").alias("recruitments"), "departures",
        F.col("number_employees").alias("initial_employees"),
        F.col("mass_salary").alias("actual"),
    )


def compare_history(history: DataFrame, model: Predictor) -> DataFrame:
    """Actual and predicted pay per year. The actual travels in the scenario row, so no join is
    needed to put the two side by side."""
    scenarios = history_scenarios(history)
    if model.kind == "yearly":
        projected = project_yearly(scenarios, model)
    else:
        projected = project_monthly(scenarios, model)[1]
    return projected.select(
        "entity", F.col("start_year").alias("year"), F.col("initial_employees").alias("employees"),
        "recruitments", "departures", "actual", F.col("Total_Salary").alias("predicted"),
    )


@dataclass(frozen=True)
class Backtest:
    rows: DataFrame
    metrics: DataFrame
    footer: DataFrame


def backtest(history: DataFrame, model: Predictor, by: Sequence[str] = ("entity",)) -> Backtest:
    """Comparison table, its error metrics and its total lines.

    With an ``ordinal`` column (file order) the first row of a repeated year is the one tested.
    """
    if "ordinal" in history.columns:
        history = first_row_per_year(history).drop("ordinal")
    compared = compare_history(history, model)
    return Backtest(
        backtest_rows(compared), backtest_metrics(compared, by), backtest_footer(compared, by)
    )


def bias_factor(history: DataFrame, model: Predictor, by: Sequence[str] = ()) -> DataFrame:
    return correction_factor(signed_bias(compare_history(history, model), by))


def bias_correction(
    scenarios: DataFrame, history: DataFrame, model: Predictor, by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(monthly, yearly) projections whose (already rounded) pay is scaled by one minus the model's mean
    relative error.

    The factor joins the short scenario rows, which are handed out by their own key before they are expanded:
    no period row is ever shuffled by organisation.
    """
    factored = attach_factor(scenarios, bias_factor(history, model, by), by)
    monthly, yearly = project(spread(factored), model)
    monthly = monthly.withColumn("Predicted_Salary", F.expr("Predicted_Salary * factor")).drop("factor")
    yearly = yearly.withColumn("Total_Salary", F.expr("Total_Salary * factor")).drop("factor")
    return monthly, yearly
