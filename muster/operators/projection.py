"""Projecting pay and headcount for whole tables of scenarios.

The yearly engine needs no shuffle. A scenario row is expanded to the years its model must score (all
up to 2020, or just the first) and scored; the last of those carries the years that follow it, whose
pay is folded inside the row, each from the year before. Expanding last keeps the fold at one step
per year.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions import half_even, money, month_name, period_label
from muster.operators.scenarios import NET, expand_months, headcount
from muster.schemas import (
    ANNUAL_GROWTH_RATE,
    AVG_SALARY_PER_EMPLOYEE,
    HEADCOUNT_ELASTICITY,
    LAST_KNOWN_YEAR,
)


class Predictor(Protocol):
    """Anything that adds ``prediction`` to rows holding its feature columns."""

    kind: str

    def predict(self, rows: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class LinearFormula:
    """Linear predictor whose coefficients are a one-row table (``intercept`` and the features)."""

    kind: str
    coefficients: DataFrame
    features: Sequence[str]

    def predict(self, rows: DataFrame) -> DataFrame:
        fitted = self.coefficients.select(F.struct("intercept", *self.features).alias("fit"))
        total = " + ".join([*[f"{c} * _fit.{c}" for c in self.features], "_fit.intercept"])
        scored = rows.withColumn("_fit", fitted.scalar()).withColumn("prediction", F.expr(total))
        return scored.drop("_fit")


@dataclass(frozen=True)
class TrainedModel:
    """Predictor backed by a fitted ML pipeline (scaler, assembler and regressor together)."""

    kind: str
    pipeline: PipelineModel
    features: Sequence[str]

    def predict(self, rows: DataFrame) -> DataFrame:
        scored = self.pipeline.transform(rows)
        return scored.select(*rows.columns, "prediction")


def score(rows: DataFrame, model: Predictor) -> DataFrame:
    """Predictions, never negative."""
    predicted = model.predict(rows)
    return predicted.withColumn("prediction", F.greatest(F.lit(0.0), "prediction"))


def clamp_model_year(rows: DataFrame, year: str = "Year") -> DataFrame:
    """Year as the model sees it: nothing past its training range."""
    return rows.withColumn("model_year", F.least(F.col(year), F.lit(LAST_KNOWN_YEAR)))


def yearly_model_rows(scenarios: DataFrame) -> DataFrame:
    """One row per year the model scores, with its features, for the yearly engine."""
    last_scored = f"greatest(start_year, least(end_year, {LAST_KNOWN_YEAR}))"
    rows = scenarios.withColumn("base_year", F.expr(f"explode(sequence(start_year, {last_scored}))"))
    return rows.withColumns({
        "nbemp": F.expr(headcount("base_year")),
        "Year": F.expr(f"least(base_year, {LAST_KNOWN_YEAR})"),
        "nb_departures": F.col("departures"),
        "Recruitments": F.col("recruitments"),
        "net_change": F.expr(NET),
    })


def project_yearly(scenarios: DataFrame, model: Predictor) -> DataFrame:
    """Yearly pay: the model up to 2020, then growth and headcount change on the year before.

    Returns the scenario columns, ``Year``, ``employees`` (start of year), ``salary`` (unrounded),
    ``Total_Salary`` and ``End_Employees``.
    """
    scored = score(yearly_model_rows(scenarios), model)
    growth = 1 + ANNUAL_GROWTH_RATE
    ahead = f"nbemp * ({AVG_SALARY_PER_EMPLOYEE!r}D * power({growth!r}D, start_year - {LAST_KNOWN_YEAR}))"
    rows = scored.withColumns({
        "anchor": F.expr(f"CASE WHEN start_year > {LAST_KNOWN_YEAR} THEN {ahead} ELSE prediction END"),
        "last_year": F.expr(f"CASE WHEN base_year >= {LAST_KNOWN_YEAR} THEN end_year ELSE base_year END"),
    })
    # y runs over the years after the base year; the year's opening count less the change is the count before.
    before = f"({headcount('y')} - net_change)"
    factor = f"{growth!r}D + CASE WHEN {before} > 0 THEN net_change / {before} ELSE 0D END * {HEADCOUNT_ELASTICITY!r}D"
    path = (
        "aggregate(slice(sequence(base_year, last_year), 2, cast(last_year - base_year AS INT)),"
        " array(greatest(0D, anchor)),"
        f" (paid, y) -> array_append(paid, greatest(0D, element_at(paid, -1) * ({factor}))))"
    )
    paid = rows.select(*scenarios.columns, "base_year", "net_change", F.expr(f"posexplode({path}) AS (pos, salary)"))
    return paid.withColumn("Year", F.expr("cast(base_year + pos AS INT)")).select(
        *scenarios.columns,
        "Year",
        F.expr(f"{headcount('Year')} AS employees"),
        "salary",
        F.expr(f"{money('salary')} AS Total_Salary"),
        F.expr(f"{half_even(headcount('Year') + ' + net_change')} AS End_Employees"),
    )


def monthly_split(yearly: DataFrame) -> DataFrame:
    """Yearly projections spread over the months: equal pay, headcount interpolated."""
    employees = f"employees + (Month - 1) * ({NET} / 12)"
    kept = [c for c in yearly.columns if c not in ("employees", "salary", "Total_Salary", "End_Employees")]
    return expand_months(yearly).select(
        *kept, "Month",
        F.expr(f"{month_name('Month')} AS Month_Name"),
        F.expr(f"{money('salary / 12')} AS Predicted_Salary"),
        F.expr(f"{half_even(employees)} AS Employees"),
    )


def monthly_walk(scenarios: DataFrame, floor: int, monthly_departures: str) -> DataFrame:
    """One row per scenario month with the month's headcount and the monthly model's features.

    Hires arrive in January, departures leave every month and the count never falls below ``floor``.
    A year's opening counts are folded over the scenario's own years (at most 21), the twelve months
    are written out, and both subtract month by month as a planner would, so half-way roundings fall
    the same way. No row leaves its task.
    """
    def after(opening: str, months: int) -> str:
        """Headcount left after that many of the year's months."""
        left = f"({opening} + cast(recruitments AS DOUBLE))"
        for _ in range(months):
            left = f"greatest({floor}D, {left} - nb_departures)"
        return left

    opening = (
        "aggregate(sequence(start_year, end_year), array(cast(initial_employees AS DOUBLE)),"
        f" (acc, y) -> array_append(acc, {after('element_at(acc, -1)', 12)}))"
    )
    yearly = scenarios.withColumn("nb_departures", F.expr(f"cast({monthly_departures} AS DOUBLE)"))
    yearly = yearly.select("*", F.expr(f"posexplode(slice({opening}, 1, cast(end_year - start_year + 1 AS INT)))"))

    # left_m: staff after month m; net_m: net change of the year so far.
    steps = {"left_0": "col + cast(recruitments AS DOUBLE)", "net_0": "cast(recruitments AS DOUBLE)"}
    for m in range(1, 13):
        steps[f"left_{m}"] = f"greatest({floor}D, left_{m - 1} - nb_departures)"
        steps[f"net_{m}"] = f"net_{m - 1} - nb_departures"
    months = ", ".join(
        f"named_struct('Month', {m}, 'nbemp', greatest({floor}D, left_{m - 1}),"
        f" 'cumulative_net_change', net_{m}, 'left', left_{m})"
        for m in range(1, 13)
    )
    return (
        yearly.selectExpr("*", *[f"{sql} AS {name}" for name, sql in steps.items()])
        .selectExpr(
            *scenarios.columns, "nb_departures", "cast(start_year + pos AS INT) AS Year",
            "cast(recruitments AS DOUBLE) AS cumulative_recruitments", f"inline(array({months}))",
        )
    )


def project_monthly(scenarios: DataFrame, model: Predictor) -> tuple[DataFrame, DataFrame]:
    """Fallback engine: the model scores every month. Returns (monthly, yearly) projections."""
    walk = monthly_walk(scenarios, floor=1, monthly_departures="departures / 12")
    scored = score(walk, model)
    monthly = scored.select(
        *scenarios.columns, "Year", "Month",
        F.expr(f"{month_name('Month')} AS Month_Name"),
        F.expr(f"{money('prediction')} AS Predicted_Salary"),
        F.expr(f"{half_even('nbemp')} AS Employees"),
    )
    yearly = _year_totals(scored, scenarios.columns).select(
        *scenarios.columns, "Year", "salary",
        F.expr(f"{money('salary')} AS Total_Salary"),
        F.expr(f"{half_even('left')} AS End_Employees"),
    )
    return monthly, yearly


def project_monthly_batch(scenarios: DataFrame, model: Predictor) -> DataFrame:
    """Training-side variant: ``departures`` is per month, the floor is 0, headcount stays exact."""
    scored = score(monthly_walk(scenarios, floor=0, monthly_departures="departures"), model)
    return _year_totals(scored, scenarios.columns).select(
        *scenarios.columns, "Year",
        F.expr(f"{money('salary')} AS total_yearly_salary"),
        F.expr(f"{money('salary / 12')} AS avg_monthly_salary"),
        F.col("left").alias("employees_end_of_year"),
    )


def _year_totals(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of the year's months and December's headcount; a scenario's months sit in one task, so
    twelve rows become one before the shuffle."""
    december = F.max(F.when(F.col("Month") == 12, F.col("left")))
    return scored.groupBy(*keys, "Year").agg(
        F.sum("prediction").alias("salary"), december.alias("left")
    )


def project(scenarios: DataFrame, model: Predictor) -> tuple[DataFrame, DataFrame]:
    """(monthly, yearly) projections by the engine the model is made for."""
    if model.kind == "yearly":
        yearly = project_yearly(scenarios, model)
        return monthly_split(yearly), yearly.drop("employees")
    return project_monthly(scenarios, model)


def tick_thinning(monthly: DataFrame) -> DataFrame:
    """Axis labels of a scenario's monthly series: every ``max(1, n // 12)``-th period.

    Position and length follow from the scenario's own years, so no window is needed.
    """
    at = "(Year - start_year) * 12 + Month - 1"
    n = "(end_year - start_year + 1) * 12"
    labelled = monthly.withColumn("Period", F.expr(period_label("Year", "Month")))
    return labelled.filter(f"({at}) % greatest(1, {n} div 12) = 0")

