"""Dashboard and employee listing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions import money
from muster.operators.employees import (
    filter_corps_grade,
    filter_join_year,
    filter_status,
    search_employees,
)
from muster.operators.rollups import dashboard_summary, distinct_codes, distinct_join_years
from muster.sources.documents import chart_series


def avg_salary(historical: DataFrame) -> DataFrame:
    value = F.expr(money("try_divide(mass_salary, number_employees)"))
    return historical.withColumn("avg_salary", value)


def salary_thousands(historical: DataFrame) -> DataFrame:
    return historical.withColumn("salary_thousands", F.col("mass_salary") / 1000)


@dataclass(frozen=True)
class Dashboard:
    series: DataFrame
    summary: DataFrame


def dashboard(historical: DataFrame) -> Dashboard:
    return Dashboard(chart_series(historical), dashboard_summary(historical))


def employee_listing(
    employees: DataFrame,
    search: str | None = None,
    corps: str | None = None,
    grade: str | None = None,
    status: str | None = None,
    year: int | None = None,
) -> DataFrame:
    """All filters that are given, AND-composed into one scan."""
    found = filter_corps_grade(search_employees(employees, search), corps, grade)
    return filter_join_year(filter_status(found, status), year)


def listing_choices(employees: DataFrame) -> dict[str, DataFrame]:
    """Values offered by the listing's drop-downs."""
    return {
        "corps": distinct_codes(employees, "corps"),
        "grade": distinct_codes(employees, "grade"),
        "year": distinct_join_years(employees),
    }
