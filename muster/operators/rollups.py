"""Grouped and global aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions import money, within_year

YEAR_KEYS = ("entity", "Year")


def yearly_salary(monthly: DataFrame, by: Sequence[str] = YEAR_KEYS) -> DataFrame:
    return monthly.groupBy(*by).agg(
        F.sum("mass_salary").alias("mass_salary"), F.avg("nbemp").alias("nbemp")
    )


def yearly_sum(monthly: DataFrame, value: str, by: Sequence[str] = YEAR_KEYS) -> DataFrame:
    return monthly.groupBy(*by).agg(F.sum(value).alias(value))


def dashboard_summary(historical: DataFrame, by: Sequence[str] = ("entity",)) -> DataFrame:
    return historical.groupBy(*by).agg(
        F.count("*").alias("total_records"),
        F.max("number_employees").cast("bigint").alias("max_employees"),
        F.sum("recruitment").cast("bigint").alias("total_recruitments"),
        F.sum("departures").cast("bigint").alias("total_departures"),
    )


def distinct_codes(employees: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty codes, ascending."""
    return employees.select(column).filter(F.col(column) != "").distinct().orderBy(column)


def distinct_join_years(employees: DataFrame) -> DataFrame:
    years = employees.select(F.year("date_joined").alias("year")).dropna().distinct()
    return years.orderBy(F.desc("year"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Values that break a uniqueness rule."""
    counts = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("rows"))
    return counts.filter("rows > 1")


def avg_monthly_salary(yearly: DataFrame) -> DataFrame:
    return yearly.withColumn("avg_monthly_salary", F.expr(money("mass_salary / 12")))


def movements_of_year(movements: DataFrame, date: str, year: int) -> DataFrame:
    """Year report: the chosen year's records with the date split into its parts."""
    return movements.filter(F.expr(within_year(date, year))).select(
        "matricule",
        F.concat_ws(" ", "first_name", "last_name").alias("full_name"),
        F.dayofmonth(date).alias("day"),
        F.month(date).alias("month"),
        F.year(date).alias("year"),
        F.coalesce(F.nullif("corps", F.lit("")), F.lit("-")).alias("corps"),
        F.coalesce(F.nullif("grade", F.lit("")), F.lit("-")).alias("grade"),
    )


def movement_counts(movements: DataFrame, date: str) -> DataFrame:
    return movements.groupBy(F.year(date).alias("year")).agg(F.count("*").alias("movements"))
