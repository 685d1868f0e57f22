"""JSON results and chart series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions import money
from muster.schemas import METRIC_FIELDS

PREDICTION_TYPE = "array<struct<Year:int,Total_Salary:double,End_Employees:bigint>>"
RESULT_SCHEMA = (
    f"status: string, predictions: {PREDICTION_TYPE}, graph: string, "
    f"metrics: struct<{', '.join(f'{m}: double' for m in METRIC_FIELDS)}>"
)


def result_json(yearly: DataFrame, metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One result document per scenario: status, its years in order, and the model's metrics.

    A checked scenario has at most 21 years, which bounds the list. The metrics are one row, taken as
    a subquery.
    """
    year = F.struct("Year", "Total_Salary", "End_Employees")
    model = metrics.select(F.struct(*METRIC_FIELDS)).scalar()
    document = F.struct(
        F.lit("success").alias("status"),
        F.sort_array(F.collect_list(year)).alias("predictions"),
        model.alias("metrics"),
    )
    return yearly.groupBy(*keys).agg(F.to_json(document).alias("result_json"))


def parse_result(history: DataFrame) -> DataFrame:
    """Stored JSON as the struct ``result``; text that is not exactly one JSON document gives NULL
    fields. ``has_graph`` tells if a drawing is kept.

    Spark's JSON functions read the first value and ignore what follows it; as the only element of an
    array a value with trailing text is malformed.
    """
    wrapped = F.concat(F.lit("["), "result_json", F.lit("]"))
    parsed = F.from_json(wrapped, f"array<struct<{RESULT_SCHEMA}>>", {"allowSingleQuotes": "false"})
    one = history.withColumn("_parsed", parsed)
    return one.withColumn("result", F.when(F.size("_parsed") == 1, F.get("_parsed", 0))).withColumn(
        "has_graph", F.coalesce(F.col("result.graph") != "", F.lit(False))
    ).drop("_parsed")


def chart_series(historical: DataFrame) -> DataFrame:
    """The dashboard's six series in long form: (entity, series, label, value)."""
    average = F.expr(money("try_divide(mass_salary, number_employees)"))
    series = {
        "salary": F.col("mass_salary"),
        "employees": F.col("number_employees"),
        "departures": F.col("departures"),
        "recruitments": F.col("recruitment"),
        "avg_salary_by_year": average,
        "departures_by_year": F.col("departures"),
    }
    cells = [F.lit(x) if isinstance(x, str) else x.cast("double") for pair in series.items() for x in pair]
    label = F.col("year").cast("string").alias("label")
    return historical.select("entity", label, F.stack(F.lit(len(series)), *cells).alias("series", "value"))


def chart_json(series: DataFrame) -> DataFrame:
    """``{labels, values}`` per series, in year order (one element per year on record)."""
    points = F.sort_array(F.collect_list(F.struct("label", "value")))
    return series.groupBy("entity", "series").agg(points.alias("p")).select(
        "entity", "series",
        F.to_json(F.struct(
            F.col("p.label").alias("labels"), F.col("p.value").alias("values")
        )).alias("chart"),
    )
