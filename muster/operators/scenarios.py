"""Planning scenarios: checking requests and expanding them to periods.

A scenario is one row, and everything here is computed inside that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions import half_even, parse_int
from muster.operators.clean import computed
from muster.operators.intake import first_failure
from muster.schemas import (
    END_BEFORE_START,
    INVALID_START,
    MAX_SPAN_YEARS,
    MISSING_FIELDS,
    NEGATIVE_VALUES,
    NOT_NUMERIC,
    NO_EMPLOYEES,
    SCENARIO_FIELDS,
    SPAN_TOO_LONG,
)


def missing_fields(requests: DataFrame) -> DataFrame:
    """Comma list of the required fields a request leaves out ('' when complete)."""
    absent = [F.when(F.col(c).isNull(), c) for c in SCENARIO_FIELDS]
    return requests.withColumn("missing", F.concat_ws(", ", *absent))


def parse_ints(requests: DataFrame) -> DataFrame:
    """The five fields as whole numbers; ``numeric`` is false if any cannot be read."""
    parsed = computed(requests, {c: parse_int(c) for c in SCENARIO_FIELDS})
    numeric = F.lit(True)
    for c in SCENARIO_FIELDS:
        numeric = numeric & F.col(c).isNotNull()
    return parsed.withColumn("numeric", numeric)


def rule_message() -> Column:
    """Message of the first planning rule a typed scenario breaks, NULL if none."""
    start, end = F.col("start_year"), F.col("end_year")
    negative = (F.col("recruitments") < 0) | (F.col("departures") < 0) | (F.col("initial_employees") < 0)
    return first_failure(
        (~start.between(2000, 2100), INVALID_START),
        (end < start, END_BEFORE_START),
        (end - start > MAX_SPAN_YEARS, SPAN_TOO_LONG),
        (negative, NEGATIVE_VALUES),
        (F.col("initial_employees") == 0, NO_EMPLOYEES),
    )


def validate(scenarios: DataFrame) -> DataFrame:
    checked = scenarios.withColumn("message", rule_message())
    return checked.withColumn("ok", F.col("message").isNull())


def check_requests(requests: DataFrame) -> DataFrame:
    """Text requests to typed scenarios with ``ok`` and the message a caller would see.

    ``scenario_id`` is a request's identity: without one, or with one that another request has too, it is
    refused, so every request ends in one result or one message.
    """
    keys = requests.groupBy("scenario_id").agg(F.count("*").alias("times")).filter("times > 1 AND scenario_id IS NOT NULL")
    listed = parse_ints(missing_fields(requests)).join(keys, "scenario_id", "left").select(*requests.columns, "missing", "numeric", "times")
    message = (
        F.when(F.col("scenario_id").isNull(), "Invalid scenario_id")
        .when(F.col("times").isNotNull(), "Repeated scenario_id")
        .when(F.col("missing") != "", F.concat(F.lit(MISSING_FIELDS), F.col("missing")))
        .when(~F.col("numeric"), NOT_NUMERIC)
        .otherwise(rule_message())
    )
    checked = listed.withColumn("message", message).drop("missing", "numeric", "times")
    return checked.withColumn("ok", F.col("message").isNull())


def branch(checked: DataFrame) -> DataFrame:
    """Where each checked request goes (``branch``: predict or refuse), in one pass."""
    return checked.withColumn("branch", F.when(F.col("ok"), "predict").otherwise("refuse"))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted scenarios, refused ones with their message)."""
    return checked.filter("ok").drop("ok", "message"), checked.filter("NOT ok").drop("ok")


def spread(scenarios: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Hand scenarios out to every core before they are expanded.

    A scenario is one short row and becomes up to 252; a table of them read from one file would be
    expanded by one task. The same holds for other short rows of a unique ``key`` that cost much work.
    """
    spark = scenarios.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return scenarios.repartition(tasks, key)


def expand_years(scenarios: DataFrame, name: str = "Year") -> DataFrame:
    years = F.sequence(F.col("start_year"), F.col("end_year")).cast("array<int>")
    return scenarios.withColumn(name, F.explode(years))


def expand_months(yearly: DataFrame) -> DataFrame:
    months = F.explode(F.sequence(F.lit(1), F.lit(12)))
    return yearly.withColumn("Month", months)


NET = "(cast(recruitments AS DOUBLE) - cast(departures AS DOUBLE))"


def headcount(year: str) -> str:
    """Employees at the start of ``year`` as a SQL expression (DOUBLE, so that no request overflows) of the
    scenario's inputs: moves by the net change, never below 1 after the start."""
    later = f"greatest(1D, cast(initial_employees AS DOUBLE) + ({year} - start_year) * {NET})"
    return f"(CASE WHEN {year} = start_year THEN cast(initial_employees AS DOUBLE) ELSE {later} END)"


def headcount_path(scenarios: DataFrame) -> DataFrame:
    """Employees at the start and end of each year; the end figure is not floored. A count beyond BIGINT is NULL."""
    counts = {"employees": half_even(headcount("Year")), "end_employees": half_even(f"{headcount('Year')} + {NET}")}
    return expand_years(scenarios).withColumns({c: F.expr(sql) for c, sql in counts.items()})
