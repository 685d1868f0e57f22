"""Dashboard figures kept up from appended rows.

Each batch of monthly rows is reduced to mergeable parts, one row per organisation and year: sums, counts and maxima. Parts are
appended once per batch; any figure is the merge of all parts. Pay is summed as decimals, so that the order of batches changes
no bit. A year's figures cost its batches, not its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.sources import tables

KEYS = ("entity", "Year")
_PAY = "decimal(38, 4)"


def parts(
    salary: DataFrame | None = None, departures: DataFrame | None = None, recruitments: DataFrame | None = None,
) -> DataFrame:
    """Parts of a batch of monthly rows, whichever of the three sources it has."""
    sources = [
        (salary, [F.sum(F.col("mass_salary").cast(_PAY)).alias("mass_salary"), F.sum("nbemp").cast("double").alias("staff_sum"),
                  F.count("nbemp").alias("staff_rows"), F.max("nbemp").cast("bigint").alias("staff_most"), F.count("*").alias("pay_rows")]),
        (departures, [F.sum("nb_departures").cast("bigint").alias("departures"), F.count("*").alias("departure_rows")]),
        (recruitments, [F.sum("Recruitments").cast("bigint").alias("recruitments"), F.count("*").alias("recruitment_rows")]),
    ]
    found = [df.groupBy(*KEYS).agg(*sums) for df, sums in sources if df is not None]
    if not found:
        raise ValueError("a batch needs at least one source")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows


def add(spark: SparkSession, path: str, batch: str, **sources: DataFrame) -> None:
    """Add a batch of monthly rows; the same batch again adds nothing."""
    tables.append_once(parts(**sources), "pay_parts", path, batch)


def merged(spark: SparkSession, path: str) -> DataFrame:
    """One row per organisation and year from all parts."""
    most = {"staff_most"}
    sums = [f.name for f in tables.SCHEMAS["pay_parts"].fields if f.name not in {*KEYS, *most}]
    return tables.scan_batches(spark, "pay_parts", path).groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most])


def yearly_salary(kept: DataFrame) -> DataFrame:
    pay = F.col("mass_salary").cast("double").alias("mass_salary")
    return kept.filter("pay_rows > 0").select(*KEYS, pay, F.try_divide("staff_sum", "staff_rows").alias("nbemp"))


def yearly_departures(kept: DataFrame) -> DataFrame:
    return kept.filter("departure_rows > 0").select(*KEYS, F.col("departures").alias("nb_departures"))


def yearly_recruitments(kept: DataFrame) -> DataFrame:
    return kept.filter("recruitment_rows > 0").select(*KEYS, F.col("recruitments").alias("Recruitments"))


def historical(kept: DataFrame) -> DataFrame:
    """The yearly history that the dashboard shows, of years with pay."""
    pay = F.round(F.col("mass_salary"), 2).cast("double").alias("mass_salary")
    return kept.filter("pay_rows > 0").select(
        "entity", F.col("Year").alias("year"), pay, F.col("staff_most").alias("number_employees"),
        F.coalesce("departures", F.lit(0)).alias("departures"), F.coalesce("recruitments", F.lit(0)).alias("recruitment"))
