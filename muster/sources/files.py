"""CSV inputs.

Files are read as text by header name, so the column order and the case or padding of a header do not
matter, and keys that are no numbers can be dropped instead of failing the job. Nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.clean import coerce_keys, coerce_values, normalize_keys
from muster.sources.tables import SCHEMAS


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def _entity(df: DataFrame) -> DataFrame:
    """Files of a single organisation have no entity column; it is then a constant."""
    entity = F.col("entity").try_cast("int") if "entity" in df.columns else F.lit(0)
    return df.withColumn("entity", entity)


def read_monthly(spark: SparkSession, path: str, *values: str) -> DataFrame:
    """One monthly source: (entity, Year, Month, values)."""
    df = coerce_values(coerce_keys(normalize_keys(_entity(read_csv(spark, path)))), values)
    return df.select("entity", "Year", "Month", *values)


def read_historical(spark: SparkSession, path: str) -> DataFrame:
    """Yearly history: pay as DOUBLE, counts as whole numbers."""
    counts = ["number_employees", "departures", "recruitment"]
    df = coerce_keys(_entity(read_csv(spark, path)), ["year"])
    df = coerce_values(df, ["mass_salary", *counts])
    return df.select(
        "entity", "year", "mass_salary", *[F.col(c).try_cast("bigint").alias(c) for c in counts]
    )


def read_final_dataset(spark: SparkSession, path: str) -> DataFrame:
    return read_historical(spark, path).select(
        "entity", "year", "departures", "recruitment", "number_employees", "mass_salary"
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Prediction requests: the five fields stay text, to be checked; keys are numbers."""
    df = _entity(read_csv(spark, path))
    keys = {"scenario_id": F.col("scenario_id").try_cast("bigint")}
    if "user_id" in df.columns:
        keys["user_id"] = F.col("user_id").try_cast("bigint")
    return df.withColumns(keys)


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """Forms or requests as text; ``seq`` is the order they were made in, ``reason`` columns are not taken over."""
    df = read_csv(spark, path)
    return df.withColumn("seq", F.col("seq").try_cast("bigint")).filter("seq IS NOT NULL").drop("reason")


def read_moves(spark: SparkSession, path: str) -> DataFrame:
    """Planned moves of each organisation: (entity, recruitments, departures)."""
    df = _entity(read_csv(spark, path))
    return df.select("entity", *[F.col(c).try_cast("bigint").alias(c) for c in ("recruitments", "departures")])


def read_records(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of a stored table; columns the file lacks are left to the table's rules."""
    df = read_csv(spark, path)
    fields = [f for f in SCHEMAS[table].fields if f.name in df.columns]
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields])
