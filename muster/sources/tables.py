"""Stored tables: typed loads, scans and appends over Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.schemas import PAY_PARTS, PREDICTION_HISTORY, RECRUITMENT, SCENARIO_FIELDS, TERMINATION, USERS, EMPLOYEES

SCHEMAS = {
    "employees": EMPLOYEES,
    "users": USERS,
    "recruitment": RECRUITMENT,
    "termination": TERMINATION,
    "prediction_history": PREDICTION_HISTORY,
    "pay_parts": PAY_PARTS,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a stored schema. A NULL in a required column fails the job, as the table would."""
    def column(field: T.StructField) -> Column:
        if field.name not in df.columns:
            value = F.lit(None).cast(field.dataType)
        else:
            value = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            fault = F.raise_error(F.lit(f"{field.name} may not be NULL")).cast(field.dataType)
            value = F.when(value.isNull(), fault).otherwise(value)
        return value.alias(field.name)

    return df.select(*[column(f) for f in schema.fields])


def load_table(df: DataFrame, name: str, path: str) -> DataFrame:
    """Create the table from rows and return it as stored."""
    conform(df, SCHEMAS[name]).write.mode("overwrite").parquet(path)
    return scan_table(df.sparkSession, name, path)


def append_table(df: DataFrame, name: str, path: str) -> DataFrame:
    """Add rows. The job's output is committed as a whole, so a retried task adds nothing twice; a repeated job does."""
    conform(df, SCHEMAS[name]).write.mode("append").parquet(path)
    return scan_table(df.sparkSession, name, path)


def append_once(df: DataFrame, name: str, path: str, batch: str) -> DataFrame:
    """Add the rows of a batch; running the same batch again adds nothing. Returns the table as ``scan_batches`` reads it.

    The rows go to the folder of their batch, replacing what a run that failed there left, and count only once the batch is in the
    log: a job that is killed anywhere is invisible, and is simply run again. Other batches' folders are not touched.
    """
    spark = df.sparkSession
    if not _logged(spark, path).filter(F.col("batch") == batch).isEmpty():
        return scan_batches(spark, name, path)
    staged = conform(df, SCHEMAS[name]).withColumn("batch", F.lit(batch))
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/rows")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{path}/log")
    return scan_batches(spark, name, path)


def _logged(spark: SparkSession, path: str) -> DataFrame:
    """Batches that are complete; none where the table does not exist yet."""
    try:
        return spark.read.schema("batch string").parquet(f"{path}/log").distinct()
    except AnalysisException:
        return spark.createDataFrame([], "batch string")


def scan_batches(spark: SparkSession, name: str, path: str) -> DataFrame:
    """All rows of complete batches. Folders of others are pruned by the log at run time."""
    logged = _logged(spark, path)
    if logged.isEmpty():
        return spark.createDataFrame([], SCHEMAS[name])
    stored = T.StructType([*SCHEMAS[name].fields, T.StructField("batch", T.StringType())])
    rows = spark.read.schema(stored).parquet(f"{path}/rows")
    return rows.join(logged, "batch", "left_semi").select(*SCHEMAS[name].fieldNames())


def scan_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def append_movements(
    records: DataFrame, name: str, path: str, created_at: Column | None = None, batch: str | None = None,
) -> DataFrame:
    """Record recruitments or terminations, those of a ``batch`` once; the employees themselves are not changed."""
    stamp = F.current_timestamp() if created_at is None else created_at
    return _append(records.withColumn("created_at", stamp), name, path, batch)


def _append(rows: DataFrame, name: str, path: str, batch: str | None) -> DataFrame:
    return append_table(rows, name, path) if batch is None else append_once(rows, name, path, batch)


def append_history(
    scored: DataFrame, users: DataFrame, path: str, created_at: Column | None = None, batch: str | None = None,
) -> DataFrame:
    """Keep each scored scenario with its result, for requests made by a known user; those of a ``batch`` once."""
    stamp = F.current_timestamp() if created_at is None else created_at
    known = users.select(F.col("id").alias("user_id"))
    rows = scored.join(known, "user_id", "left_semi").select(
        F.col("scenario_id").alias("id"), "user_id", *SCENARIO_FIELDS, "result_json",
        stamp.alias("created_at"),
    )
    return _append(rows, "prediction_history", path, batch)
