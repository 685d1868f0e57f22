"""Joins of the period sources and of the row-level tables.

Period sources are series (one row per entity and month), so their joins cannot be skewed beyond the
calendar. Row-level lookups join a large left side to a table with a unique key: where that table is
under the broadcast threshold Spark broadcasts it by its measured size, and where it is not, adaptive
execution splits a hot left partition (allowed for inner, left, semi and anti joins). No side is
hinted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.operators.clean import drop_incomplete

MONTH_KEYS = ("entity", "Year", "Month")


def merge_monthly_left(
    departures: DataFrame, recruitments: DataFrame, salary: DataFrame,
    on: Sequence[str] = MONTH_KEYS,
) -> DataFrame:
    """Every departure month with its recruitments (0 if none) and its salary (required)."""
    merged = departures.join(recruitments, list(on), "left").join(salary, list(on), "left")
    return drop_incomplete(merged.fillna(0, subset=["Recruitments"]))


def merge_monthly_inner(
    departures: DataFrame, recruitments: DataFrame, salary: DataFrame,
    on: Sequence[str] = MONTH_KEYS,
) -> DataFrame:
    """Only the months all three sources have."""
    return departures.join(recruitments, list(on)).join(salary, list(on))


def merge_yearly(
    salary: DataFrame, departures: DataFrame, recruitments: DataFrame,
    on: Sequence[str] = ("entity", "Year"),
) -> DataFrame:
    """Salary years with their movements; whatever is missing is 0."""
    return salary.join(departures, list(on), "left").join(recruitments, list(on), "left").fillna(0)


def user_profile(users: DataFrame, employees: DataFrame) -> DataFrame:
    """Account with the names of its employee; ``found`` is false for a dangling matricule."""
    people = employees.select(
        "matricule", "first_name", "last_name", F.lit(True).alias("found")
    )
    return users.join(people, "matricule", "left").select(
        "id", "username", "email_adress", "matricule", "first_name", "last_name",
        F.coalesce("found", F.lit(False)).alias("found"),
    )


def movement_join(movements: DataFrame, employees: DataFrame) -> DataFrame:
    """Recruitment or termination records with the employee they point to."""
    people = employees.select(
        "matricule",
        F.concat_ws(" ", "first_name", "last_name").alias("employee_name"),
        F.col("date_left").alias("employee_date_left"),
    )
    return movements.join(people, "matricule", "left")


def history_users(history: DataFrame, users: DataFrame) -> DataFrame:
    """Prediction history with the account that asked."""
    accounts = users.select(F.col("id").alias("user_id"), "username", "matricule")
    return history.join(accounts, "user_id", "left")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Foreign keys without a parent and how many rows carry each.

    The child is reduced to its distinct keys first, so a key held by a third of the rows costs one
    row in the anti join.
    """
    keys = child.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("rows"))
    parents = parent.select(F.col(parent_key).alias("key"))
    return keys.filter("key IS NOT NULL").join(parents, "key", "left_anti")


def attach_factor(df: DataFrame, factor: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``factor`` (1 where there is none). Without ``by`` the one-row factor is a scalar subquery,
    with ``by`` an equi-join to one row per entity."""
    if by:
        return df.join(factor, list(by), "left").fillna(1.0, subset=["factor"])
    return df.withColumn("factor", F.coalesce(factor.select("factor").scalar(), F.lit(1.0)))


def apply_factor(
    predictions: DataFrame, factor: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
) -> DataFrame:
    """Multiply ``columns`` by ``factor``; where there is none they stay as they are."""
    scaled = {c: F.col(c) * F.col("factor") for c in columns}
    return attach_factor(predictions, factor, by).withColumns(scaled).drop("factor")
