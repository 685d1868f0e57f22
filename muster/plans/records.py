"""Jobs that change the employee snapshot: forms in, the new snapshot and what was refused out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators import changes, intake
from muster.operators.joins import orphans
from muster.operators.rollups import duplicate_keys, row_counts
from muster.operators.scenarios import spread
from muster.schemas import ALREADY_TERMINATED, KEY_TAKEN, NOT_FOUND
from muster.session import stored
from muster.sources import snapshots


@dataclass(frozen=True)
class Changed:
    """``employees`` is the whole new snapshot; ``refused`` has ``seq``, ``matricule`` and ``reason``."""

    employees: DataFrame
    refused: DataFrame


def _reasons(rows: DataFrame, reason=None) -> DataFrame:
    said = F.col("reason") if reason is None else reason
    return rows.select("seq", "matricule", said.alias("reason"))


def _checked(forms: DataFrame, editing: bool = False) -> DataFrame:
    """Validated forms, read by all cores and once: what is applied and what is refused both start from them."""
    checked = intake.validate_forms(spread(forms, "seq"), editing)
    used = {"seq", "reason", *changes.COLUMNS}
    return stored(checked.select(*[c for c, kind in checked.dtypes if c in used and kind != "void"]), "checked")


def add_employees(employees: DataFrame, forms: DataFrame) -> Changed:
    """Hire forms (text). Of several accepted forms for a new key the first counts."""
    checked = _checked(forms)
    fine = intake.accepted(checked)
    first = fine.groupBy("matricule").agg(F.min("seq").alias("first"))
    known = employees.select("matricule", F.lit(True).alias("known"))
    taken = fine.select("seq", "matricule").join(first, "matricule").join(known, "matricule", "left")
    taken = taken.filter("known OR seq > first")
    refused = _reasons(intake.rejected(checked)).unionByName(_reasons(taken, F.lit(KEY_TAKEN)))
    return Changed(changes.apply_inserts(employees, checked), refused)


def edit_employees(employees: DataFrame, forms: DataFrame) -> Changed:
    """Edit forms (text) of existing employees; a terminated one is closed, also by an earlier edit of the batch."""
    keyed = forms.withColumn("matricule", F.col("matricule").try_cast("bigint"))
    checked = _checked(keyed, editing=True)
    fine = intake.accepted(checked)
    closing = fine.filter("date_left IS NOT NULL").groupBy("matricule").agg(F.min("seq").alias("closing"))
    state = employees.select("matricule", F.col("date_left").alias("left_before"), F.lit(True).alias("known"))
    asked = fine.select("seq", "matricule").join(state, "matricule", "left").join(closing, "matricule", "left")
    gone = F.col("left_before").isNotNull() | (F.col("seq") > F.col("closing"))
    closed = asked.withColumn("reason", intake.first_failure(
        (F.col("known").isNull(), NOT_FOUND), (gone, ALREADY_TERMINATED),
    )).filter("reason IS NOT NULL")
    refused = _reasons(intake.rejected(checked)).unionByName(_reasons(closed))
    return Changed(changes.apply_full_update(employees, checked), refused)


def terminate_employees(employees: DataFrame, requests: DataFrame) -> Changed:
    """Termination requests (``seq``, ``matricule``, ``date_left`` as text)."""
    keyed = requests.withColumn("matricule", F.col("matricule").try_cast("bigint"))
    refused = intake.rejected(intake.validate_terminations(keyed, employees))
    return Changed(changes.apply_terminations(employees, keyed), _reasons(refused))


JOBS = {"add": add_employees, "edit": edit_employees, "terminate": terminate_employees}


def change_snapshot(spark: SparkSession, path: str, job: str, rows: DataFrame) -> DataFrame:
    """One of ``JOBS`` on a stored snapshot of employees: publishes its next version and returns what was refused.

    Only buckets that a form's matricule falls into are read and written; a form without a usable matricule touches none.
    """
    after = snapshots.newest(spark, path)
    key = F.col("matricule").try_cast("bigint").alias("matricule")
    refused: list[DataFrame] = []

    def apply(employees: DataFrame) -> DataFrame:
        done = JOBS[job](employees, rows)
        refused.append(stored(done.refused, "refused"))
        return done.employees

    version = snapshots.change(spark, "employees", path, rows.select(key), apply, after)
    return refused[0] if version != after else JOBS[job](snapshots.read(spark, "employees", path), rows).refused


def audit(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Row counts, repeated employee keys, and keys of other tables that no employee or user has."""
    staff = tables["employees"]
    found = {"counts": row_counts(tables), "duplicates": duplicate_keys(staff, "matricule")}
    for name in ("users", "recruitment", "termination"):
        if name in tables:
            found[f"orphans_{name}"] = orphans(tables[name], "matricule", staff, "matricule")
    if {"prediction_history", "users"} <= tables.keys():
        found["orphans_prediction_history"] = orphans(tables["prediction_history"], "user_id", tables["users"], "id")
    return found
