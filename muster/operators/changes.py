"""Applying a batch of changes to the employee snapshot.

A snapshot has one row per matricule; a batch may hold any number of changes for one employee. Each
batch is first reduced to the number ``seq`` (the order the changes were made in, unique within a batch)
of the change that counts for each employee, by hash aggregates over numbers alone, and only then joined to
the batch and the snapshot, so a much-edited employee never becomes a large group. Every function returns the new snapshot.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.operators.intake import accepted, first_valid_exits
from muster.schemas import EMPLOYEES

COLUMNS = EMPLOYEES.fieldNames()
EDITABLE = [c for c in COLUMNS if c != "matricule"]


def apply_inserts(employees: DataFrame, validated: DataFrame) -> DataFrame:
    """Add accepted forms. A key that is taken, or repeated within the batch, is refused."""
    forms = accepted(validated)
    first = forms.groupBy("matricule").agg(F.min("seq").alias("seq"))
    values = [F.col(c) if c in validated.columns else F.lit(None).alias(c) for c in EDITABLE]
    new = (
        forms.join(first, ["matricule", "seq"], "left_semi")
        .join(employees.select("matricule"), "matricule", "left_anti")
        .select("matricule", *values)
    )
    typed = new.select(*[F.col(c).cast(employees.schema[c].dataType).alias(c) for c in COLUMNS])
    return employees.select(*COLUMNS).unionByName(typed)


def apply_full_update(employees: DataFrame, validated: DataFrame) -> DataFrame:
    """Replace every editable field by the last accepted edit.

    Terminated employees are closed to edits. An edit may itself set ``date_left``; the edits after
    the first such one are refused.
    """
    edits = accepted(validated)
    closing = F.when(F.col("date_left").isNotNull(), F.col("seq"))
    counted = edits.groupBy("matricule").agg(F.coalesce(F.min(closing), F.max("seq")).alias("seq"))
    last = edits.join(counted, ["matricule", "seq"], "left_semi").select("matricule", F.struct(*EDITABLE).alias("edit"))
    edited = F.col("edit").isNotNull() & F.col("date_left").isNull()
    new = [F.when(edited, F.col(f"edit.{c}")).otherwise(F.col(c)).alias(c) for c in EDITABLE]
    return employees.join(last, "matricule", "left").select("matricule", *new).select(*COLUMNS)


def apply_partial_update(employees: DataFrame, patches: DataFrame) -> DataFrame:
    """Set only the fields a patch carries.

    ``patches`` has ``seq``, ``matricule``, the patched columns and ``present`` (the names of the
    fields sent). A sent NULL overwrites, except that a NULL birth or titularisation date keeps the
    old one. Hire and departure dates cannot be patched. Per field the last patch that sent it wins.
    """
    keep_if_null = {"birth_date", "date_titularisation"}
    fixed = {"matricule", "date_joined", "date_left"}
    fields = [c for c in COLUMNS if c in patches.columns and c not in fixed]

    def sent(c: str) -> Column:
        there = F.array_contains("present", c)
        return there & F.col(c).isNotNull() if c in keep_if_null else there

    # First the last patch of each field by number alone, then the few patches that are the last of any field.
    winners = patches.groupBy("matricule").agg(*[F.max(F.when(sent(c), F.col("seq"))).alias(f"seq_{c}") for c in fields])
    won = [F.col("seq") == F.col(f"seq_{c}") for c in fields]
    # A struct, so that a sent NULL differs from nothing sent.
    merged = (
        patches.join(winners, "matricule").filter(reduce(or_, won))
        .groupBy("matricule")
        .agg(*[F.collect_list(F.when(w, F.struct(F.col(c)))).alias(f"new_{c}") for c, w in zip(fields, won, strict=True)])
        .select("matricule", *[F.get(f"new_{c}", F.lit(0)).alias(f"new_{c}") for c in fields])
    )
    out = employees.join(merged, "matricule", "left")
    for c in fields:
        new = F.col(f"new_{c}")
        out = out.withColumn(c, F.when(new.isNotNull(), new[c]).otherwise(F.col(c)))
    return out.select(*COLUMNS)


def apply_terminations(
    employees: DataFrame, requests: DataFrame, today: Column | None = None, checked: bool = True,
) -> DataFrame:
    """Set ``date_left``. Unchecked, any date counts, the last one wins and none means today."""
    if checked:
        exits = first_valid_exits(requests, employees)
        dates = exits.select("matricule", F.col("end_date").alias("new_date_left"))
    else:
        day = F.coalesce(F.col("date_left"), F.current_date() if today is None else today)
        dates = requests.groupBy("matricule").agg(F.max_by(day, "seq").alias("new_date_left"))
    return (
        employees.join(dates, "matricule", "left")
        .withColumn("date_left", F.coalesce("new_date_left", "date_left"))
        .select(*COLUMNS)
    )


def apply_deletes(employees: DataFrame, keys: DataFrame) -> DataFrame:
    return employees.join(keys.select("matricule"), "matricule", "left_anti")
