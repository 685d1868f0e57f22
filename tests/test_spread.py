"""What comes in one task, as a small file does, must not stay there when it becomes many rows or much work."""

from __future__ import annotations

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from __spark_entry__ import queries
from muster.plans import records
from muster.session import workspace
from muster.sources import snapshots


@pytest.mark.parametrize("name", ["project_yearly", "project_yearly_trained", "score", "choose_engine"])
def test_scenarios_of_one_file_are_expanded_by_many_tasks(spark, name):
    out = queries()[name](spark, SF_DIR)
    tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(F.collect_set("scenario_id").alias("own")).collect()
    assert len(tasks) > 1 and sum(len(t["own"]) for t in tasks) == len({k for t in tasks for k in t["own"]})


@pytest.mark.parametrize("job", ["add", "edit"])
def test_forms_are_validated_once_and_by_many_tasks(spark, domain, job):
    forms = domain.intake_forms() if job == "add" else domain.edit_forms()
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    path = workspace(spark, "snapshot")
    snapshots.create(domain.employees(), "employees", path, buckets=4)
    records.change_snapshot(spark, path, job, forms.withColumn("last_name", counted("last_name")))
    snapshots.read(spark, "employees", path).count()
    assert read.value == forms.count()
    assert len(records._checked(forms, job == "edit").inputFiles()) > 1


def test_forms_without_a_column_or_with_an_untyped_one_are_added(spark, domain):
    forms = domain.intake_forms().withColumn("date_left", F.lit(None)).withColumn("note", F.lit(None))
    plain = records.add_employees(domain.employees(), domain.intake_forms())
    odd = records.add_employees(domain.employees(), forms)
    assert odd.employees.exceptAll(plain.employees).isEmpty() and plain.employees.exceptAll(odd.employees).isEmpty()
    assert odd.refused.exceptAll(plain.refused).isEmpty() and not odd.refused.isEmpty()
