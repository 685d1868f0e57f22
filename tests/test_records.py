"""Record-change jobs, from forms on disk to the new snapshot and the refused rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from muster.__main__ import main
from muster.plans.backtest import backtest
from muster.plans.predict import predict_batch
from muster.sources import tables


@pytest.fixture
def staff(spark, domain, tmp_path):
    path = str(tmp_path / "staff")
    tables.load_table(domain.employees(), "employees", path)
    return path


def _csv(df, tmp_path, name):
    path = str(tmp_path / name)
    df.write.csv(path, header=True, nullValue="", emptyValue="")
    return path


@pytest.mark.parametrize("job", ["add", "edit", "terminate"])
def test_every_form_is_applied_or_refused(spark, domain, staff, tmp_path, job):
    forms = {"add": domain.intake_forms, "edit": domain.edit_forms, "terminate": domain.termination_requests}[job]()
    out = str(tmp_path / "out")
    main([job, "--employees", staff, "--forms", _csv(forms, tmp_path, "forms"), "--out", out])
    before, after = spark.read.parquet(staff), spark.read.parquet(f"{out}/employees")
    refused = spark.read.parquet(f"{out}/refused")
    assert refused.filter("reason IS NULL").count() == 0 and refused.groupBy("seq").count().filter("count > 1").count() == 0
    applied = forms.count() - refused.count()
    if job == "add":
        assert after.count() - before.count() == applied > 0
        assert refused.filter(F.col("reason").isin("Invalid echelon", "Invalid salaire_base", "Matricule already exists")).count() > 0
        assert after.filter("echelon IS NULL AND matricule % 17 = 2").count() == before.filter("echelon IS NULL AND matricule % 17 = 2").count()
    elif job == "edit":
        assert after.count() == before.count()
        changed = after.join(before, after.columns, "left_anti").count()
        assert 0 < changed <= applied
    else:
        ended = after.filter("date_left IS NOT NULL").count() - before.filter("date_left IS NOT NULL").count()
        assert ended == applied > 0


def test_seed_record_audit_choices_and_history(spark, domain, staff, tmp_path):
    out = str(tmp_path / "out")
    moves = domain.recruitment().withColumn("created_at", F.lit("2001-01-01 00:00:00"))
    records, store = _csv(moves, tmp_path, "records"), str(tmp_path / "store")
    main(["seed", "--records", records, "--table", "recruitment", "--path", store])
    main(["record", "--records", records, "--table", "recruitment", "--path", store])
    assert spark.read.parquet(store).count() == 2 * moves.count()
    main(["audit", "--employees", staff, "--recruitment", store, "--out", out])
    counts = {r[0]: r[1] for r in spark.read.parquet(f"{out}/counts").collect()}
    assert counts["recruitment"] == 2 * moves.count() and spark.read.parquet(f"{out}/duplicates").count() == 0
    assert spark.read.parquet(f"{out}/orphans_recruitment").count() == 0
    main(["choices", "--employees", staff, "--out", out])
    assert spark.read.parquet(f"{out}/corps").count() > 0
    kept = str(tmp_path / "kept")
    tables.load_table(domain.history(), "prediction_history", kept)
    user = spark.read.parquet(kept).first()["user_id"]
    main(["history", "--history", kept, "--user", str(user), "--out", out])
    assert spark.read.parquet(f"{out}/history").count() == domain.history().filter(F.col("user_id") == user).count()


def test_a_monthly_model_alone_serves_every_job(spark, domain, tmp_path):
    salary, departures, recruitments = domain.monthly_sources()
    paths = {n: _csv(df, tmp_path, n) for n, df in (
        ("salary", salary), ("departures", departures), ("recruitments", recruitments), ("historical", domain.historical()),
        ("requests", domain.scenario_requests()),
        ("moves", salary.select("entity").distinct().withColumns({"recruitments": F.lit(3), "departures": F.lit(1)})))}
    out, model = str(tmp_path / "out"), str(tmp_path / "model")
    series = ["--salary", paths["salary"], "--departures", paths["departures"], "--recruitments", paths["recruitments"]]
    main(["train", "--kind", "monthly", "--rounds", "2", "--model", model, *series])
    main(["backtest", "--historical", paths["historical"], "--monthly-model", model, "--out", out])
    assert spark.read.parquet(f"{out}/rows").count() == domain.historical().count()
    main(["predict", "--requests", paths["requests"], "--historical", paths["historical"], "--monthly-model", model, "--out", out])
    answered = spark.read.parquet(f"{out}/documents").count() + spark.read.parquet(f"{out}/refused").count()
    assert answered == domain.scenario_requests().count()
    main(["forecast", *series, "--moves", paths["moves"], "--year", "2021", "--monthly-model", model, "--out", out])
    assert spark.read.parquet(f"{out}/forecast").count() == domain.merged_monthly().select("entity").distinct().count()


def test_either_engine_in_backtest_and_prediction(spark, domain):
    metrics = spark.range(1).select(F.lit(0.5).alias("r2"), F.lit(2.0).alias("mse"))
    for kind in ("yearly", "monthly"):
        tested = backtest(domain.historical(), domain.formula(kind))
        assert tested.rows.count() == domain.historical().count()
        done = predict_batch(domain.scenario_requests(), domain.historical(), domain.formula(kind), metrics)
        assert done.documents.select("scenario_id").distinct().count() == done.documents.count() > 0


REQUESTS = "scenario_id bigint, entity int, start_year string, end_year string, recruitments string, departures string, initial_employees string"


def test_requests_are_answered_once(spark, domain):
    huge = str(2**63 - 1)
    asked = spark.createDataFrame([
        (1, 1, "2021", "2022", "1", "1", "10"), (2, 1, "2021", "2022", "1", "1", "10"), (2, 1, "2021", "2022", "1", "1", "10"),
        (None, 1, "2021", "2022", "1", "1", "10"), (3, 1, "2021", "2040", huge, "0", huge), (4, 1, "2021", "2022", "1", "1", "10"),
    ], REQUESTS)
    metrics = spark.range(1).select(F.lit(0.5).alias("r2"), F.lit(2.0).alias("mse"))
    for kind in ("yearly", "monthly"):
        done = predict_batch(asked, domain.historical(), domain.formula(kind), metrics)
        assert sorted(r.scenario_id for r in done.documents.select("scenario_id").collect()) == [1, 3, 4]
        said = [tuple(r) for r in done.refused.select("scenario_id", "message").collect()]
        assert sorted(said, key=str) == [(2, "Repeated scenario_id")] * 2 + [(None, "Invalid scenario_id")]
        ends = {r.scenario_id: r.e for r in done.yearly.groupBy("scenario_id").agg(F.max("End_Employees").alias("e")).collect()}
        assert ends[3] is None and ends[1] is not None


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, domain):
    """No period row is shuffled by organisation, no struct is sorted, and the series are read once."""
    from muster.operators import changes, intake, series
    from muster.plans.backtest import bias_correction

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _nodes(bias_correction(domain.scenarios(), domain.historical(), domain.yearly_formula(), ["entity"])[1])
        above = plan[:plan.index("Generate")]
        assert "Exchange" not in above
        forms = intake.validate_forms(domain.intake_forms())
        for df in (
            changes.apply_inserts(domain.employees(), forms), changes.apply_partial_update(domain.employees(), domain.patches()),
            changes.apply_full_update(domain.employees(), intake.validate_forms(domain.edit_forms(), editing=True)),
            series.first_row_per_year(domain.historical_copies()),
        ):
            assert "SortAggregate" not in _nodes(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    reduced = domain.reduced()
    tested = backtest(reduced.historical(), reduced.yearly_formula())
    assert "orders.parquet" not in _nodes(tested.rows) and "lineitem.parquet" not in _nodes(tested.rows)


def test_one_pass_labels_equal_the_filters(spark, domain):
    from muster.operators import employees, scenarios

    staff = domain.employees().select("matricule", "date_left")
    labelled = employees.by_status(staff)
    for asked in ("active", "terminated", "all"):
        want = employees.filter_status(staff, asked)
        assert labelled.filter(F.col("asked") == asked).drop("asked").exceptAll(want).count() == 0
        assert labelled.filter(F.col("asked") == asked).count() == want.count()
    checked = scenarios.check_requests(domain.scenario_requests())
    accepted, refused = scenarios.split(checked)
    counts = {r[0]: r[1] for r in scenarios.branch(checked).groupBy("branch").count().collect()}
    assert counts == {"predict": accepted.count(), "refuse": refused.count()}
