from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from muster.operators import projection, regression
from muster.operators.regression import GBT_YEARLY, LINEAR
from muster.plans import training
from muster.plans.predict import keep_history, predict_batch
from muster.sources import documents, files, models


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_monthly_csv(spark, tmp_path):
    path = write(tmp_path / "d.csv", "nb_departures, DEP_ANNEE ,dep_mois\n3, 2010 ,1\n4,abc,2\n5,2010.0,03\n6,,4\n")
    got = files.read_monthly(spark, path, "nb_departures")
    assert sorted(rows(got)) == [(0, 2010, 1, 3.0), (0, 2010, 3, 5.0)]


def test_historical_csv(spark, tmp_path):
    path = write(tmp_path / "h.csv", "year,mass_salary,number_employees,departures,recruitment\n2011,10.5,4,1,0\nx,1,1,1,1\n2010,9,,2,3\n")
    assert sorted(rows(files.read_historical(spark, path))) == [(0, 2010, 9.0, None, 2, 3), (0, 2011, 10.5, 4, 1, 0)]
    assert files.read_final_dataset(spark, path).columns[1:] == [
        "year", "departures", "recruitment", "number_employees", "mass_salary",
    ]


def test_result_documents(spark):
    yearly = spark.createDataFrame(
        [(1, 2022, 2.5, 10), (1, 2021, 1.25, 9), (2, 2021, 7.0, 1)],
        "scenario_id bigint, Year int, Total_Salary double, End_Employees bigint",
    )
    metrics = spark.range(1).select(F.lit(0.98765).alias("r2"), F.lit(12.345).alias("mse"))
    docs = {r[0]: json.loads(r[1]) for r in rows(documents.result_json(yearly, models.flatten_metrics(metrics), ["scenario_id"]))}
    assert [p["Year"] for p in docs[1]["predictions"]] == [2021, 2022]
    assert docs[2]["predictions"] == [{"Year": 2021, "Total_Salary": 7.0, "End_Employees": 1}]
    assert docs[1]["metrics"]["monthly_r2"] == 0.9877 and docs[1]["metrics"]["yearly_mse"] == 0.0
    good = '{"status": "success", "graph": "g"}'
    texts = ["{oops", good, "", good + " x", good + ", 1", "12", "null", None, good.replace('"', "'"), " " + good + "\n",
             '{"status": "success", "graph": "", "metrics": {"monthly_r2": NaN}}']
    stored = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, result_json string")
    got = rows(documents.parse_result(stored).orderBy("i").select("result.status", "has_graph"))
    none, kept = (None, False), ("success", True)
    assert got == [none, kept, none, none, none, none, none, none, none, kept, ("success", False)]


def test_chart_json(spark):
    history = spark.createDataFrame(
        [(1, 2011, 10.0, 4, 1, 0), (1, 2010, 9.0, 0, 2, 3)],
        "entity int, year int, mass_salary double, number_employees bigint, departures bigint, recruitment bigint",
    )
    charts = {r.series: json.loads(r.chart) for r in documents.chart_json(documents.chart_series(history)).collect()}
    assert len(charts) == 6
    assert charts["salary"] == {"labels": ["2010", "2011"], "values": [9.0, 10.0]}
    assert charts["avg_salary_by_year"]["values"] == [None, 2.5]


def test_metrics_default_and_shapes(spark, tmp_path):
    missing = models.load_metrics(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert models.flatten_metrics(missing).first()[:] == (0.0,) * 6
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, str(tmp_path / "a"), str(tmp_path / "b"))


@pytest.fixture(scope="module")
def frame(domain):
    return domain.yearly_training().cache()


def test_ols_residuals_are_orthogonal(spark, frame):
    model = regression.fit(frame, LINEAR)
    scored = model.predict(frame)
    r = scored.withColumn("r", F.col("mass_salary") - F.col("prediction"))
    scale = frame.agg(F.stddev_pop("mass_salary")).first()[0]
    assert abs(r.agg(F.avg("r")).first()[0]) < 1e-6 * scale
    assert abs(r.agg(F.corr("r", "nbemp")).first()[0]) < 1e-6
    fitted = {x.feature: x.coefficient for x in regression.coefficients(spark, model).collect()}
    assert fitted["intercept"] == pytest.approx(frame.agg(F.avg("mass_salary")).first()[0])


def test_saved_model_predicts_the_same(spark, frame, tmp_path):
    trained = training.train_yearly(frame, GBT_YEARLY.with_params(rounds=3))
    path = str(tmp_path / "yearly")
    training.train_and_save(trained, path)
    loaded = models.load_model(spark, path, "")
    assert (loaded.kind, loaded.features) == ("yearly", list(GBT_YEARLY.features))
    a = sorted(rows(projection.score(frame, trained.model).select("entity", "Year", "prediction")))
    b = sorted(rows(projection.score(frame, loaded).select("entity", "Year", "prediction")))
    assert a == b
    flat = models.flatten_metrics(models.load_metrics(spark, path, "")).first()
    assert 0 <= flat.monthly_r2 <= 1 and flat.yearly_r2 == 0.0
    ranked = rows(regression.rank_importance(spark, loaded))
    assert sum(r[1] for r in ranked) == pytest.approx(1.0) and ranked == sorted(ranked, key=lambda r: (-r[1], r[0]))
    report = training.train_report(trained.scored)
    assert report.filter("line = 'AVERAGE'").count() == 1 and report.count() == frame.count() + 1


def test_fallback_to_the_monthly_model(spark, domain, tmp_path):
    spec = regression.GBT_MONTHLY.with_params(rounds=2)
    trained = training.train_holdout(domain.monthly_training(), spec, scale_on_all=True)
    path = str(tmp_path / "monthly")
    training.train_and_save(trained, path)
    model = models.load_model(spark, str(tmp_path / "none"), path)
    assert model.kind == "monthly"
    few = domain.scenarios().limit(20)
    monthly, yearly = projection.project(few, model)
    assert monthly.count() == 12 * yearly.count() and yearly.filter("Total_Salary < 0").count() == 0


def test_predict_batch(spark, domain, tmp_path):
    model = domain.yearly_formula()
    metrics = spark.range(1).select(F.lit(0.5).alias("r2"), F.lit(2.0).alias("mse"))
    done = predict_batch(domain.scenario_requests(), domain.historical(), model, metrics)
    asked = domain.scenario_requests().count()
    assert done.documents.count() + done.refused.count() == asked
    assert done.refused.filter("message IS NULL").count() == 0
    assert done.monthly.count() == 12 * done.yearly.count()
    users = spark.range(0, 200, 2)
    stored = keep_history(done, users, str(tmp_path / "h"))
    want = done.documents.filter("user_id % 2 = 0").count()
    assert stored.count() == want > 0
    assert stored.filter("created_at IS NULL").count() == 0


def test_command_line_jobs(spark, domain, tmp_path):
    """CSV in, model and results out, as a user of the jobs would run them."""
    from muster.__main__ import main

    salary, departures, recruitments = domain.monthly_sources()
    requests = domain.scenario_requests()
    inputs = {
        "salary": salary, "departures": departures, "recruitments": recruitments, "requests": requests,
        "historical": domain.historical(),
    }
    paths = {name: str(tmp_path / name) for name in inputs}
    for name, df in inputs.items():
        df.write.csv(paths[name], header=True)
    out, model = str(tmp_path / "out"), str(tmp_path / "model")
    users = str(tmp_path / "users")
    domain.users().select("*").write.parquet(users)

    main(["dashboard", "--historical", paths["historical"], "--out", out])
    assert spark.read.parquet(f"{out}/series").count() == 6 * domain.historical().count()
    main(["train", "--kind", "yearly", "--rounds", "2", "--model", model, "--salary", paths["salary"],
          "--departures", paths["departures"], "--recruitments", paths["recruitments"]])
    main(["backtest", "--historical", paths["historical"], "--yearly-model", model, "--out", out])
    assert spark.read.parquet(f"{out}/rows").count() == domain.historical().count()
    main(["predict", "--requests", paths["requests"], "--historical", paths["historical"], "--yearly-model", model,
          "--users", users, "--out", out])
    documents_, refused = spark.read.parquet(f"{out}/documents"), spark.read.parquet(f"{out}/refused")
    assert documents_.count() + refused.count() == requests.count()
    kept = spark.read.parquet(f"{out}/history")
    assert kept.count() == documents_.join(domain.users(), documents_.user_id == domain.users().id, "left_semi").count()
