"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.catalog.domain import Domain
from muster.catalog.registry import ORACLE_BODIES, plain, query, sig
from muster.catalog.views_sql import money as money_sql
from muster.catalog.views_sql import sig as sig_sql
from muster.operators.scoring import regression_metrics
from muster.operators.projection import project_yearly
from muster.operators.rollups import row_counts
from muster.session import workspace
from muster.sources import documents, files, models, tables


def _as_csv(d: Domain, df: DataFrame, name: str) -> str:
    path = workspace(d.spark, name)
    df.write.csv(path, header=True)
    return path


@query("scan_historical", "select * from v_historical")
def scan_historical(d: Domain) -> DataFrame:
    return files.read_historical(d.spark, _as_csv(d, d.historical(), "historical"))


@query("scan_monthly_sources", """
    select 'departures' as source, entity, "Year", "Month", nb_departures::double as v1, null::double as v2 from v_monthly_departures
    union all select 'recruitments', entity, "Year", "Month", "Recruitments"::double, null::double from v_monthly_recruitments
    union all select 'salary', entity, "Year", "Month", mass_salary, nbemp from v_monthly_salary""")
def scan_monthly_sources(d: Domain) -> DataFrame:
    salary, departures, recruitments = d.monthly_sources()
    departures = departures.withColumnsRenamed({"Year": "DEP_ANNEE", "Month": "DEP_MOIS"})
    salary = salary.withColumnsRenamed({"Year": "annee", "Month": "mois"})
    none = F.lit(None).cast("double").alias("v2")
    keys = ["entity", "Year", "Month"]
    read = [
        files.read_monthly(d.spark, _as_csv(d, departures, "departures"), "nb_departures")
        .select(F.lit("departures").alias("source"), *keys, F.col("nb_departures").alias("v1"), none),
        files.read_monthly(d.spark, _as_csv(d, recruitments, "recruitments"), "Recruitments")
        .select(F.lit("recruitments").alias("source"), *keys, F.col("Recruitments").alias("v1"), none),
        files.read_monthly(d.spark, _as_csv(d, salary, "salary"), "mass_salary", "nbemp")
        .select(F.lit("salary").alias("source"), *keys, F.col("mass_salary").alias("v1"), F.col("nbemp").alias("v2")),
    ]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query("scan_final_dataset", """
    select entity, "year", departures, recruitment, number_employees, mass_salary from v_historical""")
def scan_final_dataset(d: Domain) -> DataFrame:
    return files.read_final_dataset(d.spark, _as_csv(d, d.historical(), "final"))


@query("scan_table", """
    select 'recruitment' as "table", id, matricule, strftime(recruitment_date, '%Y-%m-%d') as day from v_recruitment
    union all select 'termination', id, matricule, strftime(termination_date, '%Y-%m-%d') from v_termination""")
def scan_table(d: Domain) -> DataFrame:
    hires = tables.load_table(d.recruitment(), "recruitment", workspace(d.spark, "recruitment"))
    exits = tables.load_table(d.termination(), "termination", workspace(d.spark, "termination"))
    return hires.select(
        F.lit("recruitment").alias("table"), "id", "matricule", F.date_format("recruitment_date", "yyyy-MM-dd").alias("day")
    ).unionByName(exits.select(
        F.lit("termination").alias("table"), "id", "matricule", F.date_format("termination_date", "yyyy-MM-dd").alias("day")
    ))


EMPLOYEE_SQL = """matricule, first_name, last_name, strftime(birth_date, '%Y-%m-%d') as birth_date, grade, echelon, indice,
    corps, salaire_base::double as salaire_base, indemnite_residence::double as indemnite_residence,
    indemnite_transport::double as indemnite_transport, situation_familiale, nombre_enfants,
    strftime(date_joined, '%Y-%m-%d') as date_joined, strftime(date_titularisation, '%Y-%m-%d') as date_titularisation,
    strftime(date_left, '%Y-%m-%d') as date_left"""


@query("load_employees", f"select {EMPLOYEE_SQL} from v_employees")
def load_employees(d: Domain) -> DataFrame:
    return plain(tables.load_table(d.employees(), "employees", workspace(d.spark, "employees")))


def _metrics(d: Domain) -> DataFrame:
    """Nested metrics of the yearly line, as a training run stores them."""
    m = regression_metrics(d.compared())
    return m.select(F.struct("mse", "rmse", "mae", "r2").alias("monthly"), F.struct("mse", "r2").alias("yearly"))


_STATS = """
    select avg((actual - predicted) * (actual - predicted)) as mse, avg(abs(actual - predicted)) as mae,
      1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual) as r2 from v_compared"""


@query("history_append", """
    select c.scenario_id as id, c.user_id, c.start_year, c.end_year, c.recruitments, c.departures, c.initial_employees,
      p."Year", p."Total_Salary", p."End_Employees"
    from v_checked_requests c join v_request_projected p using (scenario_id)
    where c.ok and c.user_id in (select id from v_users)""")
def history_append(d: Domain) -> DataFrame:
    return _kept_history(d)


def _kept_history(d: Domain, batch: str | None = None, times: int = 1) -> DataFrame:
    from muster.operators.scenarios import check_requests, split

    d = d.reduced()
    accepted = split(check_requests(d.scenario_requests()))[0]
    yearly = project_yearly(accepted, d.yearly_formula())
    documents_ = documents.result_json(yearly, _flat_metrics(d), accepted.columns)
    path = workspace(d.spark, "history")
    for _ in range(times):
        stored = tables.append_history(documents_, d.users(), path, batch=batch)
    rows = documents.parse_result(stored).withColumn("p", F.explode("result.predictions"))
    return rows.select(
        "id", "user_id", "start_year", "end_year", "recruitments", "departures", "initial_employees",
        "p.Year", "p.Total_Salary", "p.End_Employees",
    )


@query("history_append_once", ORACLE_BODIES["history_append"])
def history_append_once(d: Domain) -> DataFrame:
    """A batch of results that is kept twice is there once."""
    return _kept_history(d, batch="requests", times=2)


def _flat_metrics(d: Domain) -> DataFrame:
    return models.flatten_metrics(_metrics(d))


@query("metrics_load", f"""
    select round(r2, 4) as monthly_r2, {sig_sql('mse')} as monthly_mse, {sig_sql('round(sqrt(mse), 2)')} as monthly_rmse,
      {sig_sql('round(mae, 2)')} as monthly_mae, round(r2, 4) as yearly_r2, {sig_sql('mse')} as yearly_mse from ({_STATS})""")
def metrics_load(d: Domain) -> DataFrame:
    d, path = d.reduced(), workspace(d.spark, "metrics")
    described = _metrics(d).select(
        F.lit("yearly").alias("kind"), F.array(F.lit("nbemp")).alias("features"),
        F.struct("monthly", "yearly").alias("metrics"),
    )
    described.write.parquet(f"{path}/description")
    flat = models.flatten_metrics(models.load_metrics(d.spark, path, f"{path}/none"))
    return flat.select(*[F.col(c) if c.endswith("r2") else sig(F.col(c)).alias(c) for c in flat.columns])


@query("result_json", f"""
    select p.scenario_id, 'success' as status, p."Year", p."Total_Salary", p."End_Employees", round(m.r2, 4) as monthly_r2
    from v_projected p, ({_STATS}) m""")
def result_json(d: Domain) -> DataFrame:
    d = d.reduced()
    scenarios = d.scenarios()
    yearly = project_yearly(scenarios, d.yearly_formula())
    docs = documents.result_json(yearly, _flat_metrics(d), scenarios.columns)
    parsed = documents.parse_result(docs).withColumn("p", F.explode("result.predictions"))
    return parsed.select(
        "scenario_id", "result.status", "p.Year", "p.Total_Salary", "p.End_Employees",
        F.col("result.metrics.monthly_r2").alias("monthly_r2"),
    )


@query("chart_series", f"""
    select entity, "year"::varchar as label, unnest(['salary', 'employees', 'departures', 'recruitments',
        'avg_salary_by_year', 'departures_by_year']) as series,
      unnest([mass_salary, number_employees::double, departures::double, recruitment::double,
        {money_sql('mass_salary / number_employees')}, departures::double]) as value
    from v_historical""")
def chart_series(d: Domain) -> DataFrame:
    return documents.chart_series(d.historical())


@query("chart_json", f"""
    select entity, series, list(label order by label) as labels,
      list(printf('%.2f', value) order by label) as "values"
    from (select entity, "year"::varchar as label, unnest(['salary', 'employees', 'departures', 'recruitments',
        'avg_salary_by_year', 'departures_by_year']) as series,
      unnest([mass_salary, number_employees::double, departures::double, recruitment::double,
        {money_sql('mass_salary / number_employees')}, departures::double]) as value
      from v_historical) group by 1, 2""")
def chart_json(d: Domain) -> DataFrame:
    """The drawing's document, read back: numbers are written alike by both engines only to the cent."""
    charts = documents.chart_json(documents.chart_series(d.historical()))
    read = charts.withColumn("c", F.from_json("chart", "labels array<string>, values array<double>"))
    cents = F.transform("c.values", lambda v: F.format_string("%.2f", v))
    return read.select("entity", "series", F.col("c.labels").alias("labels"), cents.alias("values"))


@query("row_counts", """
    select 'employees' as "table", count(*) as "rows" from v_employees
    union all select 'users', count(*) from v_users
    union all select 'recruitment', count(*) from v_recruitment
    union all select 'termination', count(*) from v_termination
    union all select 'prediction_history', count(*) from v_history""")
def count_tables(d: Domain) -> DataFrame:
    return row_counts({
        "employees": d.employees(), "users": d.users(), "recruitment": d.recruitment(),
        "termination": d.termination(), "prediction_history": d.history(),
    })
