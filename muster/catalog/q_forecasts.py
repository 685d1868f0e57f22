"""Scenario expansion and forecasting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.catalog.domain import Domain
from muster.catalog.registry import query, sig
from muster.catalog.views_sql import money as money_sql
from muster.catalog.views_sql import sig as sig_sql
from muster.operators import projection, scenarios, scoring
from muster.plans.backtest import backtest as run_backtest
from muster.plans.backtest import bias_correction, compare_history
from muster.plans.predict import forecast_from_last_known, keep_history, predict_batch
from muster.session import workspace
from muster.sources.documents import parse_result


@query("expand_years", """
    select scenario_id, unnest(range(start_year, end_year + 1)) as "Year" from v_scenarios""")
def expand_years(d: Domain) -> DataFrame:
    return scenarios.expand_years(d.scenarios()).select("scenario_id", "Year")


@query("expand_months", """
    select scenario_id, y as "Year", m as "Month" from
      (select scenario_id, unnest(range(start_year, end_year + 1)) as y from v_scenarios), range(1, 13) t(m)""")
def expand_months(d: Domain) -> DataFrame:
    months = scenarios.expand_months(scenarios.expand_years(d.scenarios()))
    return months.select("scenario_id", "Year", "Month")


@query("headcount_path", """
    select scenario_id, "Year", cast(n as bigint) as employees, "End_Employees" as end_employees from v_projected""")
def headcount_path(d: Domain) -> DataFrame:
    return scenarios.headcount_path(d.scenarios()).select("scenario_id", "Year", "employees", "end_employees")


_YEARLY = """select scenario_id, "Year", "Total_Salary", "End_Employees" from v_projected"""


@query("project_yearly", _YEARLY)
def project_yearly(d: Domain) -> DataFrame:
    yearly = projection.project_yearly(scenarios.spread(d.scenarios()), d.yearly_formula())
    return yearly.select("scenario_id", "Year", "Total_Salary", "End_Employees")


_SPLIT = f"""
    select scenario_id, "Year", m as "Month", monthname(make_date("Year"::int, m::int, 1)) as "Month_Name",
      {money_sql('salary / 12')} as "Predicted_Salary",
      cast(round_even(n + (m - 1)::double * (net / 12), 0) as bigint) as "Employees"
    from v_projected, range(1, 13) t(m)"""


@query("project_monthly_split", _SPLIT)
def project_monthly_split(d: Domain) -> DataFrame:
    monthly = projection.monthly_split(projection.project_yearly(scenarios.spread(d.scenarios()), d.yearly_formula()))
    return monthly.select("scenario_id", "Year", "Month", "Month_Name", "Predicted_Salary", "Employees")


@query("project_monthly_model", f"""
    select scenario_id, "Year", "Month", {money_sql('prediction')} as "Predicted_Salary",
      cast(round_even(nbemp, 0) as bigint) as "Employees" from v_monthly_scored""")
def project_monthly_model(d: Domain) -> DataFrame:
    monthly, _ = projection.project_monthly(scenarios.spread(d.scenarios()), d.monthly_formula())
    return monthly.select("scenario_id", "Year", "Month", "Predicted_Salary", "Employees")


@query("project_monthly_totals", f"""
    select scenario_id, "Year", {money_sql('sum(prediction order by "Month")')} as "Total_Salary",
      cast(round_even(max(case when "Month" = 12 then lft end), 0) as bigint) as "End_Employees"
    from v_monthly_scored group by 1, 2""")
def project_monthly_totals(d: Domain) -> DataFrame:
    _, yearly = projection.project_monthly(scenarios.spread(d.scenarios()), d.monthly_formula())
    return yearly.select("scenario_id", "Year", "Total_Salary", "End_Employees")


@query("project_monthly_batch", f"""
    select scenario_id, start_year + t // 12 as "Year",
      {money_sql('sum(greatest(0.0::double, greatest(0.0::double, level) * slope + intercept) order by t)')} as total_yearly_salary,
      {money_sql('sum(greatest(0.0::double, greatest(0.0::double, level) * slope + intercept) order by t) / 12')} as avg_monthly_salary,
      max(case when t % 12 = 11 then lft end) as employees_end_of_year
    from v_batch_walk, v_monthly_line group by 1, 2""")
def project_monthly_batch(d: Domain) -> DataFrame:
    out = projection.project_monthly_batch(scenarios.spread(d.scenarios()), d.monthly_formula())
    return out.select("scenario_id", "Year", "total_yearly_salary", "avg_monthly_salary", "employees_end_of_year")


def _corrected(projected: str, end: str) -> str:
    return f"""
    select p.scenario_id, p."Year", {sig_sql('p."Total_Salary" * coalesce(f.factor, 1)', 9)} as "Total_Salary"
    from {projected} p join v_scenarios s using (scenario_id) left join v_factor{end} f on s.entity = f.entity"""


def _bias(d: Domain, kind: str) -> DataFrame:
    d = d.reduced()
    _, yearly = bias_correction(d.scenarios(), d.historical(), d.formula(kind), ["entity"])
    return yearly.select("scenario_id", "Year", sig(F.col("Total_Salary"), 9).alias("Total_Salary"))


@query("bias_correction", _corrected("v_projected", ""))
def bias(d: Domain) -> DataFrame:
    return _bias(d, "yearly")


@query("bias_correction_monthly", _corrected("v_monthly_totals", "_monthly"))
def bias_monthly(d: Domain) -> DataFrame:
    return _bias(d, "monthly")


def _tested(end: str) -> str:
    return f"""
    select b.*, m.mae, m.mape from v_backtest{end} b join (select entity, {money_sql('avg(abs_error)')} as mae,
      {money_sql('avg(pct_error)')} as mape from v_errors{end} group by entity) m using (entity)"""


def _backtest(d: Domain, kind: str) -> DataFrame:
    d = d.reduced()
    tested = run_backtest(d.historical().withColumn("ordinal", F.col("year")), d.formula(kind))
    return tested.rows.join(tested.metrics.drop("num_years"), "entity")


@query("backtest", _tested(""))
def backtest(d: Domain) -> DataFrame:
    return _backtest(d, "yearly")


@query("backtest_monthly", _tested("_monthly"))
def backtest_monthly(d: Domain) -> DataFrame:
    return _backtest(d, "monthly")


def _predicted(projected: str, end: str) -> str:
    return f"""
    select c.scenario_id as id, c.user_id, p."Year", {sig_sql('p."Total_Salary" * coalesce(f.factor, 1)', 9)} as "Total_Salary",
      p."End_Employees", round(m.r2, 4) as monthly_r2
    from v_checked_requests c join {projected} p using (scenario_id) left join v_factor{end} f on c.entity = f.entity,
      (select 1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual) as r2 from v_compared{end}) m
    where c.ok and c.user_id in (select id from v_users)"""


def _predict(d: Domain, kind: str) -> DataFrame:
    d = d.reduced()
    model, history = d.formula(kind), d.historical()
    m = scoring.regression_metrics(compare_history(history, model))
    metrics = m.select(F.struct("mse", "rmse", "mae", "r2").alias("monthly"), F.struct("mse", "r2").alias("yearly"))
    done = predict_batch(d.scenario_requests(), history, model, metrics)
    kept = keep_history(done, d.users(), workspace(d.spark, "predictions"))
    rows = parse_result(kept).withColumn("p", F.explode("result.predictions"))
    return rows.select(
        "id", "user_id", "p.Year", sig(F.col("p.Total_Salary"), 9).alias("Total_Salary"), "p.End_Employees",
        F.col("result.metrics.monthly_r2").alias("monthly_r2"),
    )


@query("predict_batch", _predicted("v_request_projected", ""))
def predict(d: Domain) -> DataFrame:
    return _predict(d, "yearly")


@query("predict_batch_monthly", _predicted("v_request_monthly_totals", "_monthly"))
def predict_monthly(d: Domain) -> DataFrame:
    return _predict(d, "monthly")


@query("refused_requests", "select scenario_id, entity, message from v_checked_requests where not ok")
def refused(d: Domain) -> DataFrame:
    checked = scenarios.split(scenarios.check_requests(d.scenario_requests()))[1]
    return checked.select("scenario_id", "entity", "message")


@query("forecast_last_known", f"""
    select entity, 2021 as "Year", {money_sql('sum(greatest(0.0::double, greatest(0.0::double, level) * slope + intercept) order by t)')}
      as total_yearly_salary, max(case when t % 12 = 11 then lft end) as employees_end_of_year
    from v_last_walk join v_last_scenarios using (scenario_id), v_monthly_line group by entity""")
def forecast_last_known(d: Domain) -> DataFrame:
    d = d.reduced()
    moves = d.scenario_table().groupBy("entity").agg(
        F.max("departures").alias("departures"), F.max("recruitments").alias("recruitments"))
    out = forecast_from_last_known(d.merged_monthly(), moves, 2021, d.monthly_formula())
    return out.select("entity", "Year", "total_yearly_salary", "employees_end_of_year")
