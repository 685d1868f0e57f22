"""Aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.catalog.domain import Domain
from muster.catalog.registry import ORACLE_BODIES, plain, query, sig
from muster.catalog.views_sql import money as money_sql
from muster.catalog.views_sql import sig as sig_sql
from muster.operators import audits, clean, kept, rollups, scoring
from muster.session import workspace
from muster.sources.documents import chart_series


@query("yearly_salary", """
    select entity, "Year", mass_salary, nbemp from v_yearly_salary""")
def yearly_salary(d: Domain) -> DataFrame:
    return rollups.yearly_salary(d.monthly_salary()).withColumn("mass_salary", F.round("mass_salary", 2))


@query("yearly_departures", "select * from v_yearly_departures")
def yearly_departures(d: Domain) -> DataFrame:
    return rollups.yearly_sum(d.monthly_departures(), "nb_departures")


@query("yearly_recruitments", "select * from v_yearly_recruitments")
def yearly_recruitments(d: Domain) -> DataFrame:
    return rollups.yearly_sum(d.monthly_recruitments(), "Recruitments")


@query("dashboard_summary", """
    select entity, count(*) as total_records, max(number_employees) as max_employees,
      cast(sum(recruitment) as bigint) as total_recruitments, cast(sum(departures) as bigint) as total_departures
    from v_historical group by entity""")
def dashboard_summary(d: Domain) -> DataFrame:
    return rollups.dashboard_summary(d.historical())


@query("distinct_corps", "select distinct corps from v_employees where corps <> ''")
def distinct_corps(d: Domain) -> DataFrame:
    return rollups.distinct_codes(d.employees(), "corps")


@query("distinct_grades", "select distinct grade from v_employees where grade <> ''")
def distinct_grades(d: Domain) -> DataFrame:
    return rollups.distinct_codes(d.employees(), "grade")


@query("distinct_join_years", """
    select distinct cast(year(date_joined) as int) as "year" from v_employees where date_joined is not null""")
def distinct_join_years(d: Domain) -> DataFrame:
    return rollups.distinct_join_years(d.employees())


_COLUMNS = ["nb_departures", "Recruitments", "mass_salary", "nbemp"]
_NULLS = ", ".join(f'count(*) filter ("{c}" is null) as "{c}"' for c in _COLUMNS)


@query("missing_counts", f"""
    select d.entity, {_NULLS} from v_monthly_departures d
    left join v_monthly_recruitments r on d.entity = r.entity and d."Year" = r."Year" and d."Month" = r."Month"
    left join v_monthly_salary s on d.entity = s.entity and d."Year" = s."Year" and d."Month" = s."Month" group by d.entity""")
def missing_counts(d: Domain) -> DataFrame:
    salary, departures, recruitments = d.monthly_sources()
    keys = ["entity", "Year", "Month"]
    merged = departures.join(recruitments, keys, "left").join(salary, keys, "left")
    return clean.missing_counts(merged, ["entity"]).select("entity", *_COLUMNS)


def metrics_sql(actual: str, predicted: str, source: str, by: str) -> str:
    return f"""
    select {by}, n, {sig_sql('mse')} as mse, {sig_sql('sqrt(mse)')} as rmse, {sig_sql('mae')} as mae,
      round(1 - mse / nullif(spread, 0), 6) as r2, round(mape, 6) as mape
    from (select {by}, count(*) as n, avg(({actual} - {predicted}) * ({actual} - {predicted})) as mse,
        avg(abs({actual} - {predicted})) as mae, var_pop({actual}) as spread,
        case when count(*) filter ({actual} = 0) = 0 then avg(abs(({actual} - {predicted}) / {actual})) * 100 end as mape
      from {source} group by {by})"""


def shown_metrics(metrics: DataFrame, *by: str) -> DataFrame:
    return metrics.select(
        *by, "n", sig(F.col("mse")).alias("mse"), sig(F.col("rmse")).alias("rmse"), sig(F.col("mae")).alias("mae"),
        F.round("r2", 6).alias("r2"), F.round("mape", 6).alias("mape"),
    )


@query("regression_metrics", metrics_sql("actual", "predicted", "v_compared", "entity"))
def regression_metrics(d: Domain) -> DataFrame:
    return shown_metrics(scoring.regression_metrics(d.compared(), by=["entity"]), "entity")


@query("predictions_to_yearly", metrics_sql("a", "p", """(
    select entity, "Year", sum(mass_salary) as a, sum(predicted_salary) as p from v_monthly_predictions group by 1, 2)""", "entity"))
def predictions_to_yearly(d: Domain) -> DataFrame:
    yearly = scoring.predictions_to_yearly(d.monthly_predictions())
    metrics = scoring.regression_metrics(yearly, "actual_yearly_salary", "predicted_yearly_salary", ["entity"])
    return shown_metrics(metrics, "entity")


@query("backtest_rows", "select * from v_backtest")
def backtest_rows(d: Domain) -> DataFrame:
    return scoring.backtest_rows(d.compared())


@query("backtest_metrics", f"""
    select entity, {money_sql('avg(abs_error)')} as mae, {money_sql('avg(pct_error)')} as mape, count(*) as num_years
    from v_errors group by entity""")
def backtest_metrics(d: Domain) -> DataFrame:
    return scoring.backtest_metrics(d.compared(), ["entity"])


_SUMS = "(select entity, sum(actual) as a, sum(predicted) as p, count(*) as n from v_backtest group by entity)"


@query("backtest_footer", f"""
    select entity, line, round(actual, 6) as actual, round(predicted, 6) as predicted, round(difference, 6) as difference,
      round(error_percent, 6) as error_percent
    from (select entity, 'TOTAL' as line, a as actual, p as predicted, p - a as difference, abs(p - a) / a * 100 as error_percent
        from {_SUMS}
      union all select entity, 'AVERAGE', a / n, p / n, (p - a) / n, mape from {_SUMS} join (
        select entity, {money_sql('avg(pct_error)')} as mape from v_errors group by entity) using (entity))""")
def backtest_footer(d: Domain) -> DataFrame:
    footer = scoring.backtest_footer(d.compared(), ["entity"])
    return footer.select(
        "entity", "line", *[F.round(c, 6).alias(c) for c in ("actual", "predicted", "difference")],
        F.round("error_percent", 6).alias("error_percent"),
    )


@query("error_band", """
    select entity, "year", case when error_percent < 5 then 'good' when error_percent < 10 then 'warn' else 'bad' end as band,
      case when difference >= 0 then '+' else '-' end as sign from v_backtest""")
def error_band(d: Domain) -> DataFrame:
    return scoring.error_band(scoring.backtest_rows(d.compared())).select("entity", "year", "band", "sign")


@query("signed_bias", """
    select entity, round(avg(case when actual > 0 then (predicted - actual) / actual else 0.0::double end), 9) as bias
    from v_compared group by entity""")
def signed_bias(d: Domain) -> DataFrame:
    return scoring.signed_bias(d.compared(), ["entity"]).withColumn("bias", F.round("bias", 9))


@query("avg_monthly_salary", f"""
    select entity, "Year", {money_sql('mass_salary / 12')} as avg_monthly_salary from v_yearly_salary""")
def avg_monthly_salary(d: Domain) -> DataFrame:
    yearly = rollups.yearly_salary(d.monthly_salary()).withColumn("mass_salary", F.round("mass_salary", 2))
    return rollups.avg_monthly_salary(yearly).select("entity", "Year", "avg_monthly_salary")


@query("movements_by_year", """
    select 'recruitment' as kind, matricule, first_name || ' ' || last_name as full_name, day(recruitment_date) as "day",
      month(recruitment_date) as "month", year(recruitment_date) as "year", coalesce(nullif(corps, ''), '-') as corps,
      coalesce(nullif(grade, ''), '-') as grade
    from v_recruitment where year(recruitment_date) = 1998
    union all
    select 'termination', matricule, first_name || ' ' || last_name, day(termination_date), month(termination_date),
      year(termination_date), coalesce(nullif(corps, ''), '-'), coalesce(nullif(grade, ''), '-')
    from v_termination where year(termination_date) = 1998""")
def movements_by_year(d: Domain) -> DataFrame:
    hires = rollups.movements_of_year(d.recruitment(), "recruitment_date", 1998)
    exits = rollups.movements_of_year(d.termination(), "termination_date", 1998)
    return hires.withColumn("kind", F.lit("recruitment")).unionByName(exits.withColumn("kind", F.lit("termination")))


@query("movement_counts", """
    select 'recruitment' as kind, cast(year(recruitment_date) as int) as "year", count(*) as movements from v_recruitment group by 2
    union all
    select 'termination', cast(year(termination_date) as int), count(*) from v_termination group by 2""")
def movement_counts(d: Domain) -> DataFrame:
    hires = rollups.movement_counts(d.recruitment(), "recruitment_date").withColumn("kind", F.lit("recruitment"))
    exits = rollups.movement_counts(d.termination(), "termination_date").withColumn("kind", F.lit("termination"))
    return hires.unionByName(exits)


@query("duplicate_keys", """
    select 'termination.id' as rule, id::varchar as key, count(*) as "rows" from v_termination group by id having count(*) > 1
    union all select 'users.username', username, count(*) from v_users group by username having count(*) > 1
    union all select 'recruitment.matricule', matricule::varchar, count(*) from v_recruitment group by matricule
      having count(*) > 1""")
def duplicate_keys(d: Domain) -> DataFrame:
    return _duplicates(d, rollups.duplicate_keys)


def _duplicates(d: Domain, duplicate_keys: Callable[..., DataFrame]) -> DataFrame:
    found = {
        "termination.id": duplicate_keys(d.termination(), "id"),
        "users.username": duplicate_keys(d.users(), "username"),
        "recruitment.matricule": duplicate_keys(d.recruitment(), "matricule"),
    }
    named = [df.select(F.lit(rule).alias("rule"), "key", "rows") for rule, df in found.items()]
    return plain(named[0].unionByName(named[1]).unionByName(named[2]))


@query("duplicate_keys_by_slot", ORACLE_BODIES["duplicate_keys"])
def duplicate_keys_by_slot(d: Domain) -> DataFrame:
    """The same audit with unique rows left where they are."""
    return _duplicates(d, audits.duplicate_keys)


def _kept(d: Domain) -> DataFrame:
    """Figures after the monthly rows came in three batches, of which one came twice."""
    path, sources = workspace(d.spark, "parts"), d.reduced().monthly_sources()
    for batch in (0, 2, 1, 2):
        own = [df.filter(F.col("Month") % 3 == batch) for df in sources]
        kept.add(d.spark, path, f"months-{batch}", salary=own[0], departures=own[1], recruitments=own[2])
    return kept.merged(d.spark, path)


@query("kept_yearly_salary", ORACLE_BODIES["yearly_salary"])
def kept_yearly_salary(d: Domain) -> DataFrame:
    return kept.yearly_salary(_kept(d)).withColumn("mass_salary", F.round("mass_salary", 2))


@query("kept_yearly_departures", ORACLE_BODIES["yearly_departures"])
def kept_yearly_departures(d: Domain) -> DataFrame:
    return kept.yearly_departures(_kept(d))


@query("kept_yearly_recruitments", ORACLE_BODIES["yearly_recruitments"])
def kept_yearly_recruitments(d: Domain) -> DataFrame:
    return kept.yearly_recruitments(_kept(d))


@query("kept_dashboard_summary", ORACLE_BODIES["dashboard_summary"])
def kept_dashboard_summary(d: Domain) -> DataFrame:
    return rollups.dashboard_summary(kept.historical(_kept(d)))


@query("kept_chart_series", f"""
    select entity, "year"::varchar as label, unnest(['salary', 'employees', 'departures', 'recruitments',
        'avg_salary_by_year', 'departures_by_year']) as series,
      unnest([mass_salary, number_employees::double, departures::double, recruitment::double,
        {money_sql('mass_salary / number_employees')}, departures::double]) as value
    from v_historical""")
def kept_chart_series(d: Domain) -> DataFrame:
    return chart_series(kept.historical(_kept(d)))
