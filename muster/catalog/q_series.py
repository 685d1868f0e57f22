"""Window features, sorts and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.catalog.domain import Domain
from muster.catalog.registry import plain, query
from muster.operators import projection, ranking, regression, series
from muster.schemas import MONTHLY_FEATURES

MONTH = ["entity", "Year", "Month"]


@query("annual_recruitments", 'select entity, "Year", "Month", cumulative_recruitments::bigint as cumulative_recruitments from v_monthly_features')
def annual_recruitments(d: Domain) -> DataFrame:
    return series.annual_recruitments(d.merged_monthly()).select(*MONTH, "cumulative_recruitments")


@query("cumulative_net_change", 'select entity, "Year", "Month", cumulative_net_change::bigint as cumulative_net_change from v_monthly_features')
def cumulative_net_change(d: Domain) -> DataFrame:
    net = series.net_change(d.merged_monthly(), "net_employee_change")
    return series.cumulative_net_change(net).select(*MONTH, "cumulative_net_change")


@query("lag_features", 'select entity, "Year", prev_salary0 as prev_salary, prev_employees0 as prev_employees from v_yearly_features')
def lag_features(d: Domain) -> DataFrame:
    return series.lag_features(d.merged_yearly()).select("entity", "Year", "prev_salary", "prev_employees")


@query("growth_rates", """
    select entity, "Year", round(salary_growth0, 9) as salary_growth, round(employee_growth0, 9) as employee_growth
    from v_yearly_features""")
def growth_rates(d: Domain) -> DataFrame:
    return series.growth_rates(d.merged_yearly()).select(
        "entity", "Year", F.round("salary_growth", 9).alias("salary_growth"),
        F.round("employee_growth", 9).alias("employee_growth"),
    )


@query("backfill_then_zero", """
    select entity, "Year", prev_salary, prev_employees from v_yearly_features""")
def backfill(d: Domain) -> DataFrame:
    columns = ["prev_salary", "prev_employees"]
    filled = series.backfill_then_zero(series.lag_features(d.merged_yearly()), columns, ["Year"])
    return filled.select("entity", "Year", *columns)


_YEARLY = ["salary_growth", "employee_growth", "salary_per_employee"]


@query("yearly_features", f"""
    select entity, "Year", nbemp, nb_departures, "Recruitments", net_change, prev_salary, prev_employees,
      {', '.join(f'round({c}, 6) as {c}' for c in _YEARLY)} from v_yearly_features""")
def yearly_features(d: Domain) -> DataFrame:
    return series.yearly_features(d.merged_yearly()).select(
        "entity", "Year", "nbemp", "nb_departures", "Recruitments", "net_change", "prev_salary", "prev_employees",
        *[F.round(c, 6).alias(c) for c in _YEARLY],
    )


@query("monthly_features", """
    select entity, "Year", "Month", mass_salary, nbemp, nb_departures, cumulative_recruitments::bigint as cumulative_recruitments,
      cumulative_net_change::bigint as cumulative_net_change, year_normalized, round(avg_salary_per_emp, 6) as avg_salary_per_emp
    from v_monthly_features""")
def monthly_features(d: Domain) -> DataFrame:
    return series.monthly_features(d.merged_monthly()).select(
        *MONTH, "mass_salary", "nbemp", "nb_departures", "cumulative_recruitments", "cumulative_net_change",
        "year_normalized", F.round("avg_salary_per_emp", 6).alias("avg_salary_per_emp"),
    )


@query("export_features", """
    select entity, "Year", "Month", nb_departures, cumulative_recruitments / 12 as monthly_recruitment_effect, nbemp, mass_salary
    from v_monthly_features""")
def export_features(d: Domain) -> DataFrame:
    return series.export_features(d.merged_monthly()).select(
        *MONTH, "nb_departures", "monthly_recruitment_effect", "nbemp", "mass_salary"
    )


@query("first_row_per_year", """
    select cast(o_custkey % 25 as int) as entity, cast(year(o_orderdate) as int) as "year",
      arg_min(o_totalprice, o_orderkey) as mass_salary, min(o_orderkey) as ordinal
    from orders group by 1, 2""")
def first_row_per_year(d: Domain) -> DataFrame:
    return series.first_row_per_year(d.historical_copies())


@query("last_known", """
    select entity, arg_max(nbemp, "Year" * 100 + "Month") as last_employees, max("Year" * 100 + "Month") as last_period
    from v_merged group by entity""")
def last_known(d: Domain) -> DataFrame:
    return series.last_known(d.merged_monthly())


@query("history_numbering", """
    select id, user_id, row_number() over (partition by user_id order by created_at desc, id) as position from v_history""")
def history_numbering(d: Domain) -> DataFrame:
    numbered = ranking.number_rows(
        d.history().select("id", "user_id", "created_at"), "user_id", [F.desc("created_at"), F.col("id")], "position"
    )
    return numbered.select("id", "user_id", "position")


@query("tick_thinning", """
    select scenario_id, y || '-' || lpad(m::varchar, 2, '0') as "Period" from (
      select *, row_number() over (partition by scenario_id order by y, m) - 1 as i, count(*) over (partition by scenario_id) as n
      from (select scenario_id, unnest(range(start_year, end_year + 1)) as y from v_scenarios), range(1, 13) t(m))
    where i % greatest(1, n // 12) = 0""")
def tick_thinning(d: Domain) -> DataFrame:
    from muster.operators.scenarios import expand_months, expand_years

    months = expand_months(expand_years(d.scenarios()))
    return projection.tick_thinning(months).select("scenario_id", "Period")


@query("sort_years", 'select entity, "Year", "Month", mass_salary from v_merged')
def sort_years(d: Domain) -> DataFrame:
    return d.merged_monthly().select(*MONTH, "mass_salary").orderBy("entity", "Year", "Month")


@query("recent_recruitments", """
    select id, matricule, strftime(recruitment_date, '%Y-%m-%d') as recruitment_date from v_recruitment""")
def recent_recruitments(d: Domain) -> DataFrame:
    rows = d.recruitment().select("id", "matricule", "recruitment_date")
    return plain(ranking.newest_first(rows, "recruitment_date", "id"))


@query("recent_terminations", """
    select id, matricule, strftime(termination_date, '%Y-%m-%d') as termination_date from v_termination""")
def recent_terminations(d: Domain) -> DataFrame:
    rows = d.termination().select("id", "matricule", "termination_date")
    return plain(ranking.newest_first(rows, "termination_date", "id"))


@query("preview", "select matricule, first_name, last_name, grade, corps from v_employees order by matricule limit 5")
def preview(d: Domain) -> DataFrame:
    return ranking.preview(d.employees().select("matricule", "first_name", "last_name", "grade", "corps"), "matricule")


@query("first_match", """
    select matricule, last_name, corps from v_employees where corps = 'MACHINERY' and date_left is null order by matricule limit 1""")
def first_match(d: Domain) -> DataFrame:
    wanted = (F.col("corps") == "MACHINERY") & F.col("date_left").isNull()
    return ranking.first_match(d.employees(), wanted, "matricule").select("matricule", "last_name", "corps")


@query("tail_n", """
    select entity, "Year", "Month", mass_salary from (select *, row_number() over (partition by entity
      order by "Year" desc, "Month" desc) as back from v_merged) where back <= 12""")
def tail_n(d: Domain) -> DataFrame:
    return series.tail_n(d.merged_monthly(), 12, ["Year", "Month"]).select(*MONTH, "mass_salary")


@query("split_chronological", """
    select entity, "Year", "Month", case when row_number() over (partition by entity order by "Year" desc, "Month" desc)
      <= ceil(count(*) over (partition by entity) * 0.2::double) then 'test' else 'train' end as split from v_merged""")
def split_chronological(d: Domain) -> DataFrame:
    return series.split_chronological(d.merged_monthly(), ["Year", "Month"]).select(*MONTH, "split")


@query("split_random", """
    select entity, "Year", "Month", case when row_number() over (partition by entity
        order by md5(concat_ws('|', '42', entity, "Year", "Month")), entity, "Year", "Month")
      <= ceil(count(*) over (partition by entity) * 0.2::double) then 'test' else 'train' end as split from v_merged_inner""")
def split_random(d: Domain) -> DataFrame:
    return series.split_random(d.merged_inner(), MONTH).select(*MONTH, "split")


@query("split_random_sizes", """
    select entity, count(*) as "rows", cast(ceil(count(*) * 0.2::double) as bigint) as test_rows
    from v_merged_inner group by entity""")
def split_random_sizes(d: Domain) -> DataFrame:
    halves = series.split_random(d.merged_inner(), MONTH)
    return halves.groupBy("entity").agg(
        F.count("*").alias("rows"), F.count_if(F.col("split") == "test").alias("test_rows")
    )


_SCALED = ", ".join(
    f'round(("{c}" - avg("{c}") over ()) / stddev_pop("{c}") over (), 6) + 0.0 as "{c}"' for c in MONTHLY_FEATURES
)


@query("standardize", f'select entity, "Year" as y, "Month" as m, {_SCALED} from v_monthly_features')
def standardize(d: Domain) -> DataFrame:
    frame = d.reduced().monthly_training().select(
        "entity", F.col("Year").alias("y"), F.col("Month").alias("m"), *MONTHLY_FEATURES
    )
    scaled = regression.standardize(frame, MONTHLY_FEATURES)
    return scaled.select("entity", "y", "m", *[(F.round(c, 6) + 0.0).alias(c) for c in MONTHLY_FEATURES])
