"""Filters, predicates and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.catalog.domain import Domain
from muster.catalog.registry import plain, query
from muster.operators import clean, employees, intake, ranking, scenarios, search
from muster.plans.dashboard import employee_listing
from muster.schemas import SCENARIO_FIELDS
from muster.session import workspace
from muster.sources import snapshots


@query("search_employees", """
    select matricule, first_name, last_name from v_employees
    where lower(first_name) like '%b_ild%' or lower(last_name) like '%b_ild%' or matricule::varchar like '%b_ild%'
    union all
    select matricule, first_name, last_name from v_employees
    where lower(first_name) like '%7%3%' or lower(last_name) like '%7%3%' or matricule::varchar like '%7%3%'""")
def search_scan(d: Domain) -> DataFrame:
    staff = d.employees()
    found = employees.search_employees(staff, " B_ILD ").unionByName(employees.search_employees(staff, "7%3"))
    return found.select("matricule", "first_name", "last_name")


@query("filter_corps_grade", "select matricule, corps, grade from v_employees where corps = 'BUILDING' and grade = 'A2'")
def corps_grade(d: Domain) -> DataFrame:
    return employees.filter_corps_grade(d.employees(), "BUILDING", "A2").select("matricule", "corps", "grade")


@query("filter_status", """
    select 'active' as asked, matricule from v_employees where date_left is null
    union all select 'terminated', matricule from v_employees where date_left is not null
    union all select 'all', matricule from v_employees""")
def status(d: Domain) -> DataFrame:
    return employees.by_status(d.employees().select("matricule", "date_left")).select("asked", "matricule")


@query("filter_join_year", """
    select matricule, strftime(date_joined, '%Y-%m-%d') as date_joined from v_employees where year(date_joined) = 1996""")
def join_year(d: Domain) -> DataFrame:
    return plain(employees.filter_join_year(d.employees(), 1996).select("matricule", "date_joined"))


@query("employee_listing", """
    select matricule, first_name, last_name, corps, grade from v_employees
    where (lower(first_name) like '%a%' or lower(last_name) like '%a%' or matricule::varchar like '%a%')
      and corps = 'AUTOMOBILE' and date_left is not null and year(date_joined) = 1995""")
def listing(d: Domain) -> DataFrame:
    found = employee_listing(d.employees(), search="A", corps="AUTOMOBILE", status="terminated", year=1995)
    return found.select("matricule", "first_name", "last_name", "corps", "grade")


@query("lookup_by_key", """
    select p.p_partkey as matricule, e.first_name, e.last_name, e.matricule is not null as found
    from part p left join v_employees e on p.p_partkey = e.matricule""")
def lookup(d: Domain) -> DataFrame:
    keys = d.raw("part").select(F.col("p_partkey").alias("matricule"))
    return employees.lookup_by_key(keys, d.employees()).select("matricule", "first_name", "last_name", "found")


@query("user_history", """
    select id, user_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from v_history where user_id = 7""")
def user_history(d: Domain) -> DataFrame:
    rows = ranking.newest_first(d.history().filter("user_id = 7"), "created_at", "id")
    return plain(rows.select("id", "user_id", "created_at"))


@query("scenario_missing_fields", "select scenario_id, missing from v_parsed_requests")
def missing_fields(d: Domain) -> DataFrame:
    return scenarios.missing_fields(d.scenario_requests()).select("scenario_id", "missing")


_NUMERIC = " and ".join(f"{f} is not null" for f in SCENARIO_FIELDS)


@query("scenario_parse_ints", f"""
    select scenario_id, {', '.join(SCENARIO_FIELDS)}, {_NUMERIC} as numeric from v_parsed_requests""")
def parse_ints(d: Domain) -> DataFrame:
    return scenarios.parse_ints(d.scenario_requests()).select("scenario_id", *SCENARIO_FIELDS, "numeric")


@query("scenario_validate", """
    select scenario_id, coalesce(message, '') as message, message is null as ok from (
      select *, case when start_year < 2000 or start_year > 2100 then 'Invalid start year (2000-2100)'
        when end_year < start_year then 'End year must be greater than or equal to start year'
        when end_year - start_year > 20 then 'Maximum range: 20 years'
        when recruitments < 0 or departures < 0 or initial_employees < 0 then 'Values must be positive'
        when initial_employees = 0 then 'Initial employees cannot be zero' end as message from v_scenario_table)""")
def validate(d: Domain) -> DataFrame:
    checked = scenarios.validate(d.scenario_table())
    return checked.select("scenario_id", F.coalesce("message", F.lit("")).alias("message"), "ok")


@query("scenario_split", """
    select case when ok then 'predict' else 'refuse' end as branch, scenario_id, coalesce(message, '') as message
    from v_checked_requests""")
def split(d: Domain) -> DataFrame:
    checked = scenarios.branch(scenarios.check_requests(d.scenario_requests()))
    return checked.select("branch", "scenario_id", F.coalesce("message", F.lit("")).alias("message"))


@query("employee_intake_validate", """
    select seq, reason is null as accepted, coalesce(reason, '') as reason,
      case when reason is null then matricule end as matricule, case when reason is null then first_name end as first_name,
      case when reason is null then last_name end as last_name,
      case when reason is null then strftime(birth_date, '%Y-%m-%d') end as birth_date,
      case when reason is null then echelon end as echelon,
      case when reason is null then salaire_base::double end as salaire_base,
      case when reason is null then indemnite_transport::double end as indemnite_transport,
      case when reason is null then nombre_enfants end as nombre_enfants
    from v_intake""")
def intake_validate(d: Domain) -> DataFrame:
    checked = plain(intake.validate_forms(d.intake_forms()))
    shown = [
        "matricule", "first_name", "last_name", "birth_date", "echelon", "salaire_base", "indemnite_transport",
        "nombre_enfants",
    ]
    ok = F.col("reason").isNull()
    return checked.select(
        "seq", ok.alias("accepted"), F.coalesce("reason", F.lit("")).alias("reason"),
        *[F.when(ok, F.col(c)).alias(c) for c in shown],
    )


@query("termination_validate", """
    select seq, matricule, strftime(date_left, '%Y-%m-%d') as date_left, coalesce(reason, '') as reason from v_terminations""")
def termination_validate(d: Domain) -> DataFrame:
    checked = intake.validate_terminations(d.termination_requests(), d.employees())
    return plain(checked.withColumn("reason", F.coalesce("reason", F.lit(""))))


@query("edit_guard", """
    select f.seq, f.matricule from v_edit_forms f join v_employees e on f.matricule = e.matricule where e.date_left is null""")
def edit_guard(d: Domain) -> DataFrame:
    return intake.edit_guard(d.edit_forms(), d.employees()).select("seq", "matricule")


@query("drop_incomplete", """
    select d.entity, d."Year", d."Month", d.nb_departures, s.mass_salary, s.nbemp from v_monthly_departures d
    join v_monthly_salary s on d.entity = s.entity and d."Year" = s."Year" and d."Month" = s."Month" """)
def drop_incomplete(d: Domain) -> DataFrame:
    salary, departures, _ = d.monthly_sources()
    return clean.drop_incomplete(departures.join(salary, ["entity", "Year", "Month"], "left"))


@query("account_format_check", """
    select id, contains(email_adress, '@') and contains(split(email_adress, '@')[-1], '.') as valid_email,
      length(username) between 3 and 64 as valid_username from v_users""")
def account_format(d: Domain) -> DataFrame:
    return employees.account_format_check(d.users()).select("id", "valid_email", "valid_username")


@query("user_active", """
    select u.id, u.matricule, e.date_left is null as active
    from v_users u left join v_employees e on u.matricule = e.matricule""")
def user_active(d: Domain) -> DataFrame:
    return employees.user_active(d.users(), d.employees()).select("id", "matricule", "active")


_FOUND = """select '{0}' as term, matricule, first_name, last_name from v_employees
    where lower(first_name) like '%{0}%' or lower(last_name) like '%{0}%' or matricule::varchar like '%{0}%'"""


@query("search_employees_indexed", " union all ".join(_FOUND.format(t) for t in ("uild", "00012", "#0000", "b_ild", "73")))
def search_indexed(d: Domain) -> DataFrame:
    """Terms looked up in trigram postings of a snapshot, and two that need the scan."""
    path, stored = workspace(d.spark, "staff"), workspace(d.spark, "postings")
    snapshots.create(d.employees(), "employees", path, buckets=16)
    found = None
    for term in ("uild", "00012", "#0000", "b_ild", "73"):
        own = search.search_snapshot(d.spark, path, stored, term.upper()).select(F.lit(term).alias("term"), "matricule", "first_name", "last_name")
        found = own if found is None else found.unionByName(own)
    return found
