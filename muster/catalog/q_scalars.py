"""Projections, cleaning and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.catalog.domain import Domain
from muster.catalog.registry import plain, query
from muster.catalog.views_sql import money as money_sql
from muster.catalog.views_sql import parse_date as parse_date_sql
from muster.catalog.views_sql import sanitize as sanitize_sql
from muster.functions import blank_to_null, month_name, parse_date, period_label, sanitize, strip
from muster.operators import clean, employees, regression, series
from muster.operators.projection import clamp_model_year
from muster.plans import dashboard
from muster.schemas import YEARLY_FEATURES
from muster.sources.documents import parse_result

_RAW_KEYS = """
    select entity, case when nb_departures % 10 = 0 then 'unknown' else ' ' || "Year" || chr(9) end as "Year",
      "Month" || case when nb_departures % 7 = 0 then '.7' else '' end as "Month", nb_departures
    from v_monthly_departures"""


@query("normalize_keys", _RAW_KEYS)
def normalize_keys(d: Domain) -> DataFrame:
    return clean.normalize_keys(d.departures_raw())


@query("coerce_keys", f"""
    select entity, cast(trunc(try_cast(trim("Year", ' ' || chr(9)) as double)) as int) as "Year",
      cast(trunc(try_cast("Month" as double)) as int) as "Month", nb_departures
    from ({_RAW_KEYS}) where try_cast(trim("Year", ' ' || chr(9)) as double) is not null""")
def coerce_keys(d: Domain) -> DataFrame:
    return clean.coerce_keys(clean.normalize_keys(d.departures_raw()))


@query("sanitize_text", f"""
    select doc_id, md5(t) as text_md5, length(t) as text_length, nullif(t, '') is null as blank
    from (select doc_id, {sanitize_sql("case when doc_id % 50 = 0 then '  ' else text end")} as t from documents)""")
def sanitize_text(d: Domain) -> DataFrame:
    text = "CASE WHEN doc_id % 50 = 0 THEN '  ' ELSE text END"
    clean_text = d.raw("documents").select("doc_id", F.expr(sanitize(text)).alias("t"))
    return clean_text.select(
        "doc_id", F.md5("t").alias("text_md5"), F.length("t").alias("text_length"),
        F.expr(blank_to_null("t")).isNull().alias("blank"),
    )


@query("parse_dates", f"""
    select seq, raw, strftime({parse_date_sql('raw')}, '%Y-%m-%d') as day, raw <> '' and {parse_date_sql('raw')} is null as bad
    from (select seq, trim(birth_date) as raw from v_intake_forms)""")
def parse_dates(d: Domain) -> DataFrame:
    raw = d.intake_forms().select("seq", F.expr(strip("birth_date")).alias("raw"))
    day = F.expr(parse_date("raw"))
    return raw.select(
        "seq", "raw", F.date_format(day, "yyyy-MM-dd").alias("day"),
        ((F.col("raw") != "") & day.isNull()).alias("bad"),
    )


@query("avg_salary", f"""
    select entity, "year", {money_sql('mass_salary / nullif(number_employees, 0)')} as avg_salary from v_historical""")
def avg_salary(d: Domain) -> DataFrame:
    return dashboard.avg_salary(d.historical()).select("entity", "year", "avg_salary")


@query("salary_thousands", """
    select entity, "year", mass_salary / 1000 as salary_thousands, number_employees from v_historical""")
def salary_thousands(d: Domain) -> DataFrame:
    return dashboard.salary_thousands(d.historical()).select("entity", "year", "salary_thousands", "number_employees")


@query("total_salary", """
    select matricule, cast(coalesce(salaire_base, 0) + coalesce(indemnite_residence, 0)
      + coalesce(indemnite_transport, 0) as double) as total_salary from v_employees""")
def total_salary(d: Domain) -> DataFrame:
    return plain(employees.total_salary(d.employees()).select("matricule", "total_salary"))


_RECORD = """matricule, first_name, last_name, strftime(birth_date, '%Y-%m-%d') as birth_date, grade, echelon, indice,
      corps, nullif(salaire_base::double, 0) as salaire_base, nullif(indemnite_residence::double, 0) as indemnite_residence,
      nullif(indemnite_transport::double, 0) as indemnite_transport, situation_familiale, nombre_enfants,
      strftime(date_joined, '%Y-%m-%d') as date_joined, strftime(date_titularisation, '%Y-%m-%d') as date_titularisation,
      strftime(date_left, '%Y-%m-%d') as date_left"""


@query("employee_record", f"select {_RECORD} from v_employees")
def employee_record(d: Domain) -> DataFrame:
    staff = d.employees()
    record = employees.employee_json(staff)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in employees.employee_record(staff).schema)
    return record.select(F.from_json("record", schema).alias("r")).select("r.*")


def _grouped(x: str) -> str:
    return f"format('{{:,.2f}}', {x}::double)"


def _amount(c: str) -> str:
    return f"case when {c} <> 0 then printf('%.2f', {c}::double) else '-' end as {c}"


@query("display_row", f"""
    select matricule, first_name || ' ' || last_name as full_name, coalesce(nullif(grade, ''), '-') as grade,
      case when echelon <> 0 then echelon::varchar else '-' end as echelon, coalesce(nullif(corps, ''), '-') as corps,
      {_amount('salaire_base')}, {_amount('indemnite_residence')}, {_amount('indemnite_transport')},
      case when salaire_base <> 0 then {_grouped('salaire_base')} else '-' end as salaire_base_grouped,
      coalesce(strftime(date_joined, '%Y-%m-%d'), '-') as date_joined,
      case when date_left is null then 'Active' else 'Terminated' end as status
    from v_employees""")
def display_row(d: Domain) -> DataFrame:
    return employees.display_row(d.employees())


@query("month_name", """
    select entity, "Year", "Month", monthname(make_date("Year", "Month", 1)) as "Month_Name" from v_monthly_salary""")
def month_names(d: Domain) -> DataFrame:
    name = F.expr(month_name("Month"))
    return d.monthly_salary().select("entity", "Year", "Month", name.alias("Month_Name"))


@query("period_label", """
    select entity, "Year" || '-' || lpad("Month"::varchar, 2, '0') as "Period" from v_monthly_salary""")
def period_labels(d: Domain) -> DataFrame:
    return d.monthly_salary().select("entity", F.expr(period_label("Year", "Month")).alias("Period"))


@query("year_normalized", """
    select entity, "Year", "Month", "Year" - min("Year") over (partition by entity) as year_normalized from v_merged""")
def year_normalized(d: Domain) -> DataFrame:
    return series.year_normalized(d.merged_monthly()).select("entity", "Year", "Month", "year_normalized")


@query("net_change", """select entity, "Year", "Month", "Recruitments" - nb_departures as net_change from v_merged""")
def net_change(d: Domain) -> DataFrame:
    return series.net_change(d.merged_monthly()).select("entity", "Year", "Month", "net_change")


@query("monthly_recruitment_effect", """
    select entity, "Year", "Month", sum("Recruitments") over (partition by entity, "Year") / 12 as monthly_recruitment_effect
    from v_merged""")
def monthly_recruitment_effect(d: Domain) -> DataFrame:
    return series.export_features(d.merged_monthly()).select("entity", "Year", "Month", "monthly_recruitment_effect")


@query("clamp_model_year", """
    select scenario_id, y as "Year", least(y, 2020) as model_year from (
      select scenario_id, unnest(range(start_year, end_year + 1)) as y from v_scenarios)""")
def clamp(d: Domain) -> DataFrame:
    from muster.operators.scenarios import expand_years

    return clamp_model_year(expand_years(d.scenarios())).select("scenario_id", "Year", "model_year")


@query("quick_salary", """
    select id, experience, education, round(30000 + case when isnan(e) then 0 else greatest(0, least(e, 50)) end * 2000
        * case l when 'Master' then 1.2 when 'PhD' then 1.5 else 1.0 end, 2) as salary
    from (select *, coalesce(try_cast(case when regexp_full_match(trim(experience), '[-0-9.enai]+')
          then trim(experience) end as double), 0) as e, trim(coalesce(education, 'Bachelor')) as l
      from (select event_id as id, case event_id % 9 when 0 then 'nan' when 1 then 'ten' when 2 then ' ' || value || ' '
            when 3 then '-4' when 4 then '1e1' when 5 then '' else value::varchar end as experience,
          case event_id % 5 when 0 then 'Master' when 1 then ' PhD ' when 2 then null when 3 then 'Other' else 'Bachelor' end
            as education
        from events))""")
def quick_salary(d: Domain) -> DataFrame:
    e, value = F.col("event_id"), F.col("value").cast("string")
    level = (
        F.when(e % 5 == 0, "Master").when(e % 5 == 1, " PhD ").when(e % 5 == 3, "Other").when(e % 5 == 4, "Bachelor")
    )
    years = (
        F.when(e % 9 == 0, "nan").when(e % 9 == 1, "ten").when(e % 9 == 2, F.concat(F.lit(" "), value, F.lit(" ")))
        .when(e % 9 == 3, "-4").when(e % 9 == 4, "1e1").when(e % 9 == 5, "").otherwise(value)
    )
    return employees.quick_salary(
        d.raw("events").select(e.alias("id"), years.alias("experience"), level.alias("education"))
    )


@query("code_labels", """
    select matricule, concat_ws(' - ', grade, case grade when 'A1' then 'Cadre Supérieur' when 'A2' then 'Cadre'
      when 'A3' then 'Cadre Adjoint' when 'B' then 'Maîtrise' when 'C' then 'Exécution' when 'D' then 'Ouvrier' end) as grade_label
    from v_employees""")
def code_labels(d: Domain) -> DataFrame:
    return employees.code_labels(d.employees()).select("matricule", "grade_label")


@query("select_features", """
    select entity, nbemp, "Year", nb_departures, "Recruitments", net_change, mass_salary from v_yearly_features""")
def select_features(d: Domain) -> DataFrame:
    return regression.select_features(d.yearly_training(), YEARLY_FEATURES).withColumn(
        "mass_salary", F.round("mass_salary", 2)
    )


@query("parse_result_json", """
    select source, id, case when valid then json_extract_string(j, '$.status') end as status,
      coalesce(case when valid then json_extract_string(j, '$.graph') <> '' end, false) as has_graph,
      coalesce(case when valid then json_array_length(j, '$.predictions') end, 0) as years,
      case when valid then json_extract_string(j, '$.predictions[0].Total_Salary')::double end as first_total
    from (select *, json_valid(j) as valid from (
      select 'events' as source, event_id as id, case when event_id % 3 = 0 then '{"status": "success", "graph": "'
        || case when event_id % 2 = 0 then 'g' else '' end || '", "predictions": [{"Year": 2021, "Total_Salary": '
        || (event_id % 1000) || '.5, "End_Employees": 3}], "k": ' || props || '}' else props end as j from events
      union all select 'documents', doc_id, text from documents))""")
def parse_result_json(d: Domain) -> DataFrame:
    e = F.col("event_id")
    stored = F.concat(
        F.lit('{"status": "success", "graph": "'), F.when(e % 2 == 0, "g").otherwise(""),
        F.lit('", "predictions": [{"Year": 2021, "Total_Salary": '), (e % 1000).cast("string"),
        F.lit('.5, "End_Employees": 3}], "k": '), F.col("props"), F.lit("}"),
    )
    rows = d.raw("events").select(
        F.lit("events").alias("source"), e.alias("id"), F.when(e % 3 == 0, stored).otherwise(F.col("props")).alias("result_json")
    ).unionByName(d.raw("documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("result_json")
    ))
    return parse_result(rows).select(
        "source", "id",
        F.col("result.status").alias("status"), "has_graph",
        F.coalesce(F.size("result.predictions"), F.lit(0)).alias("years"),
        F.get("result.predictions", 0)["Total_Salary"].alias("first_total"),
    )
