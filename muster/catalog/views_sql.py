"""The domain views as SQL over the registered tables, in dependency order."""

AVG_PAY = "(239227929.56::double / 3220)"


def money(x: str) -> str:
    """Cents, rounded on the exact binary value."""
    return f"cast(printf('%.2f', {x}) as double)"


def sig(x: str, digits: int = 12) -> str:
    return f"cast(printf('%.{digits - 1}e', {x}) as double)"


WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def sanitize(x: str) -> str:
    out = strip(f"coalesce({x}, '')")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        out = f"replace({out}, '{char}', '{entity}')"
    return out


def parse_int(x: str) -> str:
    return f"case when regexp_full_match({x}, '[+-]?[0-9]+') then cast({x} as bigint) end"


def parse_float(x: str) -> str:
    return (
        f"case when regexp_full_match({x}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"
        f" then cast({x} as double) end"
    )


def parse_date(x: str) -> str:
    return (
        f"case when regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}')"
        f" then cast(try_strptime({x}, '%Y-%m-%d') as date) end"
    )


VIEWS: dict[str, str] = {}

VIEWS["v_monthly_salary"] = """
    select c_nationkey as entity, cast(year(o_orderdate) as int) as "Year", cast(month(o_orderdate) as int) as "Month",
      cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100 as mass_salary,
      cast(count(distinct o_custkey) as double) as nbemp
    from orders join customer on o_custkey = c_custkey group by all"""

VIEWS["v_monthly_departures"] = """
    select s_nationkey as entity, cast(year(l_shipdate) as int) as "Year", cast(month(l_shipdate) as int) as "Month",
      count(*) as nb_departures
    from lineitem join supplier on l_suppkey = s_suppkey where l_returnflag = 'R' group by all"""

VIEWS["v_monthly_recruitments"] = """
    select c_nationkey as entity, cast(year(d) as int) as "Year", cast(month(d) as int) as "Month", count(*) as "Recruitments"
    from (select o_custkey, min(o_orderdate) as d from orders group by 1)
    join customer on o_custkey = c_custkey group by all"""

VIEWS["v_merged"] = """
    select d.entity, d."Year", d."Month", d.nb_departures, coalesce(r."Recruitments", 0) as "Recruitments",
      s.mass_salary, s.nbemp
    from v_monthly_departures d
    left join v_monthly_recruitments r on d.entity = r.entity and d."Year" = r."Year" and d."Month" = r."Month"
    join v_monthly_salary s on d.entity = s.entity and d."Year" = s."Year" and d."Month" = s."Month"
    where s.mass_salary is not null and s.nbemp is not null"""

VIEWS["v_merged_inner"] = """
    select d.entity, d."Year", d."Month", d.nb_departures, r."Recruitments", s.mass_salary, s.nbemp
    from v_monthly_departures d
    join v_monthly_recruitments r on d.entity = r.entity and d."Year" = r."Year" and d."Month" = r."Month"
    join v_monthly_salary s on d.entity = s.entity and d."Year" = s."Year" and d."Month" = s."Month" """

VIEWS["v_yearly_salary"] = """
    select entity, "Year", round(sum(mass_salary), 2) as mass_salary, avg(nbemp) as nbemp, max(nbemp) as max_nbemp
    from v_monthly_salary group by all"""

VIEWS["v_yearly_departures"] = """
    select entity, "Year", cast(sum(nb_departures) as bigint) as nb_departures from v_monthly_departures group by all"""

VIEWS["v_yearly_recruitments"] = """
    select entity, "Year", cast(sum("Recruitments") as bigint) as "Recruitments" from v_monthly_recruitments group by all"""

VIEWS["v_yearly"] = """
    select s.entity, s."Year", s.mass_salary, s.nbemp, s.max_nbemp, coalesce(d.nb_departures, 0) as nb_departures,
      coalesce(r."Recruitments", 0) as "Recruitments"
    from v_yearly_salary s
    left join v_yearly_departures d on s.entity = d.entity and s."Year" = d."Year"
    left join v_yearly_recruitments r on s.entity = r.entity and s."Year" = r."Year" """

VIEWS["v_historical"] = """
    select entity, "Year" as "year", mass_salary, cast(max_nbemp as bigint) as number_employees,
      nb_departures as departures, "Recruitments" as recruitment
    from v_yearly"""

VIEWS["v_yearly_features"] = """
    select *,
      coalesce(first_value(prev_salary0 ignore nulls) over ahead, 0) as prev_salary,
      coalesce(first_value(prev_employees0 ignore nulls) over ahead, 0) as prev_employees,
      coalesce(first_value(salary_growth0 ignore nulls) over ahead, 0) as salary_growth,
      coalesce(first_value(employee_growth0 ignore nulls) over ahead, 0) as employee_growth
    from (
      select *, "Recruitments" - nb_departures as net_change,
        lag(mass_salary) over w as prev_salary0, lag(nbemp) over w as prev_employees0,
        mass_salary / nullif(lag(mass_salary) over w, 0) - 1 as salary_growth0,
        nbemp / nullif(lag(nbemp) over w, 0) - 1 as employee_growth0,
        mass_salary / nullif(nbemp, 0) as salary_per_employee
      from v_yearly window w as (partition by entity order by "Year"))
    window ahead as (partition by entity order by "Year" rows between current row and unbounded following)"""

VIEWS["v_monthly_features"] = """
    select *, sum(net_employee_change) over (partition by entity, "Year" order by "Month" rows unbounded preceding)
        as cumulative_net_change
    from (select *, sum("Recruitments") over (partition by entity, "Year") as cumulative_recruitments,
        mass_salary / nullif(nbemp, 0) as avg_salary_per_emp,
        "Year" - min("Year") over (partition by entity) as year_normalized,
        "Recruitments" - nb_departures as net_employee_change
      from v_merged)"""

VIEWS["v_employees"] = """
    select c_custkey as matricule,
      upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as first_name, c_name as last_name,
      date '1960-01-01' + cast(c_custkey % 12000 as int) as birth_date,
      case c_nationkey % 7 when 0 then 'A1' when 1 then 'A2' when 2 then 'A3' when 3 then 'B' when 4 then 'C'
        when 5 then 'D' end as grade,
      c_custkey % 13 as echelon, 100 + c_custkey % 901 as indice,
      case when c_custkey % 17 = 0 then '' else c_mktsegment end as corps,
      cast(case when c_custkey % 19 = 0 then 0 else c_acctbal end as decimal(10,2)) as salaire_base,
      cast(case when c_custkey % 5 <> 0 then c_custkey % 300 end as decimal(10,2)) as indemnite_residence,
      cast((c_custkey % 100) * 0.5 as decimal(10,2)) as indemnite_transport,
      c_mktsegment as situation_familiale,
      c_custkey % 5 as nombre_enfants,
      cast(first_day as date) as date_joined,
      case when c_custkey % 9 <> 0 then cast(first_day as date) + 365 end as date_titularisation,
      case when cast(last_day as date) < date '2001-06-01' then cast(last_day as date) end as date_left
    from customer left join (select o_custkey, min(o_orderdate) as first_day, max(o_orderdate) as last_day
      from orders group by 1) on o_custkey = c_custkey"""

VIEWS["v_users"] = """
    select user_id as id, 'u' || user_id as username,
      case user_id % 4 when 0 then 'u' || user_id || '@site.org' when 1 then 'u' || user_id || '.site.org'
        when 2 then 'u' || user_id || '@site' else 'a@u' || user_id || '@b.c' end as email_adress,
      user_id * 13 as matricule, min(ts) as created_at
    from events group by user_id"""

VIEWS["v_recruitment"] = """
    select o_orderkey as id, o_custkey as matricule, cast(o_orderdate as date) as recruitment_date,
      o_orderstatus as grade, o_orderpriority as corps, 'Customer' as first_name,
      cast(o_custkey as varchar) as last_name, case when o_orderkey % 3 = 0 then 'transfer' end as notes
    from orders"""

VIEWS["v_termination"] = """
    select l_orderkey * 10 + l_linenumber as id, l_partkey as matricule, cast(l_shipdate as date) as termination_date,
      l_linestatus as grade, '' as corps, 'Part' as first_name, cast(l_partkey as varchar) as last_name,
      case when l_quantity > 25 then 'Retraite' else 'Mutation' end as reason
    from lineitem where l_returnflag = 'R'"""

VIEWS["v_history"] = """
    select event_id as id, user_id, 2000 + event_id % 30 as start_year, 2000 + event_id % 30 + event_id % 10 as end_year,
      event_id % 100 as recruitments, event_id % 70 as departures, 1 + event_id % 500 as initial_employees,
      props as result_json, ts as created_at
    from events"""

VIEWS["v_scenario_table"] = """
    select c_custkey as scenario_id, c_nationkey as entity, 1995 + c_custkey % 110 as start_year,
      1995 + c_custkey % 110 - 2 + c_custkey % 25 as end_year, c_custkey % 130 - 5 as recruitments,
      c_custkey * 7 % 130 as departures, c_custkey * 13 % 400 as initial_employees
    from customer"""

RULES = """case when start_year < 2000 or start_year > 2100 then 'Invalid start year (2000-2100)'
    when end_year < start_year then 'End year must be greater than or equal to start year'
    when end_year - start_year > 20 then 'Maximum range: 20 years'
    when recruitments < 0 or departures < 0 or initial_employees < 0 then 'Values must be positive'
    when initial_employees = 0 then 'Initial employees cannot be zero' end"""

VIEWS["v_scenarios"] = f"select * from v_scenario_table where ({RULES}) is null"

VIEWS["v_asked"] = """
    select scenario_id, entity, scenario_id % 200 as user_id,
      case when scenario_id % 23 = 1 then 'abc' when scenario_id % 23 <> 0 then start_year::varchar end as start_year,
      case when scenario_id % 41 <> 7 then end_year::varchar end as end_year,
      case when scenario_id % 29 <> 3 then recruitments::varchar end as recruitments,
      '  ' || departures || chr(10) as departures,
      case when scenario_id % 37 = 5 then '10.5' when scenario_id % 103 = 5 then '9223372036854775807'
        when scenario_id % 23 <> 0 then initial_employees::varchar end as initial_employees
    from v_scenario_table"""

VIEWS["v_requests"] = """
    select * from v_asked union all select * from v_asked where scenario_id % 97 = 0
    union all select * replace (null as scenario_id) from v_asked where scenario_id % 101 = 0"""

_FIELDS = ["start_year", "end_year", "recruitments", "departures", "initial_employees"]
_MISSING = "concat_ws(', ', " + ", ".join(f"case when {f} is null then '{f}' end" for f in _FIELDS) + ")"
_PARSED = ", ".join(f"{parse_int(strip(f))} as {f}" for f in _FIELDS)
_ANY_NULL = " or ".join(f"{f} is null" for f in _FIELDS)

VIEWS["v_parsed_requests"] = f"""
    select scenario_id, entity, user_id, {_PARSED}, {_MISSING} as missing from v_requests"""

VIEWS["v_checked_requests"] = f"""
    select *, message is null as ok from (select scenario_id, entity, user_id, {', '.join(_FIELDS)},
      case when scenario_id is null then 'Invalid scenario_id'
        when count(*) over (partition by scenario_id) > 1 then 'Repeated scenario_id' when missing <> '' then 'Missing fields: ' || missing when {_ANY_NULL} then 'Invalid numeric values'
        else {RULES} end as message from v_parsed_requests)"""

# ---- predictors and projections: plain recursion, one period at a time ----

VIEWS["v_yearly_line"] = """
    select round(regr_slope(mass_salary, nbemp), 4) as slope, round(regr_intercept(mass_salary, nbemp), 4) as intercept
    from v_yearly"""

VIEWS["v_monthly_line"] = """
    select round(regr_slope(mass_salary, nbemp), 4) as slope, round(regr_intercept(mass_salary, nbemp), 4) as intercept
    from v_merged"""

VIEWS["v_split"] = """
    select *, row_number() over (partition by entity order by "Year" desc, "Month" desc)
      <= ceil(count(*) over (partition by entity) * 0.2::double) as is_test from v_merged"""

# Least-squares lines as fitted by the regression queries (not rounded).
VIEWS["v_yearly_fit"] = """
    select regr_slope(mass_salary, nbemp) as slope, regr_intercept(mass_salary, nbemp) as intercept from v_yearly"""

VIEWS["v_train_fit"] = """
    select regr_slope(mass_salary, nbemp) as slope, regr_intercept(mass_salary, nbemp) as intercept
    from v_split where not is_test"""

VIEWS["v_yearly_fitted"] = """
    select entity, "Year", mass_salary as actual, nbemp * slope + intercept as predicted
    from v_yearly, v_yearly_fit"""

VIEWS["v_test_fitted"] = """
    select entity, "Year", "Month", mass_salary as actual, nbemp * slope + intercept as predicted
    from v_split, v_train_fit where is_test"""


def yearly_walk(source: str) -> str:
    """One row per scenario year, each from the year before."""
    model = "greatest(0.0::double, n * slope + intercept)"
    return f"""
    select scenario_id, entity, start_year, end_year, recruitments, departures, initial_employees,
      start_year as yr, cast(initial_employees as double) as n, cast(recruitments - departures as double) as net,
      slope, intercept,
      case when start_year > 2020 then initial_employees::double * ({AVG_PAY} * pow(1.05::double, (start_year - 2020)::double))
        else greatest(0.0::double, initial_employees::double * slope + intercept) end as salary
    from {source}, v_yearly_line
    union all
    select scenario_id, entity, start_year, end_year, recruitments, departures, initial_employees,
      yr, n, net, slope, intercept,
      case when yr > 2020 then greatest(0.0::double, salary * (1.05::double
          + case when n - net > 0 then net / (n - net) else 0.0::double end * 0.7::double))
        else {model} end as salary
    from (select w.* replace (yr + 1 as yr, 
      greatest(1.0::double, initial_employees::double + (yr + 1 - start_year)::double * net) as n) from REC w where yr < end_year)"""


VIEWS["v_yearly_walk"] = yearly_walk("v_scenarios").replace("REC", "v_yearly_walk")

VIEWS["v_projected"] = f"""
    select scenario_id, entity, start_year, end_year, recruitments, departures, initial_employees, yr as "Year", n, net,
      salary, {money('salary')} as "Total_Salary", try_cast(n + net as bigint) as "End_Employees" from v_yearly_walk"""

# What the accepted requests ask for, which need not be what the scenario table holds.
VIEWS["v_request_walk"] = yearly_walk("(select * from v_checked_requests where ok)").replace("REC", "v_request_walk")

VIEWS["v_request_projected"] = VIEWS["v_projected"].replace("v_yearly_walk", "v_request_walk")


def monthly_walk(name: str, source: str, floor: int, leave: str) -> str:
    f = f"{floor}.0::double"
    return f"""
    select scenario_id, start_year, end_year, recruitments, departures, {leave} as d, 0 as t,
      initial_employees::double + recruitments::double as level, recruitments::double - {leave} as net,
      greatest({f}, initial_employees::double + recruitments::double - {leave}) as lft
    from {source}
    union all
    select scenario_id, start_year, end_year, recruitments, departures, d, t + 1 as t,
      case when (t + 1) % 12 = 0 then lft + recruitments::double else lft end as level,
      case when (t + 1) % 12 = 0 then recruitments::double - d else net + (0.0::double - d) end as net,
      greatest({f}, case when (t + 1) % 12 = 0 then lft + recruitments::double else lft end - d) as lft
    from {name} where t + 1 < (end_year - start_year + 1) * 12"""


VIEWS["v_monthly_walk"] = monthly_walk("v_monthly_walk", "v_scenarios", 1, "departures::double / 12")
VIEWS["v_batch_walk"] = monthly_walk("v_batch_walk", "v_scenarios", 0, "departures::double")

VIEWS["v_monthly_scored"] = """
    select scenario_id, start_year + t // 12 as "Year", t % 12 + 1 as "Month", greatest(1.0::double, level) as nbemp,
      d as nb_departures, net as cumulative_net_change, lft,
      greatest(0.0::double, greatest(1.0::double, level) * slope + intercept) as prediction
    from v_monthly_walk, v_monthly_line"""

VIEWS["v_request_monthly_walk"] = monthly_walk(
    "v_request_monthly_walk", "(select * from v_checked_requests where ok)", 1, "departures::double / 12")

VIEWS["v_history_scenarios"] = """
    select entity * 10000 + "year" as scenario_id, "year" as start_year, "year" as end_year, recruitment as recruitments,
      departures, number_employees as initial_employees from v_historical"""

VIEWS["v_history_walk"] = monthly_walk("v_history_walk", "v_history_scenarios", 1, "departures::double / 12")


VIEWS["v_last_scenarios"] = """
    select entity as scenario_id, entity, 2021 as start_year, 2021 as end_year, recruitments, departures, initial_employees
    from (select entity, max(recruitments) as recruitments, max(departures) as departures from v_scenario_table group by 1)
    join (select entity, cast(arg_max(nbemp, "Year" * 100 + "Month") as bigint) as initial_employees from v_merged group by 1)
      using (entity)"""

VIEWS["v_last_walk"] = monthly_walk("v_last_walk", "v_last_scenarios", 0, "departures::double")


def monthly_totals(walk: str) -> str:
    """Pay and December's staff per scenario year of the monthly engine."""
    return f"""
    select scenario_id, start_year + t // 12 as "Year",
      {money('sum(greatest(0.0::double, greatest(1.0::double, level) * slope + intercept) order by t)')} as "Total_Salary",
      try_cast(round_even(max(case when t % 12 = 11 then lft end), 0) as bigint) as "End_Employees"
    from {walk}, v_monthly_line group by 1, 2"""


VIEWS["v_monthly_totals"] = monthly_totals("v_monthly_walk")
VIEWS["v_request_monthly_totals"] = monthly_totals("v_request_monthly_walk")
VIEWS["v_history_totals"] = monthly_totals("v_history_walk")

_HISTORY = """entity, "year", number_employees as employees, recruitment as recruitments, departures, mass_salary as actual"""

VIEWS["v_compared"] = f"""
    select {_HISTORY}, {money('greatest(0.0::double, number_employees::double * slope + intercept)')} as predicted
    from v_historical, v_yearly_line"""

VIEWS["v_compared_monthly"] = f"""
    select {_HISTORY.replace('"year"', 'h."year"')}, "Total_Salary" as predicted from v_historical h join v_history_totals on scenario_id = entity * 10000 + h."year" """

for _end in ("", "_monthly"):  # by either engine
    VIEWS[f"v_errors{_end}"] = f"""
    select *, abs(predicted - actual) as abs_error,
      case when actual > 0 then abs(predicted - actual) / actual else 0 end * 100 as pct_error
    from v_compared{_end}"""

    VIEWS[f"v_backtest{_end}"] = f"""
    select entity, "year", employees, recruitments, departures, {money('actual')} as actual,
      {money('predicted')} as predicted, {money('predicted - actual')} as difference,
      {money('abs_error')} as absolute_error, {money('pct_error')} as error_percent
    from v_errors{_end}"""

    VIEWS[f"v_factor{_end}"] = f"""
    select entity, 1 - avg(case when actual > 0 then (predicted - actual) / actual else 0.0::double end) as factor
    from v_compared{_end} group by entity"""

VIEWS["v_monthly_predictions"] = """
    select *, nbemp * slope + intercept as predicted_salary from v_merged, v_monthly_line"""

# ---- forms ----

VIEWS["v_intake_forms"] = """
    select p_partkey as seq,
      case p_partkey % 19 when 0 then '' when 1 then 'M' || p_partkey when 2 then '0'
        else (p_partkey - p_partkey % 2)::varchar end as matricule,
      case when p_partkey % 11 = 0 then '  ' else ' <b>' || split_part(p_name, ' ', 1) end as first_name,
      split_part(p_name, ' ', 2) || case when p_partkey % 7 = 0 then '''s' else ' & co' end as last_name,
      case p_partkey % 13 when 0 then '' when 1 then '1990-2-30' when 2 then '1985-3-5' when 3 then '1990-01-05 10:00'
        else strftime(date '1970-01-01' + cast(p_partkey % 9000 as int), '%Y-%m-%d') end as birth_date,
      case when p_partkey % 3 = 0 then '' else 'A2' end as grade,
      case p_partkey % 17 when 0 then 'x' when 1 then '' when 2 then '99999999999' else (p_partkey % 12 + 1)::varchar end as echelon,
      (100 + p_partkey % 900)::varchar as indice, p_brand as corps,
      case p_partkey % 23 when 0 then '-5' when 1 then '12,5' when 2 then null when 3 then '123456789.5' when 4 then 'nan'
        else (p_partkey % 5000) || '.25' end as salaire_base,
      case when p_partkey % 43 = 0 then '10d' else '' end as indemnite_residence,
      case p_partkey % 29 when 0 then '1e2' when 1 then '-3' else ' ' end as indemnite_transport,
      p_brand as situation_familiale,
      case p_partkey % 31 when 0 then 'two' when 1 then '3' when 2 then '99999999999' end as nombre_enfants,
      case when p_partkey % 47 = 0 then 'yesterday' else '2001-1-15' end as date_joined,
      case when p_partkey % 37 = 0 then 'soon' else '' end as date_titularisation
    from part"""

VIEWS["v_edit_forms"] = """
    select o_orderkey as seq, o_custkey as matricule,
      case when o_orderkey % 41 = 0 then '' else 'Ed ' || o_orderstatus end as first_name, 'E' || o_orderkey as last_name,
      case when o_orderkey % 9 = 0 then '' else '1980-05-0' || (o_orderkey % 9) end as birth_date,
      case when o_orderkey % 4 = 0 then '' else 'B' end as grade, (o_orderkey % 13)::varchar as echelon,
      case when o_orderkey % 53 = 0 then 'high' else '' end as indice, o_orderpriority as corps,
      case when o_orderkey % 43 = 0 then '-1' else (o_orderkey % 5000) || '.5' end as salaire_base,
      '10' as indemnite_residence, '' as indemnite_transport, o_orderstatus as situation_familiale,
      case when o_orderkey % 2 = 0 then '2' end as nombre_enfants, '1995-02-03' as date_joined,
      '' as date_titularisation, case when o_orderkey % 47 = 0 then '2001-07-01' else '' end as date_left
    from orders"""

_WHOLE = ["echelon", "indice"]
_AMOUNTS = ["salaire_base", "indemnite_residence", "indemnite_transport"]
_TEXT = ["grade", "corps", "situation_familiale"]


def checked_forms(source: str, editing: bool) -> str:
    days = ["date_joined", "date_titularisation"] + (["date_left"] if editing else [])
    fields = ["first_name", "last_name", "birth_date", *_WHOLE, *_TEXT, *_AMOUNTS, "nombre_enfants", *days]
    ints = [*_WHOLE, "nombre_enfants"]
    key = "matricule"
    if not editing:
        fields.append("matricule")
        ints.append("matricule")
        key = "p_matricule as matricule"
    raw = ", ".join(f"{sanitize(f)} as r_{f}" for f in fields)
    parsed = ", ".join(
        [f"{parse_int('r_' + f)} as p_{f}" for f in ints]
        + [f"{parse_float('r_' + f)} as p_{f}" for f in _AMOUNTS]
        + [f"{parse_date('r_' + f)} as p_{f}" for f in ["birth_date", *days]]
    )

    fits = dict.fromkeys([*_WHOLE, "nombre_enfants"], "int") | dict.fromkeys(_AMOUNTS, "decimal(10,2)")

    def bad(f: str) -> str:
        held = f"try_cast(p_{f} as {fits[f]})" if f in fits else f"p_{f}"
        return f"when r_{f} <> '' and {held} is null then 'Invalid {f}'"

    birth = "when p_birth_date is null then 'Birth date is required'"
    rules = ["when r_first_name = '' or r_last_name = '' then 'First name and last name are required'", bad("birth_date")]
    if not editing:
        rules += [birth, bad("matricule"), "when coalesce(p_matricule, 0) = 0 then 'Matricule is required'"]
    rules += [*map(bad, _WHOLE), bad("salaire_base"), "when p_salaire_base < 0 then 'Salaire de base cannot be negative'",
              *map(bad, _AMOUNTS[1:]), bad("nombre_enfants"), *map(bad, days)]
    if editing:
        rules.append(birth)
    out = [f"nullif(r_{f}, '') as {f}" for f in ["first_name", "last_name", *_TEXT]]
    out += [f"p_{f} as {f}" for f in ["birth_date", *days]]
    out += [f"try_cast(p_{f} as {fits[f]}) as {f}" for f in [*_WHOLE, *_AMOUNTS]]
    out.append("coalesce(try_cast(p_nombre_enfants as int), 0) as nombre_enfants")
    base = "matricule" if editing else "1"
    return f"""select seq, {key}, {', '.join(out)}, case {' '.join(rules)} end as reason
      from (select *, {parsed} from (select seq, {base} as {'matricule' if editing else 'one'}, {raw} from {source}))"""


VIEWS["v_intake"] = checked_forms("v_intake_forms", editing=False)
VIEWS["v_edits"] = checked_forms("v_edit_forms", editing=True)

VIEWS["v_termination_requests"] = """
    select o_orderkey as seq, o_custkey + case when o_orderkey % 50 = 0 then 1000000000 else 0 end as matricule,
      case o_orderkey % 6 when 0 then '' when 1 then 'n/a' when 2 then '1990-01-01'
        else strftime(cast(o_orderdate as date) + 30, '%Y-%m-%d') end as raw
    from orders"""

VIEWS["v_terminations"] = f"""
    select seq, matricule, date_left, case when seq > min(case when reason0 is null then seq end) over (partition by matricule)
        then 'Employee is already terminated' else reason0 end as reason
    from (select q.seq, q.matricule, q.date_left,
        case when e.matricule is null then 'Employee not found'
          when e.date_left is not null then 'Employee is already terminated'
          when raw = '' then 'Termination date is required'
          when q.date_left is null then 'Invalid date_left'
          when q.date_left < e.date_joined then 'Termination date cannot be before hire date' end as reason0
      from (select *, {parse_date('raw')} as date_left from v_termination_requests) q
      left join v_employees e on q.matricule = e.matricule)"""
