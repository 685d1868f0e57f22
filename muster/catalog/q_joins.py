"""Joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.catalog.domain import Domain
from muster.catalog.registry import ORACLE_BODIES, plain, query, sig
from muster.catalog.views_sql import sig as sig_sql
from muster.operators import audits, joins
from muster.operators.projection import project_yearly
from muster.plans.backtest import bias_factor

_MONTHLY = 'entity, "Year", "Month", nb_departures, "Recruitments", mass_salary, nbemp'


@query("merge_monthly_left", f"select {_MONTHLY} from v_merged")
def merge_left(d: Domain) -> DataFrame:
    return d.merged_monthly()


@query("merge_monthly_inner", f"select {_MONTHLY} from v_merged_inner")
def merge_inner(d: Domain) -> DataFrame:
    return d.merged_inner()


@query("merge_yearly", 'select entity, "Year", mass_salary, nbemp, nb_departures, "Recruitments" from v_yearly')
def merge_yearly(d: Domain) -> DataFrame:
    return d.merged_yearly()


@query("user_profile", """
    select u.id, u.username, u.email_adress, u.matricule, e.first_name, e.last_name, e.matricule is not null as found
    from v_users u left join v_employees e on u.matricule = e.matricule""")
def user_profile(d: Domain) -> DataFrame:
    return joins.user_profile(d.users(), d.employees())


@query("movement_join", """
    select 'recruitment' as kind, m.id, m.matricule, concat_ws(' ', e.first_name, e.last_name) as employee_name,
      strftime(e.date_left, '%Y-%m-%d') as employee_date_left, e.matricule is null as dangling
    from v_recruitment m left join v_employees e on m.matricule = e.matricule
    union all
    select 'termination', m.id, m.matricule, concat_ws(' ', e.first_name, e.last_name),
      strftime(e.date_left, '%Y-%m-%d'), e.matricule is null
    from v_termination m left join v_employees e on m.matricule = e.matricule
    union all
    select 'history', h.id, u.matricule, coalesce(u.username, ''), null, u.id is null
    from v_history h left join v_users u on h.user_id = u.id""")
def movement_join(d: Domain) -> DataFrame:
    staff = d.employees()

    def moves(kind: str, df: DataFrame) -> DataFrame:
        return joins.movement_join(df, staff).select(
            F.lit(kind).alias("kind"), "id", "matricule",
            F.coalesce("employee_name", F.lit("")).alias("employee_name"), "employee_date_left",
            F.col("employee_name").isNull().alias("dangling"),
        )

    asked = joins.history_users(d.history(), d.users()).select(
        F.lit("history").alias("kind"), "id", "matricule",
        F.coalesce("username", F.lit("")).alias("employee_name"),
        F.lit(None).cast("date").alias("employee_date_left"), F.col("username").isNull().alias("dangling"),
    )
    both = moves("recruitment", d.recruitment()).unionByName(moves("termination", d.termination()))
    return plain(both.unionByName(asked))


@query("fk_orphans", """
    select * from (
      select 'users.matricule' as fk, matricule as key, count(*) as "rows" from v_users
        where matricule not in (select matricule from v_employees) group by 2
      union all select 'recruitment.matricule', matricule, count(*) from v_recruitment
        where matricule not in (select matricule from v_employees) group by 2
      union all select 'termination.matricule', matricule, count(*) from v_termination
        where matricule not in (select matricule from v_employees) group by 2
      union all select 'prediction_history.user_id', user_id, count(*) from v_history
        where user_id not in (select id from v_users) group by 2)""")
def fk_orphans(d: Domain) -> DataFrame:
    return _orphans(d, joins.orphans)


def _orphans(d: Domain, orphans: Callable[..., DataFrame]) -> DataFrame:
    staff = d.raw("customer").select(F.col("c_custkey").alias("matricule"))
    found = {
        "users.matricule": orphans(d.users(), "matricule", staff, "matricule"),
        "recruitment.matricule": orphans(d.recruitment(), "matricule", staff, "matricule"),
        "termination.matricule": orphans(d.termination(), "matricule", staff, "matricule"),
        "prediction_history.user_id": orphans(d.history(), "user_id", d.users(), "id"),
    }
    named = [df.select(F.lit(fk).alias("fk"), "key", "rows") for fk, df in found.items()]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


@query("fk_orphans_by_bitmap", ORACLE_BODIES["fk_orphans"])
def fk_orphans_by_bitmap(d: Domain) -> DataFrame:
    """The same audit with clean rows left where they are."""
    return _orphans(d, audits.orphans)


@query("apply_scalar", f"""
    select scenario_id, "Year", {sig_sql('"Total_Salary" * factor', 9)} as "Total_Salary" from v_projected,
      (select 1 - avg(case when actual > 0 then (predicted - actual) / actual else 0.0::double end) as factor from v_compared)""")
def apply_scalar(d: Domain) -> DataFrame:
    d = d.reduced()
    model = d.yearly_formula()
    yearly = project_yearly(d.scenarios(), model)
    adjusted = joins.apply_factor(yearly, bias_factor(d.historical(), model), ["Total_Salary"])
    return adjusted.select("scenario_id", "Year", sig(F.col("Total_Salary"), 9).alias("Total_Salary"))
