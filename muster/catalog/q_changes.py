"""Change application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.catalog.domain import Domain
from muster.catalog.q_sources import EMPLOYEE_SQL
from muster.catalog.registry import ORACLE_BODIES, plain, query
from muster.operators import changes, intake
from muster.operators.changes import EDITABLE
from muster.session import workspace
from muster.plans import records
from muster.sources import snapshots, tables


@query("apply_inserts", f"""
    select {EMPLOYEE_SQL} from (
      select * from v_employees
      union all by name
      select * exclude (reason, seq), cast(null as date) as date_left from (
        select * from v_intake where reason is null
        qualify row_number() over (partition by matricule order by seq) = 1)
      where matricule not in (select matricule from v_employees))""")
def apply_inserts(d: Domain) -> DataFrame:
    return plain(changes.apply_inserts(d.employees(), intake.validate_forms(d.intake_forms())))


_EDITED = ", ".join(f"case when x.seq is not null then x.{c} else e.{c} end as {c}" for c in EDITABLE)


@query("apply_full_update", f"""
    select {EMPLOYEE_SQL} from (
      select e.matricule, {_EDITED} from v_employees e left join (
        select * from (
          select f.*, min(case when f.date_left is not null then f.seq end) over (partition by f.matricule) as closing
          from v_edits f join v_employees e on f.matricule = e.matricule
          where f.reason is null and e.date_left is null)
        where closing is null or seq <= closing
        qualify row_number() over (partition by matricule order by seq desc) = 1) x on e.matricule = x.matricule)""")
def apply_full_update(d: Domain) -> DataFrame:
    edits = intake.validate_forms(d.edit_forms(), editing=True)
    return plain(changes.apply_full_update(d.employees(), edits))


def _last(value: str, condition: str) -> str:
    return f"arg_max(struct_pack(v := {value}), o_orderkey) filter ({condition})"


_DAY = "date '1975-01-01' + cast(o_orderkey % 5000 as int)"
_PATCHED = {
    "grade": _last("case when o_orderkey % 4 <> 0 then 'P' || (o_orderkey % 10) end", "o_orderkey % 2 = 0"),
    "corps": _last("o_orderpriority", "o_orderkey % 3 = 0"),
    "salaire_base": _last("cast(o_orderkey % 9000 as decimal(10,2))", "o_orderkey % 5 = 0"),
    "birth_date": _last(_DAY, "o_orderkey % 14 = 7"),
    "date_titularisation": _last(_DAY, "o_orderkey % 22 = 11"),
    "first_name": _last("'N' || (o_orderkey % 100)", "o_orderkey % 13 = 0"),
}


@query("apply_partial_update", f"""
    select {EMPLOYEE_SQL} from (
      select e.* replace ({', '.join(f'case when n_{c} is not null then n_{c}.v else e.{c} end as {c}' for c in _PATCHED)})
      from v_employees e left join (
        select o_custkey, {', '.join(f'{x} as n_{c}' for c, x in _PATCHED.items())} from orders group by o_custkey) p
      on e.matricule = p.o_custkey)""")
def apply_partial_update(d: Domain) -> DataFrame:
    return plain(changes.apply_partial_update(d.employees(), d.patches()))


@query("apply_terminations", f"""
    select {EMPLOYEE_SQL} from (
      select e.* replace (coalesce(t.date_left, e.date_left) as date_left)
      from v_employees e left join v_terminations t on e.matricule = t.matricule and t.reason is null)""")
def apply_terminations(d: Domain) -> DataFrame:
    return plain(changes.apply_terminations(d.employees(), d.termination_requests()))


@query("apply_terminations_unchecked", f"""
    select {EMPLOYEE_SQL} from (
      select e.* replace (coalesce(t.day, e.date_left) as date_left) from v_employees e left join (
        select matricule, arg_max(coalesce(try_strptime(raw, '%Y-%m-%d')::date, date '2002-01-01'), seq) as day
        from v_termination_requests group by matricule) t on e.matricule = t.matricule)""")
def apply_terminations_unchecked(d: Domain) -> DataFrame:
    from muster.functions import parse_date

    requests = d.termination_requests().withColumn("date_left", F.expr(parse_date("date_left")))
    today = F.lit("2002-01-01").cast("date")
    return plain(changes.apply_terminations(d.employees(), requests, today=today, checked=False))


@query("apply_deletes", f"""
    select {EMPLOYEE_SQL} from v_employees where matricule not in (select s_suppkey * 3 from supplier)""")
def apply_deletes(d: Domain) -> DataFrame:
    return plain(changes.apply_deletes(d.employees(), d.delete_keys()))


def _late(d: Domain) -> DataFrame:
    return d.raw("orders").filter("o_orderstatus = 'P'").select(
        (F.col("o_orderkey") + 1_000_000_000).alias("id"), F.col("o_custkey").alias("matricule"),
        F.col("o_orderdate").alias("recruitment_date"), F.lit("X").alias("grade"), F.lit("late").alias("corps"),
    )


@query("append_movements", """
    select id, matricule, strftime(recruitment_date, '%Y-%m-%d') as recruitment_date, grade, corps, notes from v_recruitment
    union all
    select 1000000000 + o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d'), 'X', 'late', null from orders
    where o_orderstatus = 'P'""")
def append_movements(d: Domain) -> DataFrame:
    path = workspace(d.spark, "movements")
    tables.append_movements(d.recruitment(), "recruitment", path)
    stored = tables.append_movements(_late(d), "recruitment", path)
    return plain(stored.select("id", "matricule", "recruitment_date", "grade", "corps", "notes"))


def _published(d: Domain, job: str, rows: DataFrame) -> DataFrame:
    """Employees after a batch of forms on a versioned snapshot of them."""
    path = workspace(d.spark, "snapshot")
    snapshots.create(d.employees(), "employees", path, buckets=16)
    records.change_snapshot(d.spark, path, job, rows)
    return plain(snapshots.read(d.spark, "employees", path))


@query("publish_inserts", ORACLE_BODIES["apply_inserts"])
def publish_inserts(d: Domain) -> DataFrame:
    return _published(d, "add", d.intake_forms())


@query("publish_full_update", ORACLE_BODIES["apply_full_update"])
def publish_full_update(d: Domain) -> DataFrame:
    return _published(d, "edit", d.edit_forms())


@query("publish_terminations", ORACLE_BODIES["apply_terminations"])
def publish_terminations(d: Domain) -> DataFrame:
    return _published(d, "terminate", d.termination_requests())


@query("append_movements_once", ORACLE_BODIES["append_movements"])
def append_movements_once(d: Domain) -> DataFrame:
    """Two batches, of which the second is run three times."""
    path = workspace(d.spark, "movement-batches")
    tables.append_movements(d.recruitment(), "recruitment", path, batch="first")
    for _ in range(3):
        stored = tables.append_movements(_late(d), "recruitment", path, batch="late")
    return plain(stored.select("id", "matricule", "recruitment_date", "grade", "corps", "notes"))
