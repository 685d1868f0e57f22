"""Employee search, intake and change batches against one-record-at-a-time bookkeeping."""

from __future__ import annotations

import datetime as dt
import decimal
import random

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from muster.operators import changes, employees, intake, rollups
from muster.plans.dashboard import employee_listing
from muster.schemas import EMPLOYEES
from muster.sources import tables

D = decimal.Decimal
FORM = [
    "matricule", "first_name", "last_name", "birth_date", "grade", "echelon", "indice", "corps", "salaire_base",
    "indemnite_residence", "indemnite_transport", "situation_familiale", "nombre_enfants", "date_joined",
    "date_titularisation",
]


def person(matricule, **fields):
    base = dict(
        matricule=matricule, first_name="Ann", last_name="Lee", birth_date=dt.date(1980, 1, 1), grade="A1", echelon=5,
        indice=450, corps="Technique", salaire_base=D("10.00"), indemnite_residence=D("5.50"), indemnite_transport=None,
        situation_familiale=None, nombre_enfants=0, date_joined=dt.date(2015, 1, 10), date_titularisation=None,
        date_left=None,
    )
    return tuple((base | fields)[f] for f in EMPLOYEES.fieldNames())


def staff(spark, *people):
    return spark.createDataFrame(list(people), EMPLOYEES)


def form(seq=1, **fields):
    base = dict.fromkeys(FORM, "") | dict(matricule="7", first_name="Ann", last_name="Lee", birth_date="1980-1-1")
    return (seq, *[(base | fields)[f] for f in FORM])


def forms(spark, *rows_, extra=()):
    names = ["seq", *FORM, *extra]
    return spark.createDataFrame(list(rows_), ", ".join(f"{n} {'bigint' if n == 'seq' else 'string'}" for n in names))


def test_total_salary(spark):
    df = staff(
        spark, person(1, salaire_base=None, indemnite_residence=D("10.00"), indemnite_transport=D("5.50")),
        person(2, salaire_base=None, indemnite_residence=None),
    )
    assert rows(employees.total_salary(df).select("total_salary").orderBy("matricule")) == [(D("15.50"),), (D("0.00"),)]


def test_zero_amounts_show_as_missing(spark):
    df = staff(spark, person(1, salaire_base=D("0.00"), echelon=0, grade="", date_joined=None))
    shown = employees.display_row(df).first()
    assert (shown.salaire_base, shown.echelon, shown.grade, shown.date_joined) == ("-", "-", "-", "-")
    assert (shown.full_name, shown.indemnite_residence, shown.status) == ("Ann Lee", "5.50", "Active")
    assert '"salaire_base":null' in employees.employee_json(df).first().record


def test_thousands_separators(spark):
    df = staff(spark, person(1, salaire_base=D("1234567.50")))
    assert employees.display_row(df).first().salaire_base_grouped == "1,234,567.50"


@pytest.mark.parametrize("term, found", [
    ("ANN", [1]), ("l_e", [1]), ("%", [1, 2, 30]), ("3", [30]), ("éc", [2]), ("ÉC", []), ("", [1, 2, 30]), (None, [1, 2, 30]),
    (" o'b ", [30]), ("\\", []),
])
def test_search(spark, term, found):
    df = staff(
        spark, person(1), person(2, first_name="école", last_name="x"),
        person(30, first_name="Bo", last_name="O&#x27;Brien"),
    )
    assert sorted(r[0] for r in rows(employees.search_employees(df, term))) == found


def test_listing_composes_and_pushes_filters(spark, tmp_path):
    df = staff(spark, person(1), person(2, date_left=dt.date(2020, 1, 1)), person(3, corps="X"))
    stored = tables.load_table(df, "employees", str(tmp_path / "e"))
    got = employee_listing(stored, search="ann", corps="Technique", status="active", year=2015)
    assert [r[0] for r in rows(got)] == [1]
    text = plan(got.select("matricule"))
    for pushed in ("EqualTo(corps,Technique)", "IsNull(date_left)", "GreaterThanOrEqual(date_joined,2015-01-01)"):
        assert pushed in text
    assert "salaire_base" not in text.split("ReadSchema")[1]


def test_lookup_marks_missing_keys(spark):
    keys = spark.createDataFrame([(1,), (5,)], "matricule bigint")
    got = employees.lookup_by_key(keys, staff(spark, person(1))).select("matricule", "first_name", "found")
    assert sorted(rows(got)) == [(1, "Ann", True), (5, None, False)]


@pytest.mark.parametrize("experience, education, salary", [
    ("abc", "Master", 30000.0), ("60", "PhD", 180000.0), ("nan", "Bachelor", 30000.0), ("10", "Other", 50000.0),
    (" 2.5 ", None, 35000.0), ("-3", "PhD", 30000.0), (None, "Master", 30000.0), ("inf", "Master", 150000.0),
])
def test_quick_salary(spark, experience, education, salary):
    df = spark.createDataFrame([(experience, education)], "experience string, education string")
    assert employees.quick_salary(df).first().salary == salary


def test_account_format(spark):
    users = spark.createDataFrame(
        [("abc", "a@b.c"), ("ab", "a.b"), ("x" * 65, "a@b"), ("x" * 64, "a.b@c@d.e"), (None, None)],
        "username string, email_adress string",
    )
    got = rows(employees.account_format_check(users).select("valid_username", "valid_email"))
    assert got == [(True, True), (False, False), (False, False), (True, True), (False, False)]


def test_user_active(spark):
    users = spark.createDataFrame([(1, 1), (2, 2), (3, 99)], "id bigint, matricule bigint")
    df = staff(spark, person(1), person(2, date_left=dt.date(2020, 1, 1)))
    assert sorted(rows(employees.user_active(users, df).select("id", "active"))) == [(1, True), (2, False), (3, True)]


@pytest.mark.parametrize("fields, reason", [
    ({}, None),
    ({"first_name": "  "}, "First name and last name are required"),
    ({"last_name": None, "birth_date": "x"}, "First name and last name are required"),
    ({"birth_date": "1990-2-30", "matricule": "x"}, "Invalid birth_date"),
    ({"birth_date": "", "matricule": "x"}, "Birth date is required"),
    ({"matricule": "7.5"}, "Invalid matricule"),
    ({"matricule": "0"}, "Matricule is required"),
    ({"matricule": " "}, "Matricule is required"),
    ({"echelon": "x", "salaire_base": "-1"}, "Invalid echelon"),
    ({"salaire_base": "1,5"}, "Invalid salaire_base"),
    ({"salaire_base": "-0.01"}, "Salaire de base cannot be negative"),
    ({"indemnite_transport": "-7"}, None),
    ({"nombre_enfants": "two"}, "Invalid nombre_enfants"),
    ({"date_joined": "2020-13-01"}, "Invalid date_joined"),
    ({"date_titularisation": "2020-01-01 x"}, "Invalid date_titularisation"),
])
def test_intake_rules(spark, fields, reason):
    assert intake.validate_forms(forms(spark, form(**fields))).first().reason == reason


def test_intake_values(spark):
    got = intake.validate_forms(forms(spark, form(first_name=" <b>O'x</b>\t", salaire_base="1e2", nombre_enfants=""))).first()
    assert got.first_name == "&lt;b&gt;O&#x27;x&lt;/b&gt;"
    assert (got.salaire_base, got.nombre_enfants, got.grade, got.matricule) == (D("100.00"), 0, None, 7)


def test_inserts_refuse_taken_and_repeated_keys(spark):
    batch = forms(spark, form(1, matricule="1", first_name="New"), form(3, matricule="8", first_name="Late"),
                  form(2, matricule="8", first_name="First"), form(4, matricule="0"))
    got = changes.apply_inserts(staff(spark, person(1)), intake.validate_forms(batch))
    assert sorted(rows(got.select("matricule", "first_name"))) == [(1, "Ann"), (8, "First")]
    assert got.dtypes == [(f.name, f.dataType.simpleString()) for f in EMPLOYEES]


def test_edits_apply_in_order_and_stop_at_departure(spark):
    snapshot = staff(spark, person(1), person(2, date_left=dt.date(2019, 1, 1)), person(3), person(4))
    edits = forms(
        spark,
        (*form(1, matricule="1", first_name="One"), ""), (*form(2, matricule="1", first_name="Two"), "2020-5-1"),
        (*form(3, matricule="1", first_name="Three"), ""), (*form(4, matricule="2", first_name="Gone"), ""),
        (*form(5, matricule="3", first_name="Ok", grade=""), ""), (*form(6, matricule="3", salaire_base="-1"), ""),
        (*form(7, matricule="4", birth_date=""), ""),
        extra=["date_left"],
    ).withColumn("matricule", F.col("matricule").cast("bigint"))
    got = changes.apply_full_update(snapshot, intake.validate_forms(edits, editing=True))
    assert sorted(rows(got.select("matricule", "first_name", "grade", "date_left"))) == [
        (1, "Two", None, dt.date(2020, 5, 1)), (2, "Ann", "A1", dt.date(2019, 1, 1)), (3, "Ok", None, None),
        (4, "Ann", "A1", None),
    ]


def test_partial_updates_merge_field_by_field(spark):
    rng = random.Random(1)
    people = {m: {"grade": "A1", "corps": "T", "birth_date": dt.date(1980, 1, 1)} for m in range(1, 30)}
    snapshot = staff(spark, *[person(m, corps="T") for m in people])
    patches = []
    for seq in range(400):
        matricule = 1 if rng.random() < 0.4 else rng.randint(1, 40)
        present = [f for f in ("grade", "corps", "birth_date", "date_left") if rng.random() < 0.4]
        grade, day = rng.choice([None, "B", "C"]), rng.choice([None, dt.date(1990, 1, 1 + seq % 28)])
        patches.append((seq, matricule, present, grade, f"c{seq}", day, dt.date(2020, 1, 1)))
        if matricule in people:
            sent = {"grade": grade, "corps": f"c{seq}", "birth_date": day}
            for f in present:
                if f in sent and not (f == "birth_date" and sent[f] is None):
                    people[matricule][f] = sent[f]
    rng.shuffle(patches)
    df = spark.createDataFrame(
        patches, "seq bigint, matricule bigint, present array<string>, grade string, corps string, birth_date date, date_left date"
    )
    got = changes.apply_partial_update(snapshot, df)
    assert {r.matricule: (r.grade, r.corps, r.birth_date, r.date_left) for r in got.collect()} == {
        m: (p["grade"], p["corps"], p["birth_date"], None) for m, p in people.items()
    }


def test_terminations_take_the_first_valid_request(spark):
    snapshot = staff(spark, person(1), person(2, date_left=dt.date(2019, 1, 1)), person(3, date_joined=None))
    asked = [
        (1, 1, ""), (2, 1, "2014-01-01"), (3, 1, "2020-02-30"), (4, 1, "2016-1-2"), (5, 1, "2017-01-01"), (6, 1, ""),
        (7, 2, "2020-01-01"), (8, 3, "1950-01-01"), (9, 99, "2020-01-01"),
    ]
    df = spark.createDataFrame(asked, "seq bigint, matricule bigint, date_left string")
    reasons = {r.seq: r.reason for r in intake.validate_terminations(df, snapshot).collect()}
    gone = "Employee is already terminated"
    assert reasons == {
        1: "Termination date is required", 2: "Termination date cannot be before hire date", 3: "Invalid date_left",
        4: None, 5: gone, 6: gone, 7: gone, 8: None, 9: "Employee not found",
    }
    after = {r.matricule: r.date_left for r in changes.apply_terminations(snapshot, df).collect()}
    assert after == {1: dt.date(2016, 1, 2), 2: dt.date(2019, 1, 1), 3: dt.date(1950, 1, 1)}


def test_unchecked_terminations_default_to_today(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 2, dt.date(2000, 1, 1))], "seq bigint, matricule bigint, date_left date")
    got = changes.apply_terminations(
        staff(spark, person(1), person(2)), df, today=F.lit("2021-03-04").cast("date"), checked=False
    )
    assert sorted(rows(got.select("matricule", "date_left"))) == [(1, dt.date(2021, 3, 4)), (2, dt.date(2000, 1, 1))]


def test_required_columns_are_enforced(spark, tmp_path):
    bad = staff(spark, person(1)).withColumn("last_name", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="last_name may not be NULL"):
        tables.load_table(bad, "employees", str(tmp_path / "bad"))


def test_appended_movements_leave_employees_alone(spark, tmp_path):
    path = str(tmp_path / "m")
    one = spark.createDataFrame([(1, 5, dt.date(2020, 1, 1))], "id bigint, matricule bigint, recruitment_date date")
    tables.append_movements(one, "recruitment", path)
    got = tables.append_movements(one.withColumn("id", F.lit(2)), "recruitment", path)
    assert sorted(rows(got.select("id", "matricule", "notes"))) == [(1, 5, None), (2, 5, None)]


def test_choices_and_year_reports(spark):
    df = staff(spark, person(1, corps=""), person(2, corps=None), person(3, corps="B"), person(4, corps="A", date_joined=None))
    assert rows(rollups.distinct_codes(df, "corps")) == [("A",), ("B",)]
    assert rows(rollups.distinct_join_years(df)) == [(2015,)]
    moves = spark.createDataFrame(
        [(1, dt.date(2020, 12, 31), "a", "b", "", None), (2, dt.date(2021, 1, 1), "a", "b", "x", "y")],
        "matricule bigint, day_of date, first_name string, last_name string, corps string, grade string",
    )
    assert rows(rollups.movements_of_year(moves, "day_of", 2020)) == [(1, "a b", 31, 12, 2020, "-", "-")]


def test_a_hot_employee_in_every_batch(spark):
    """A third of all changes hit one employee; results equal handling them one after the other."""
    rng = random.Random(11)
    people = {m: {"first_name": "Ann", "grade": "A1", "left": None, "joined": dt.date(2010, 1, 1)} for m in range(1, 40)}
    snapshot = staff(spark, *[person(m, date_joined=p["joined"]) for m, p in people.items()])

    def pick():
        return 1 if rng.random() < 0.34 else rng.randint(1, 60)

    edits, exits = [], []
    for seq in range(600):
        left = "2021-01-01" if rng.random() < 0.01 else ""
        edits.append((*form(
            seq, matricule=str(pick()), first_name=rng.choice(["", f"n{seq}"]), grade=rng.choice(["", "B"]),
            salaire_base=rng.choice(["1", "-1", "x", ""]),
        ), left))
        day = rng.choice(["", "x", "2009-12-31", f"2015-{rng.randint(1, 12)}-{rng.randint(1, 28)}"])
        exits.append((seq, pick(), day))

    edited = {m: dict(p) for m, p in people.items()}
    for e in edits:
        row = dict(zip(["seq", *FORM, "date_left"], e))
        target = edited.get(int(row["matricule"]))
        if target and target["left"] is None and row["first_name"] and row["salaire_base"] in ("1", ""):
            target.update(first_name=row["first_name"], grade=row["grade"] or None,
                          left=dt.date(2021, 1, 1) if row["date_left"] else None)
    rng.shuffle(edits)
    batch = forms(spark, *edits, extra=["date_left"]).withColumn("matricule", F.col("matricule").cast("bigint"))
    got = changes.apply_full_update(snapshot, intake.validate_forms(batch, editing=True))
    assert {r.matricule: (r.first_name, r.grade, r.date_left) for r in got.collect()} == {
        m: (p["first_name"], p["grade"], p["left"]) for m, p in edited.items()
    }

    ended = dict.fromkeys(people)
    reasons = {}
    for seq, m, day in exits:
        if m not in people:
            reasons[seq] = "Employee not found"
        elif ended[m]:
            reasons[seq] = "Employee is already terminated"
        elif not day:
            reasons[seq] = "Termination date is required"
        elif day == "x":
            reasons[seq] = "Invalid date_left"
        elif day < "2010":
            reasons[seq] = "Termination date cannot be before hire date"
        else:
            reasons[seq] = None
            ended[m] = dt.datetime.strptime(day, "%Y-%m-%d").date()
    rng.shuffle(exits)
    asked = spark.createDataFrame(exits, "seq bigint, matricule bigint, date_left string")
    assert {r.seq: r.reason for r in intake.validate_terminations(asked, snapshot).collect()} == reasons
    assert {r.matricule: r.date_left for r in changes.apply_terminations(snapshot, asked).collect()} == ended
