"""Validation of form rows (all text) into typed employee changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions import blank_to_null, parse_date, parse_float, parse_int, sanitize
from muster.operators.clean import computed
from muster.schemas import (
    ALREADY_TERMINATED,
    BIRTH_REQUIRED,
    DATE_REQUIRED,
    EMPLOYEES,
    KEY_REQUIRED,
    LEFT_BEFORE_HIRE,
    NAMES_REQUIRED,
    NEGATIVE_SALARY,
    NOT_FOUND,
)

TEXT = ["grade", "corps", "situation_familiale"]
WHOLE = ["echelon", "indice"]
AMOUNTS = ["salaire_base", "indemnite_residence", "indemnite_transport"]
DAYS = ["date_joined", "date_titularisation"]

_TYPES = {f.name: f.dataType for f in EMPLOYEES.fields}


def first_failure(*rules: tuple[Column, str]) -> Column:
    """Message of the first rule that fails, NULL when all hold."""
    message = F.lit(None).cast("string")
    for failed, text in reversed(rules):
        message = F.when(failed, F.lit(text)).otherwise(message)
    return message


def _held(c: str) -> Column:
    """A parsed field as its stored type, NULL if it does not fit."""
    return F.col(c).try_cast(_TYPES[c]) if c in (*WHOLE, *AMOUNTS, "nombre_enfants") else F.col(c)


def _bad(raw: Column, held: Column) -> Column:
    """Something was entered that cannot be read, or not be stored as it is."""
    return (raw != "") & held.isNull()


def validate_forms(forms: DataFrame, editing: bool = False) -> DataFrame:
    """Typed columns plus ``reason`` (NULL = accepted).

    Rules are tried in the order the entry form checks them. Other columns of ``forms`` (a sequence
    number, say) pass through. An edit addresses an existing key, so the key is not checked, and it
    may set ``date_left``.
    """
    days = [*DAYS, "date_left"] if editing else DAYS
    fields = ["first_name", "last_name", "birth_date", *WHOLE, *TEXT, *AMOUNTS, "nombre_enfants", *days]
    if not editing:
        fields.append("matricule")
    raw = forms.withColumns({f"raw_{c}": F.expr(sanitize(c)) for c in fields})

    parsers = dict.fromkeys([*WHOLE, "nombre_enfants", "matricule"], parse_int)
    parsers |= dict.fromkeys(AMOUNTS, parse_float) | dict.fromkeys(["birth_date", *days], parse_date)
    parsed = computed(raw, {c: parsers[c](f"raw_{c}") for c in fields if c in parsers})

    def bad(c: str) -> tuple[Column, str]:
        return _bad(F.col(f"raw_{c}"), _held(c)), f"Invalid {c}"

    names = (F.col("raw_first_name") == "") | (F.col("raw_last_name") == "")
    rules = [
        (names, NAMES_REQUIRED),
        bad("birth_date"),
        (F.col("birth_date").isNull(), BIRTH_REQUIRED),
    ]
    if not editing:
        missing = F.col("matricule").isNull() | (F.col("matricule") == 0)
        rules += [bad("matricule"), (missing, KEY_REQUIRED)]
    rules += [
        *[bad(c) for c in WHOLE],
        bad("salaire_base"),
        (F.col("salaire_base") < 0, NEGATIVE_SALARY),
        *[bad(c) for c in AMOUNTS[1:]],
        bad("nombre_enfants"),
        *[bad(c) for c in days],
    ]
    if editing:
        # The form does not ask for it again, but the stored column may not be NULL.
        rules.append(rules.pop(2))

    values = {c: F.expr(blank_to_null(f"raw_{c}")) for c in ["first_name", "last_name", *TEXT]}
    values |= {c: _held(c) for c in [*WHOLE, *AMOUNTS]}
    values["nombre_enfants"] = F.coalesce(_held("nombre_enfants"), F.lit(0))
    checked = parsed.withColumn("reason", first_failure(*rules))
    return checked.withColumns(values).drop(*[f"raw_{c}" for c in fields])


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNull()).drop("reason")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNotNull())


def _read_requests(requests: DataFrame) -> DataFrame:
    raw = requests.withColumn("raw_date_left", F.expr(sanitize("date_left"))).drop("date_left")
    return computed(raw, {"date_left": parse_date("raw_date_left")})


def first_valid_exits(requests: DataFrame, employees: DataFrame) -> DataFrame:
    """Per employee the first request (by ``seq``) that may end the employment, and its date.

    Requests are reduced to one row per employee and day before they meet the employees, so an
    employee with any number of requests brings no more rows than there are days.
    """
    days = _read_requests(requests).dropna(subset=["date_left"])
    firsts = days.groupBy("matricule", "date_left").agg(F.min("seq").alias("seq"))
    present = employees.filter("date_left IS NULL").select("matricule", "date_joined")
    valid = firsts.join(present, "matricule").filter("date_joined IS NULL OR date_left >= date_joined")
    return valid.groupBy("matricule").agg(
        F.min("seq").alias("end_seq"), F.min_by("date_left", "seq").alias("end_date")
    )


def validate_terminations(requests: DataFrame, employees: DataFrame) -> DataFrame:
    """``reason`` per termination request (``seq``, ``matricule``, ``date_left`` as text).

    Requests of one employee count in ``seq`` order: the first valid one ends the employment, the
    ones after it find the employee already terminated. What is known per employee is put together
    first; the requests join it once, as the last step, where a hot employee can be split.
    """
    known = employees.select(
        "matricule", "date_joined", F.col("date_left").alias("left_before"), F.lit(True).alias("known")
    ).join(first_valid_exits(requests, employees), "matricule", "left")
    gone = F.col("left_before").isNotNull() | (F.col("seq") > F.col("end_seq"))
    asked = _read_requests(requests).join(known, "matricule", "left")
    return asked.withColumn("reason", first_failure(
        (F.col("known").isNull(), NOT_FOUND),
        (gone, ALREADY_TERMINATED),
        (F.col("raw_date_left") == "", DATE_REQUIRED),
        (F.col("date_left").isNull(), "Invalid date_left"),
        (F.col("date_left") < F.col("date_joined"), LEFT_BEFORE_HIRE),
    )).select("seq", "matricule", "date_left", "reason")


def edit_guard(edits: DataFrame, employees: DataFrame) -> DataFrame:
    """Edits of employees that exist and have not left."""
    open_keys = employees.filter(F.col("date_left").isNull()).select("matricule")
    return edits.join(open_keys, "matricule", "left_semi")
