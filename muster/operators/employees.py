"""Employee records: derived values, presentation, search and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions import ascii_lower, money, parse_float, sanitize, within_year
from muster.functions.text import HTML_ENTITIES, WHITESPACE, literal
from muster.schemas import GRADE_LABELS

PAY = ["salaire_base", "indemnite_residence", "indemnite_transport"]
DATES = ["birth_date", "date_joined", "date_titularisation", "date_left"]


def total_salary(employees: DataFrame) -> DataFrame:
    """Base plus both allowances, a missing one counting as 0; stays DECIMAL."""
    base, residence, transport = [F.coalesce(c, F.lit(0).cast("decimal(10,2)")) for c in PAY]
    return employees.withColumn("total_salary", base + residence + transport)


def employee_record(employees: DataFrame) -> DataFrame:
    """Flat record as sent to clients: amounts as DOUBLE with 0 shown as missing, ISO dates."""
    return employees.withColumns(
        {c: F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in PAY}
        | {c: F.date_format(c, "yyyy-MM-dd") for c in DATES}
    )


def employee_json(employees: DataFrame) -> DataFrame:
    record = employee_record(employees)
    document = F.to_json(F.struct(*record.columns), {"ignoreNullFields": "false"})
    return record.select("matricule", document.alias("record"))


def display_row(employees: DataFrame) -> DataFrame:
    """Listing row as text; empty values and zero amounts show as '-'."""
    def amount(c: str) -> Column:
        text = F.format_string("%.2f", F.col(c).cast("double"))
        return F.when(F.col(c) != 0, text).otherwise("-")

    def text(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-"))

    grouped = F.when(F.col("salaire_base") != 0, F.format_number("salaire_base", 2))
    return employees.select(
        "matricule",
        F.concat("first_name", F.lit(" "), "last_name").alias("full_name"),
        text("grade").alias("grade"),
        F.when(F.col("echelon") != 0, F.col("echelon").cast("string")).otherwise("-").alias("echelon"),
        text("corps").alias("corps"),
        *[amount(c).alias(c) for c in PAY],
        F.coalesce(grouped, F.lit("-")).alias("salaire_base_grouped"),
        F.coalesce(F.date_format("date_joined", "yyyy-MM-dd"), F.lit("-")).alias("date_joined"),
        F.when(F.col("date_left").isNull(), "Active").otherwise("Terminated").alias("status"),
    )


def code_labels(employees: DataFrame) -> DataFrame:
    """Grade code and label; the six labels are an inline map, so there is no join."""
    pairs = [F.lit(text) for pair in GRADE_LABELS.items() for text in pair]
    label = F.try_element_at(F.create_map(*pairs), F.col("grade"))
    return employees.withColumn("grade_label", F.concat_ws(" - ", "grade", label))


def quick_salary(requests: DataFrame) -> DataFrame:
    """Starting salary from years of experience and education level.

    Unreadable experience counts as 0 and the rest is clamped to [0, 50]; NaN ends as 0 because both
    comparisons of the clamp are false for it. Unknown education counts as Bachelor.
    """
    parsed = requests.withColumns({
        "_years": F.expr(f"coalesce({parse_float(sanitize('experience'))}, 0D)"),
        "_level": F.expr(sanitize("coalesce(education, 'Bachelor')")),
    })
    years = "CASE WHEN isnan(_years) THEN 0D ELSE greatest(0D, least(_years, 50D)) END"
    rate = "CASE _level WHEN 'Master' THEN 1.2D WHEN 'PhD' THEN 1.5D ELSE 1D END"
    salary = parsed.withColumn("salary", F.expr(f"30000D + {years} * 2000D * {rate}"))
    return salary.withColumn("salary", F.expr(money("salary"))).drop("_years", "_level")


def search_employees(employees: DataFrame, term: str | None) -> DataFrame:
    """Rows whose first name, last name or matricule contains the term.

    Case folds for A-Z only and ``%`` / ``_`` in the term act as wildcards. The escape character is
    one that cannot be typed, so a backslash stands for itself.
    """
    term = clean_argument(term)
    if not term:
        return employees
    pattern = ascii_lower(literal(f"%{term}%"))
    hits = [
        f"{ascii_lower(f'cast({c} AS STRING)')} LIKE {pattern} ESCAPE '\\u0001'"
        for c in ("first_name", "last_name", "matricule")
    ]
    return employees.filter(" OR ".join(hits))


def filter_corps_grade(
    employees: DataFrame, corps: str | None = None, grade: str | None = None,
) -> DataFrame:
    for name, value in (("corps", corps), ("grade", grade)):
        value = clean_argument(value)
        if value:
            employees = employees.filter(F.col(name) == value)
    return employees


def filter_status(employees: DataFrame, status: str | None = None) -> DataFrame:
    if status == "active":
        return employees.filter(F.col("date_left").isNull())
    if status == "terminated":
        return employees.filter(F.col("date_left").isNotNull())
    return employees


def by_status(employees: DataFrame) -> DataFrame:
    """Every status an employee is listed under (``asked``), one row each, in one pass over the table."""
    own = F.when(F.col("date_left").isNull(), "active").otherwise("terminated")
    return employees.withColumn("asked", F.explode(F.array(F.lit("all"), own)))


def filter_join_year(employees: DataFrame, year: int | None = None) -> DataFrame:
    return employees.filter(within_year("date_joined", year)) if year else employees


def lookup_by_key(keys: DataFrame, employees: DataFrame) -> DataFrame:
    """One row per asked key; ``found`` is false where there is no such employee."""
    people = employees.withColumn("found", F.lit(True))
    return keys.join(people, "matricule", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def account_format_check(users: DataFrame) -> DataFrame:
    """E-mail has '@' and a '.' after the last one; user name has 3 to 64 characters."""
    domain = F.element_at(F.split("email_adress", "@", -1), -1)
    email = F.col("email_adress").contains("@") & domain.contains(".")
    name = F.length("username").between(3, 64)
    return users.withColumns({
        "valid_email": F.coalesce(email, F.lit(False)),
        "valid_username": F.coalesce(name, F.lit(False)),
    })


def user_active(users: DataFrame, employees: DataFrame) -> DataFrame:
    """An account is active unless its employee has left."""
    left = employees.select("matricule", F.col("date_left").isNull().alias("active"))
    return users.join(left, "matricule", "left").withColumn(
        "active", F.coalesce("active", F.lit(True))
    )


def clean_argument(value: str | None) -> str:
    """A filter argument goes through the same strip-and-escape as the stored text."""
    value = (value or "").strip(WHITESPACE)
    for char, entity in HTML_ENTITIES.items():
        value = value.replace(char, entity)
    return value
