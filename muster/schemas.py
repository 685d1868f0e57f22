"""Stored-table schemas and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DateType(), T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)

# Columns and types of the stored tables.
EMPLOYEES = _struct(
    ("matricule", _L, False),
    ("first_name", _S, False),
    ("last_name", _S, False),
    ("birth_date", _D, False),
    ("grade", _S, True),
    ("echelon", _I, True),
    ("indice", _I, True),
    ("corps", _S, True),
    ("salaire_base", MONEY, True),
    ("indemnite_residence", MONEY, True),
    ("indemnite_transport", MONEY, True),
    ("situation_familiale", _S, True),
    ("nombre_enfants", _I, True),
    ("date_joined", _D, True),
    ("date_titularisation", _D, True),
    ("date_left", _D, True),
)

USERS = _struct(
    ("id", _L, False),
    ("username", _S, False),
    ("email_adress", _S, False),
    ("matricule", _L, False),
    ("created_at", _TS, True),
)

RECRUITMENT = _struct(
    ("id", _L, False),
    ("matricule", _L, False),
    ("recruitment_date", _D, False),
    ("grade", _S, True),
    ("corps", _S, True),
    ("first_name", _S, True),
    ("last_name", _S, True),
    ("notes", _S, True),
    ("created_at", _TS, True),
)

TERMINATION = _struct(
    ("id", _L, False),
    ("matricule", _L, False),
    ("termination_date", _D, False),
    ("grade", _S, True),
    ("corps", _S, True),
    ("first_name", _S, True),
    ("last_name", _S, True),
    ("reason", _S, True),
    ("created_at", _TS, True),
)

PREDICTION_HISTORY = _struct(
    ("id", _L, False),
    ("user_id", _L, False),
    ("start_year", _L, False),
    ("end_year", _L, False),
    ("recruitments", _L, False),
    ("departures", _L, False),
    ("initial_employees", _L, False),
    ("result_json", _S, False),
    ("created_at", _TS, True),
)

SCENARIO_FIELDS = ["start_year", "end_year", "recruitments", "departures", "initial_employees"]

METRIC_FIELDS = [
    "monthly_r2", "monthly_mse", "monthly_rmse", "monthly_mae", "yearly_r2", "yearly_mse",
]

# Anchor of every projection past the last year with known pay.
LAST_KNOWN_YEAR = 2020
LAST_KNOWN_SALARY = 239_227_929.56
LAST_KNOWN_EMPLOYEES = 3220
AVG_SALARY_PER_EMPLOYEE = LAST_KNOWN_SALARY / LAST_KNOWN_EMPLOYEES
ANNUAL_GROWTH_RATE = 0.05
HEADCOUNT_ELASTICITY = 0.7
MAX_SPAN_YEARS = 20

# Labels of the grade codes.
GRADE_LABELS = {
    "A1": "Cadre Supérieur",
    "A2": "Cadre",
    "A3": "Cadre Adjoint",
    "B": "Maîtrise",
    "C": "Exécution",
    "D": "Ouvrier",
}

# Named feature sets of the salary models.
YEARLY_FEATURES = ["nbemp", "Year", "nb_departures", "Recruitments", "net_change"]
MONTHLY_FEATURES = [
    "nbemp", "Year", "Month", "nb_departures", "cumulative_recruitments", "cumulative_net_change",
]
EXPORT_FEATURES = ["Year", "Month", "nb_departures", "monthly_recruitment_effect", "nbemp"]
TARGET = "mass_salary"

# Messages that callers of the jobs see.
INVALID_START = "Invalid start year (2000-2100)"
END_BEFORE_START = "End year must be greater than or equal to start year"
SPAN_TOO_LONG = "Maximum range: 20 years"
NEGATIVE_VALUES = "Values must be positive"
NO_EMPLOYEES = "Initial employees cannot be zero"
MISSING_FIELDS = "Missing fields: "
NOT_NUMERIC = "Invalid numeric values"
NAMES_REQUIRED = "First name and last name are required"
BIRTH_REQUIRED = "Birth date is required"
KEY_REQUIRED = "Matricule is required"
NEGATIVE_SALARY = "Salaire de base cannot be negative"
KEY_TAKEN = "Matricule already exists"
NOT_FOUND = "Employee not found"
ALREADY_TERMINATED = "Employee is already terminated"
DATE_REQUIRED = "Termination date is required"
LEFT_BEFORE_HIRE = "Termination date cannot be before hire date"

PAY_PARTS = _struct(
    ("entity", _I, True),
    ("Year", _I, True),
    ("mass_salary", T.DecimalType(38, 4), True),
    ("staff_sum", T.DoubleType(), True),
    *[(c, _L, True) for c in ("staff_rows", "staff_most", "pay_rows", "departures", "departure_rows", "recruitments", "recruitment_rows")],
)
