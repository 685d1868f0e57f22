"""Date expressions."""

from __future__ import annotations

from muster.functions.text import strip

_DAY = "^(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"


def parse_date(x: str) -> str:
    """Strict year-month-day; blank, impossible days and trailing text are NULL."""
    s = strip(f"cast({x} AS STRING)")
    return f"CASE WHEN {s} RLIKE '{_DAY}' THEN try_to_date({s}, 'yyyy-M-d') END"


# English month names.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]


def month_name(month: str) -> str:
    names = ", ".join(f"'{m}'" for m in MONTHS)
    return f"element_at(array({names}), cast({month} AS INT))"


def period_label(year: str, month: str) -> str:
    return f"concat_ws('-', cast({year} AS STRING), lpad(cast({month} AS STRING), 2, '0'))"


def within_year(x: str, year: int) -> str:
    """``year(x) = year`` written as a range, which reaches the Parquet scan."""
    return f"({x} >= DATE'{year:04d}-01-01' AND {x} <= DATE'{year:04d}-12-31')"
