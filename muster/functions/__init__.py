"""Scalar expressions as SQL text, for ``F.expr`` / ``selectExpr``.

Each function takes a column name or expression and returns an expression, so they nest. All are
built-in Catalyst expressions and stay inside whole-stage code generation.
"""

from muster.functions.dates import month_name, parse_date, period_label, within_year
from muster.functions.numbers import half_even, money, parse_float, parse_int, parse_key
from muster.functions.text import ascii_lower, blank_to_null, html_escape, sanitize, strip

__all__ = [
    "ascii_lower", "blank_to_null", "half_even", "html_escape", "money", "month_name",
    "parse_date", "parse_float", "parse_int", "parse_key", "period_label", "sanitize",
    "strip", "within_year",
]
