"""Numeric parsing and rounding expressions."""

from __future__ import annotations

from muster.functions.text import strip

_INT = "^[+-]?[0-9]+(_[0-9]+)*$"
_FLOAT = "(?i)^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?|nan|inf|infinity)$"


def parse_int(x: str) -> str:
    """Whole-number text to BIGINT; anything else ('abc', '2021.7', '') is NULL."""
    s = strip(f"cast({x} AS STRING)")
    return f"CASE WHEN {s} RLIKE '{_INT}' THEN try_cast(replace({s}, '_', '') AS BIGINT) END"


def parse_float(x: str) -> str:
    """Number text to DOUBLE; text only the JVM parser accepts ('10d', hex) is NULL."""
    s = strip(f"cast({x} AS STRING)")
    return f"CASE WHEN {s} RLIKE '{_FLOAT}' THEN try_cast({s} AS DOUBLE) END"


def parse_key(x: str) -> str:
    """Year / month keys: number text truncated to INT; NaN, infinities and junk are NULL."""
    return f"try_cast({parse_float(x)} AS INT)"


def half_even(x: str) -> str:
    """Nearest whole number, ties to even; NULL beyond BIGINT."""
    return f"CASE WHEN abs({x}) < {float(2**63)!r}D THEN cast(rint({x}) AS BIGINT) END"


def money(x: str) -> str:
    """Round to cents on the exact binary value, ties to even.

    Spark's round() and bround() work on the shortest decimal text of a double, so 2.675 (really
    2.67499...) would become 2.68. Here the fraction is widened to a 2^56 (2^60 below 1/16) integer,
    which is exact, and the remainder after whole cents decides. From 2^46 on doubles are more than
    a cent apart and are returned as they are.
    """
    size = f"abs({x})"

    def cents(bits: int) -> str:
        scaled = f"cast({size} % 1D * {float(2**bits)!r}D AS BIGINT) * 100"
        whole = f"shiftright({scaled}, {bits})"
        rest = f"({scaled} & {2**bits - 1}L)"
        up = f"{rest} > {2 ** (bits - 1)}L OR ({rest} = {2 ** (bits - 1)}L AND {whole} % 2 = 1)"
        return f"{whole} + CASE WHEN {up} THEN 1 ELSE 0 END"

    total = f"floor({size}) * 100 + CASE WHEN {size} < 0.0625D THEN {cents(60)} ELSE {cents(56)} END"
    return (
        f"CASE WHEN {size} >= {float(2**46)!r}D THEN {x}"
        f" ELSE signum({x}) * cast({total} AS DOUBLE) / 100D END"
    )
