"""Cleaning of the file inputs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions import parse_float, parse_key

# Header spellings (trimmed, lower-cased) of the period keys.
YEAR_HEADERS = ("dep_annee", "annee", "year")
MONTH_HEADERS = ("dep_mois", "mois", "month")


def computed(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Set columns to SQL expressions that are evaluated once per row, whatever is filtered later.

    A filter on a projected column is normally rewritten into the column's expression and pushed
    below the projection. For parsed text that means parsing again in every predicate. The values
    are emitted by a one-row generator here, which filters are not pushed through.
    """
    kept = [c for c in df.columns if c not in columns]
    values = F.struct(*[F.expr(sql).alias(name) for name, sql in columns.items()])
    return df.select(*kept, F.inline(F.array(values)))


def normalize_keys(df: DataFrame) -> DataFrame:
    """Rename any spelling of the period headers to ``Year`` / ``Month`` (schema only, no job)."""
    renames = {}
    for name in df.columns:
        header = name.strip().lower()
        if header in YEAR_HEADERS:
            renames[name] = "Year"
        elif header in MONTH_HEADERS:
            renames[name] = "Month"
    return df.withColumnsRenamed(renames)


def coerce_keys(df: DataFrame, keys: Iterable[str] = ("Year", "Month")) -> DataFrame:
    """Text keys to whole numbers; rows whose key is no number are dropped."""
    keys = list(keys)
    return computed(df, {k: parse_key(k) for k in keys}).dropna(subset=keys)


def coerce_values(df: DataFrame, values: Iterable[str]) -> DataFrame:
    """Measure columns read as text to DOUBLE."""
    return df.withColumns({v: F.expr(parse_float(v)) for v in values})


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Months without salary or headcount cannot be learned from."""
    return df.dropna(subset=["mass_salary", "nbemp"])


def missing_counts(df: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """NULLs per column, in one pass."""
    by = list(by)
    return df.groupBy(*by).agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns if c not in by]
    )
