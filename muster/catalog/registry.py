"""Registration of queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.catalog.domain import Domain
from muster.catalog.views_sql import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: SQL twins as registered, for queries that must give the same rows in another way.
ORACLE_BODIES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(domain)`` under ``name``; ``sql`` may use any domain view by name."""
    def register(fn: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Domain(spark, sf_dir))
        if sql is not None:
            ORACLE_BODIES[name] = sql
            ORACLES[name] = with_views(sql)
        return fn

    return register


def _used(text: str) -> set[str]:
    return set(re.findall(r"[a-z_0-9]+", text.lower())) & VIEWS.keys()


def with_views(body: str) -> str:
    """Prefix the domain views a statement needs, directly or through each other."""
    needed: set[str] = set()
    todo = _used(body)
    while todo:
        name = todo.pop()
        needed.add(name)
        todo |= _used(VIEWS[name]) - needed
    views = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed]
    return f"WITH RECURSIVE {', '.join(views)} {body}" if views else body


def sig(c: Column, digits: int = 12) -> Column:
    """Significant digits only: sums of doubles differ in their last bits between engines."""
    return F.format_string(f"%.{digits - 1}e", c).try_cast("double")


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text and decimals as doubles, for comparison across engines."""
    def column(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(f.name, "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        return F.col(f.name)

    return df.select(*[column(f) for f in df.schema.fields])
