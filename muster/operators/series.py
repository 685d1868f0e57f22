"""Window features over monthly and yearly series.

Every window is partitioned by entity and runs over a series, i.e. at most one row per calendar
period (see the package docstring), so the largest group is the number of months on record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _series(*order: str) -> WindowSpec:
    return Window.partitionBy("entity").orderBy(*order)


def _year() -> WindowSpec:
    return Window.partitionBy("entity", "Year")


def annual_recruitments(monthly: DataFrame) -> DataFrame:
    """Full-year total of recruitments on every month of the year."""
    return monthly.withColumn(
        "cumulative_recruitments", F.sum("Recruitments").over(_year())
    )


def net_change(df: DataFrame, name: str = "net_change") -> DataFrame:
    return df.withColumn(name, F.col("Recruitments") - F.col("nb_departures"))


def cumulative_net_change(monthly: DataFrame, of: str = "net_employee_change") -> DataFrame:
    running = _year().orderBy("Month").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.withColumn("cumulative_net_change", F.sum(of).over(running))


def year_normalized(df: DataFrame) -> DataFrame:
    first = F.min("Year").over(Window.partitionBy("entity"))
    return df.withColumn("year_normalized", F.col("Year") - first)


def monthly_recruitment_effect(monthly: DataFrame) -> DataFrame:
    return monthly.withColumn(
        "monthly_recruitment_effect", F.col("cumulative_recruitments") / 12
    )


def lag_features(yearly: DataFrame) -> DataFrame:
    w = _series("Year")
    return yearly.withColumns({
        "prev_salary": F.lag("mass_salary").over(w),
        "prev_employees": F.lag("nbemp").over(w),
    })


def growth_rates(yearly: DataFrame) -> DataFrame:
    """Relative change against the previous year; a zero base gives NULL."""
    w = _series("Year")

    def growth(c: str) -> Column:
        return F.try_divide(F.col(c), F.lag(c).over(w)) - 1

    return yearly.withColumns({
        "salary_growth": growth("mass_salary"), "employee_growth": growth("nbemp"),
    })


def backfill_then_zero(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fill gaps from the next known value of the series, and what remains with 0."""
    ahead = _series(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({
        c: F.coalesce(F.first(c, ignorenulls=True).over(ahead), F.lit(0.0)) for c in columns
    })


def salary_per_employee(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.try_divide("mass_salary", "nbemp"))


def yearly_features(yearly: DataFrame) -> DataFrame:
    """Feature frame of the yearly model (one shuffle: all windows share the entity key)."""
    df = salary_per_employee(growth_rates(lag_features(net_change(yearly))), "salary_per_employee")
    derived = [
        "prev_salary", "prev_employees", "salary_growth", "employee_growth", "salary_per_employee",
    ]
    return backfill_then_zero(df, derived, ["Year"])


def monthly_features(monthly: DataFrame) -> DataFrame:
    """Feature frame of the monthly model.

    The window over the whole entity comes first: its shuffle also serves the windows within a year.
    """
    df = net_change(year_normalized(monthly), "net_employee_change")
    df = annual_recruitments(cumulative_net_change(df))
    return salary_per_employee(df, "avg_salary_per_emp")


def export_features(monthly: DataFrame) -> DataFrame:
    """Feature frame of the export model."""
    return monthly_recruitment_effect(annual_recruitments(monthly))


def first_row_per_year(history: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Of several rows for a year the first in file order counts.

    An aggregate rather than a row_number window: copies of one year may be any number of rows, and the least
    ordinal (unique) is found before the shuffle.
    """
    first = history.groupBy("entity", "year").agg(F.min(ordinal).alias(ordinal))
    return history.join(first, ["entity", "year", ordinal], "left_semi")


def last_known(monthly: DataFrame) -> DataFrame:
    """Headcount of the last month of each series."""
    period = F.col("Year") * 100 + F.col("Month")
    return monthly.groupBy("entity").agg(
        F.max_by("nbemp", period).alias("last_employees"), F.max(period).alias("last_period")
    )


def tail_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Last ``n`` rows of each series."""
    latest = Window.partitionBy("entity").orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= n).drop("_back")


def _test_rows(rows: Column) -> Column:
    """Size of the test part: a fifth, rounded up."""
    return F.ceil(rows * F.lit(0.2))


def split_chronological(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Label the last fifth of each series ``test``, the rest ``train``."""
    latest = Window.partitionBy("entity").orderBy(*[F.desc(c) for c in order])
    return _label_split(df, latest)


def split_random(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Label a fifth of each series ``test`` by the rank of a seeded hash of its key: exact size,
    and the same rows on every run and every cluster."""
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    shuffled = Window.partitionBy("entity").orderBy(mark, *keys)
    return _label_split(df, shuffled)


def _label_split(df: DataFrame, test_first: WindowSpec) -> DataFrame:
    rows = F.count("*").over(Window.partitionBy("entity"))
    test = F.row_number().over(test_first) <= _test_rows(rows)
    return df.withColumn("split", F.when(test, "test").otherwise("train"))
