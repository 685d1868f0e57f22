"""Comparing predictions with what happened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions import money


def regression_metrics(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted", by: Sequence[str] = (),
) -> DataFrame:
    """n, MSE, RMSE, MAE, R2 and MAPE (percent; NULL if any actual is 0) in one aggregate."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((a - p) * (a - p)).alias("mse"),
        F.avg(F.abs(a - p)).alias("mae"),
        F.var_pop(a).alias("_spread"),
        F.avg(F.abs(F.try_divide(a - p, a))).alias("_relative"),
        F.count_if(a == 0).alias("_zeros"),
    )
    return sums.select(
        *by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae",
        (1 - F.try_divide(F.col("mse"), F.col("_spread"))).alias("r2"),
        F.when(F.col("_zeros") == 0, F.col("_relative") * 100).alias("mape"),
    )


def predictions_to_yearly(monthly: DataFrame, by: Sequence[str] = ("entity",)) -> DataFrame:
    """Actual and predicted pay per year, with mean headcount."""
    return monthly.groupBy(*by, "Year").agg(
        F.sum("mass_salary").alias("actual_yearly_salary"),
        F.sum("predicted_salary").alias("predicted_yearly_salary"),
        F.avg("nbemp").alias("avg_employees"),
    )


def _relative(error: Column, actual: Column) -> Column:
    """Error over actual; rows without a positive actual count as 0."""
    return F.when(actual > 0, error / actual).otherwise(F.lit(0.0))


def backtest_errors(compared: DataFrame) -> DataFrame:
    """Unrounded errors of ``actual`` / ``predicted`` rows."""
    actual, error = F.col("actual"), F.abs(F.col("predicted") - F.col("actual"))
    return compared.withColumns({
        "absolute_error": error, "error_percent": _relative(error, actual) * 100,
    })


def backtest_rows(compared: DataFrame) -> DataFrame:
    """The comparison table: every figure rounded to cents."""
    return backtest_errors(compared).withColumns({
        "difference": F.expr(money("predicted - actual")),
        **{c: F.expr(money(c)) for c in ("actual", "predicted", "absolute_error", "error_percent")},
    })


def backtest_metrics(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MAE and MAPE as means of the unrounded row errors."""
    return backtest_errors(compared).groupBy(*by).agg(
        F.expr(money("avg(absolute_error)")).alias("mae"),
        F.expr(money("avg(error_percent)")).alias("mape"),
        F.count("*").alias("num_years"),
    )


def backtest_footer(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TOTAL and AVERAGE lines under the comparison table: sums of its rounded figures, and the MAPE
    of the unrounded ones, from one aggregate."""
    sums = backtest_errors(compared).groupBy(*by).agg(
        F.sum(F.expr(money("actual"))).alias("actual"),
        F.sum(F.expr(money("predicted"))).alias("predicted"),
        F.expr(money("avg(error_percent)")).alias("mape"),
        F.count("*").alias("n"),
    )
    lines = """inline(array(
        named_struct('line', 'TOTAL', 'actual', actual, 'predicted', predicted, 'difference', predicted - actual,
            'error_percent', try_divide(abs(predicted - actual), actual) * 100),
        named_struct('line', 'AVERAGE', 'actual', actual / n, 'predicted', predicted / n,
            'difference', (predicted - actual) / n, 'error_percent', mape)))"""
    return sums.selectExpr(*by, lines)


def error_band(rows: DataFrame) -> DataFrame:
    band = (
        F.when(F.col("error_percent") < 5, "good")
        .when(F.col("error_percent") < 10, "warn")
        .otherwise("bad")
    )
    sign = F.when(F.col("difference") >= 0, "+").otherwise("-")
    return rows.withColumns({"band": band, "sign": sign})


def signed_bias(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean relative overestimate. Rows without a positive actual add 0 but are counted."""
    error = F.col("predicted") - F.col("actual")
    return compared.groupBy(*by).agg(F.avg(_relative(error, F.col("actual"))).alias("bias"))


def correction_factor(bias: DataFrame) -> DataFrame:
    return bias.withColumn("factor", 1 - F.col("bias")).drop("bias")


def residuals(df: DataFrame) -> DataFrame:
    return df.withColumn("residual", F.col("actual") - F.col("predicted"))


def residual_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width counts of ``residual``; the last bin is closed. The bounds are one scalar subquery."""
    bounds = df.agg(F.struct(F.min("residual").alias("lo"), F.max("residual").alias("hi")).alias("b"))
    at = f"floor((residual - _b.lo) / nullif(_b.hi - _b.lo, 0D) * {bins})"
    bounded = df.select("residual").withColumn("_b", bounds.scalar())
    placed = bounded.select(F.expr(f"least(coalesce({at}, 0), {bins - 1})").alias("bin"))
    return placed.groupBy("bin").agg(F.count("*").alias("rows"))
