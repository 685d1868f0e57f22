from __future__ import annotations

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from muster.operators import clean, joins, ranking, rollups, scoring, series
from muster.operators.regression import standardize


def yearly(spark, *values):
    return spark.createDataFrame(
        [(1, 2010 + i, *v) for i, v in enumerate(values)], "entity int, Year int, mass_salary double, nbemp double"
    )


def test_first_year_takes_its_lag_from_the_second(spark):
    df = series.growth_rates(series.lag_features(yearly(spark, (100.0, 10.0), (120.0, 10.0), (90.0, 5.0))))
    filled = series.backfill_then_zero(df, ["prev_salary", "salary_growth"], ["Year"]).orderBy("Year")
    got = rows(filled.select("prev_salary", F.round("salary_growth", 9)))
    assert got == [(100.0, 0.2), (100.0, 0.2), (120.0, -0.25)]


def test_single_year_backfills_to_zero(spark):
    df = series.lag_features(yearly(spark, (100.0, 10.0)))
    got = series.backfill_then_zero(df, ["prev_salary"], ["Year"]).select("prev_salary")
    assert rows(got) == [(0.0,)]


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 10, 15, 35, 80, 83])
def test_split_sizes(spark, n):
    df = spark.range(n).select(
        F.lit(1).alias("entity"), (2000 + F.floor(F.col("id") / 12)).alias("Year"), (F.col("id") % 12 + 1).alias("Month")
    )
    want = math.ceil(n * 0.2)
    ordered = series.split_chronological(df, ["Year", "Month"])
    assert ordered.filter("split = 'test'").count() == want
    first_test = ordered.filter("split = 'test'").agg(F.min(F.col("Year") * 12 + F.col("Month"))).first()[0]
    assert ordered.filter("split = 'train'").filter(F.col("Year") * 12 + F.col("Month") >= first_test).count() == 0
    drawn = series.split_random(df, ["Year", "Month"])
    assert drawn.filter("split = 'test'").count() == want


def test_random_split_is_stable_across_partitionings(spark):
    df = spark.range(200).select(F.lit(1).alias("entity"), F.col("id").alias("Year"), F.lit(1).alias("Month"))
    a = rows(series.split_random(df, ["Year", "Month"]).orderBy("Year"))
    b = rows(series.split_random(df.repartition(7), ["Year", "Month"]).orderBy("Year"))
    assert a == b


def test_first_row_per_year_with_many_copies(spark):
    df = spark.range(10_000).select(
        F.lit(1).alias("entity"), F.when(F.col("id") % 3 == 0, 2000).otherwise(F.col("id") % 7 + 2001).alias("year"),
        (F.col("id") * 2.0).alias("mass_salary"), F.col("id").alias("ordinal"),
    )
    got = {r[0]: r[1] for r in rows(series.first_row_per_year(df).select("year", "ordinal"))}
    want = {}
    for r in rows(df.orderBy("ordinal")):
        want.setdefault(r[1], r[3])
    assert got == want


def test_numbering_of_a_hot_key(spark):
    """One user holds a third of the rows, with equal timestamps; the other rows are spread thin."""
    df = spark.range(9_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).alias("user_id"),
        (F.col("id") % 40).alias("created_at"),
    )
    got = ranking.number_rows(df, "user_id", [F.desc("created_at"), F.col("id")], "position")
    seen = {r["id"]: r["position"] for r in got.collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r["user_id"], []).append((-r["created_at"], r["id"]))
    want = {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}
    assert seen == want and got.count() == 9_000


def test_hot_numbering_spreads_the_key(spark):
    df = spark.range(8_000).select(F.col("id"), F.lit(1).alias("user_id"))
    got = ranking.number_rows(df, "user_id", [F.col("id")], "position")
    sizes = [n for n in got.rdd.glom().map(len).collect() if n]
    assert sum(sizes) == 8_000 and max(sizes) < 4_000


def test_tail_n(spark):
    df = spark.range(30).select((F.col("id") % 2).alias("entity"), F.col("id").alias("Year"))
    got = sorted(rows(series.tail_n(df, 3, ["Year"])))
    assert got == [(0, 24), (0, 26), (0, 28), (1, 25), (1, 27), (1, 29)]


def test_normalize_keys_accepts_any_spelling(spark):
    df = spark.createDataFrame([("2010", "1", 3)], [" DEP_ANNEE", "Mois ", "nb"])
    assert clean.normalize_keys(df).columns == ["Year", "Month", "nb"]


def test_merge_yearly_fills_every_gap(spark):
    salary = spark.createDataFrame([(1, 2010, 5.0, 2.0)], "entity int, Year int, mass_salary double, nbemp double")
    empty = spark.createDataFrame([], "entity int, Year int, nb_departures bigint")
    none = spark.createDataFrame([], "entity int, Year int, Recruitments bigint")
    assert rows(joins.merge_yearly(salary, empty, none)) == [(1, 2010, 5.0, 2.0, 0, 0)]


def test_orphans_and_duplicates(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (9,), (9,), (None,)], "k bigint")
    parent = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert rows(joins.orphans(child, "k", parent, "id")) == [(9, 2)]
    assert sorted(rows(rollups.duplicate_keys(child, "k"))) == [("1", 2), ("9", 2)]


def test_standardize_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (3.0, 3.0)], "a double, b double")
    got = rows(standardize(df, ["a", "b"]))
    assert got == [(pytest.approx(-1.5**0.5), 0.0), (0.0, 0.0), (pytest.approx(1.5**0.5), 0.0)]


def test_metrics(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 190.0), (300.0, 330.0)], "actual double, predicted double")
    m = scoring.regression_metrics(df).first()
    assert m["mse"] == pytest.approx(1100 / 3) and m["mae"] == pytest.approx(50 / 3)
    assert m["r2"] == pytest.approx(1 - 1100 / 20000) and m["mape"] == pytest.approx((10 + 5 + 10) / 3)
    zero = spark.createDataFrame([(0.0, 1.0), (5.0, 5.0)], "actual double, predicted double")
    assert scoring.regression_metrics(zero).first()["mape"] is None


@pytest.mark.parametrize("error, band", [(4.99, "good"), (5.0, "warn"), (9.99, "warn"), (10.0, "bad")])
def test_error_band(spark, error, band):
    df = spark.createDataFrame([(error, -1.0)], "error_percent double, difference double")
    assert rows(scoring.error_band(df).select("band", "sign")) == [(band, "-")]


def test_residual_histogram_counts_every_row(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 101 * 1.0).alias("residual"))
    got = scoring.residual_histogram(df)
    assert got.agg(F.sum("rows")).first()[0] == 1000
    assert got.agg(F.min("bin"), F.max("bin")).first()[:] == (0, 29)
    flat = spark.range(5).select(F.lit(2.0).alias("residual"))
    assert rows(scoring.residual_histogram(flat)) == [(0, 5)]
