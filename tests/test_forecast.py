"""Scenario rules and projections against plain arithmetic, one period after the other."""

from __future__ import annotations

import calendar
import random

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from muster.operators import projection, scenarios
from muster.operators.projection import LinearFormula
from muster.operators.joins import apply_factor
from muster.plans.backtest import bias_factor, compare_history

FIELDS = "scenario_id bigint, start_year bigint, end_year bigint, recruitments bigint, departures bigint, initial_employees bigint"
PAY = 239_227_929.56 / 3220


def formula(spark, kind="yearly", slope=70_000.0, intercept=1_234.5):
    return LinearFormula(kind, spark.createDataFrame([(slope, intercept)], "nbemp double, intercept double"), ["nbemp"])


def random_scenarios(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randint(2000, 2040)
        out.append((i, start, start + rng.randint(0, 20), rng.randint(0, 130), rng.randint(0, 130), rng.randint(1, 400)))
    return out


def yearly_by_hand(start, end, hires, exits, initial, slope=70_000.0, intercept=1_234.5):
    net, staff, pay, out = hires - exits, float(initial), None, []
    for year in range(start, end + 1):
        if year <= 2020:
            pay = max(0.0, staff * slope + intercept)
        elif pay is None:
            pay = staff * (PAY * 1.05 ** (year - 2020))
        else:
            before = staff - net
            pay = max(0.0, pay * (1.05 + (net / before if before > 0 else 0) * 0.7))
        months = [int(round(staff + m * (net / 12))) for m in range(12)]
        out.append((year, round(pay, 2), int(round(staff + net)), round(pay / 12, 2), months))
        staff = max(1, staff + net)
    return out


def monthly_by_hand(start, end, hires, leave, initial, floor, slope, intercept):
    staff, out = float(initial), []
    for year in range(start, end + 1):
        net = 0.0
        for month in range(1, 13):
            joined = hires if month == 1 else 0
            staff += joined
            net += joined - leave
            seen = max(floor, staff)
            staff = max(floor, staff - leave)
            out.append((year, month, seen, net, max(0.0, seen * slope + intercept), staff))
    return out


@pytest.mark.parametrize("scenario, expected", [
    ((2021, 2025, 120, 80, 3200), [
        (2021, 249629143.89, 3240), (2022, 264294856.09, 3280), (2023, 279793628.52, 3320),
        (2024, 296171792.14, 3360), (2025, 313478216.14, 3400),
    ]),
    ((2023, 2026, 0, 3, 5), [
        (2023, 430025.20, 2), (2024, 270915.88, -1), (2025, 142230.84, -2), (2026, 74671.19, -2),
    ]),
])
def test_projection_goldens(spark, scenario, expected):
    df = spark.createDataFrame([(1, *scenario)], FIELDS)
    got = projection.project_yearly(df, formula(spark)).orderBy("Year")
    assert rows(got.select("Year", "Total_Salary", "End_Employees")) == expected


def test_projection_equals_the_plain_walk(spark):
    cases = random_scenarios(1500)
    model = formula(spark)
    yearly = projection.project_yearly(spark.createDataFrame(cases, FIELDS), model)
    monthly = projection.monthly_split(yearly)
    got = {(r[0], r[1]): r[2:] for r in rows(yearly.select("scenario_id", "Year", "Total_Salary", "End_Employees"))}
    split = {
        (r[0], r[1], r[2]): r[3:]
        for r in rows(monthly.select("scenario_id", "Year", "Month", "Predicted_Salary", "Employees", "Month_Name"))
    }
    n = 0
    for i, *inputs in cases:
        for year, total, end, month_pay, months in yearly_by_hand(*inputs):
            n += 1
            assert got[i, year][1] == end
            assert got[i, year][0] == pytest.approx(total, rel=1e-14, abs=0.0101)
            for m in range(12):
                pay, staff, name = split[i, year, m + 1]
                assert (staff, name) == (months[m], calendar.month_name[m + 1])
                assert pay == pytest.approx(month_pay, rel=1e-14, abs=0.0101)
    assert n == len(got)


def test_projection_has_no_shuffle_and_no_fallback(spark):
    df = spark.range(1000).select(
        F.col("id").alias("scenario_id"), F.lit(2015).cast("bigint").alias("start_year"),
        F.lit(2030).cast("bigint").alias("end_year"), F.lit(5).cast("bigint").alias("recruitments"),
        F.lit(3).cast("bigint").alias("departures"), (F.col("id") + 1).alias("initial_employees"),
    )
    text = plan(projection.monthly_split(projection.project_yearly(df, formula(spark))))
    top = text.split("Subqueries")[0]
    assert "Exchange" not in top and "Window" not in top and "Join" not in top
    assert "EvalPython" not in text and "BatchEval" not in text


def test_span_is_not_capped(spark):
    df = spark.createDataFrame([(1, 2019, 2060, 7, 3, 10)], FIELDS)
    got = rows(projection.project_yearly(df, formula(spark)).select("Year", "Total_Salary", "End_Employees").orderBy("Year"))
    want = [r[:3] for r in yearly_by_hand(2019, 2060, 7, 3, 10)]
    assert [g[0::2] for g in got] == [w[0::2] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-14, abs=0.0101)


def test_monthly_engines_equal_the_plain_walk(spark):
    cases = random_scenarios(120, seed=5)
    df = spark.createDataFrame(cases, FIELDS)
    model = formula(spark, "monthly", 2_500.0, 10.0)
    monthly, yearly = projection.project_monthly(df, model)
    months = {(r[0], r[1], r[2]): r[3:] for r in rows(monthly.select("scenario_id", "Year", "Month", "Predicted_Salary", "Employees"))}
    years = {(r[0], r[1]): r[2:] for r in rows(yearly.select("scenario_id", "Year", "Total_Salary", "End_Employees"))}
    batch = {
        (r[0], r[1]): r[2:]
        for r in rows(projection.project_monthly_batch(df, model).select(
            "scenario_id", "Year", "total_yearly_salary", "avg_monthly_salary", "employees_end_of_year"))
    }
    for i, start, end, hires, exits, initial in cases:
        totals = {}
        for year, month, seen, _, pay, left in monthly_by_hand(start, end, hires, exits / 12, initial, 1, 2_500.0, 10.0):
            assert months[i, year, month] == (round(pay, 2), int(round(seen)))
            totals[year] = (totals.get(year, (0.0,))[0] + pay, int(round(left)))
        for year, (total, left) in totals.items():
            assert years[i, year][1] == left
            assert years[i, year][0] == pytest.approx(total, abs=0.0101)
        totals = {}
        for year, _, _, _, pay, left in monthly_by_hand(start, end, hires, exits, initial, 0, 2_500.0, 10.0):
            totals[year] = (totals.get(year, (0.0,))[0] + pay, left)
        for year, (total, left) in totals.items():
            assert batch[i, year][2] == left
            assert batch[i, year][0] == pytest.approx(total, abs=0.0101)
            assert batch[i, year][1] == pytest.approx(total / 12, abs=0.0101)


def test_monthly_features(spark):
    df = spark.createDataFrame([(1, 2021, 2022, 24, 30, 2)], FIELDS)
    walk = projection.monthly_walk(df, 1, "departures / 12").orderBy("Year", "Month")
    got = rows(walk.select("Year", "Month", "nbemp", "cumulative_net_change", "nb_departures", "cumulative_recruitments"))
    want = [
        (y, m, seen, net, 2.5, 24.0) for y, m, seen, net, _, _ in monthly_by_hand(2021, 2022, 24, 30 / 12, 2, 1, 1, 0)
    ]
    assert got == want


REQUESTS = "scenario_id bigint, start_year string, end_year string, recruitments string, departures string, initial_employees string"


@pytest.mark.parametrize("request_row, message", [
    (("2021", "2025", "120", "80", "3200"), None),
    (("2021", "2025", None, None, None), "Missing fields: recruitments, departures, initial_employees"),
    (("2021", "2025", "abc", "80", "3200"), "Invalid numeric values"),
    (("2025", "2021", "120", "80", "3200"), "End year must be greater than or equal to start year"),
    (("1999", "2001", "120", "80", "0"), "Invalid start year (2000-2100)"),
    (("2021", "2042", "1", "1", "10"), "Maximum range: 20 years"),
    (("2021", "2041", "1", "1", "10"), None),
    (("2021", "2022", "-1", "1", "10"), "Values must be positive"),
    (("2021", "2022", "1", "1", "0"), "Initial employees cannot be zero"),
    ((None, None, None, None, None), "Missing fields: start_year, end_year, recruitments, departures, initial_employees"),
])
def test_request_messages(spark, request_row, message):
    df = spark.createDataFrame([(1, *request_row)], REQUESTS)
    got = scenarios.check_requests(df).select("message", "ok").first()
    assert tuple(got) == (message, message is None)


HISTORY = "entity int, year int, mass_salary double, number_employees bigint, departures bigint, recruitment bigint"


def test_bias_is_one_minus_the_mean_error(spark):
    model = formula(spark, slope=1.0, intercept=0.0)
    history = spark.createDataFrame([(1, 2010, 100.0, 110, 0, 0), (1, 2011, 0.0, 5, 0, 0)], HISTORY)
    assert rows(bias_factor(history, model)) == [(0.95,)]
    one = spark.createDataFrame([(1, 1, 200.0), (2, 2, 200.0)], "entity int, scenario_id bigint, Total_Salary double")
    both = apply_factor(one, bias_factor(history, model, ["entity"]), ["Total_Salary"], ["entity"]).orderBy("scenario_id")
    assert rows(both.select("Total_Salary")) == [(190.0,), (200.0,)]
    assert rows(apply_factor(one, bias_factor(history.limit(0), model), ["Total_Salary"]).select("Total_Salary")) == [(200.0,)] * 2


def test_backtest_handles_zero_headcount(spark):
    history = spark.createDataFrame([(1, 2010, 100.0, 0, 3, 1)], HISTORY)
    got = compare_history(history, formula(spark, slope=2.0, intercept=7.0)).select("employees", "actual", "predicted")
    assert rows(got) == [(0, 100.0, 7.0)]


def test_tick_thinning(spark):
    df = spark.createDataFrame([(1, 2021, 2023, 1, 1, 10)], FIELDS)
    months = scenarios.expand_months(scenarios.expand_years(df))
    labels = [f"{y}-{m:02d}" for y in (2021, 2022, 2023) for m in range(1, 13)]
    got = sorted(r[0] for r in rows(projection.tick_thinning(months).select("Period")))
    assert got == labels[:: max(1, len(labels) // 12)]
