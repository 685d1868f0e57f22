from __future__ import annotations

import datetime as dt
import html
import math
import random

import pytest
from pyspark.sql import functions as F

from muster import functions as fn


def evaluate(spark, expression, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(F.expr(expression)).collect()]


def test_money_rounds_the_binary_value(spark):
    rng = random.Random(7)
    values = [2.675, 8.125, 0.125, 0.015, 0.005, 0.045, 1.005, -2.675, -8.125, 0.0, 1e15 + 0.125, 7e13 + 0.01]
    values += [rng.uniform(-1e9, 1e9) for _ in range(20_000)]
    values += [rng.randrange(-10**9, 10**9) / 1000 for _ in range(20_000)]
    values += [rng.randrange(-10**6, 10**6) / 8 for _ in range(5_000)]
    values += [rng.uniform(0, 0.2) for _ in range(5_000)]
    got = evaluate(spark, fn.money("x"), values, "double")
    assert [g for g, v in zip(got, values) if g != round(v, 2)] == []


def test_money_keeps_null_nan_and_infinity(spark):
    got = evaluate(spark, fn.money("x"), [None, float("nan"), float("inf"), float("-inf")], "double")
    assert got[0] is None and math.isnan(got[1]) and got[2:] == [math.inf, -math.inf]


def test_half_even(spark):
    values = [0.5, 1.5, 2.5, -0.5, -1.5, 3.49999, 8.500000000000002]
    assert evaluate(spark, fn.half_even("x"), values, "double") == [int(round(v)) for v in values]


def test_parse_int(spark):
    values = [" 2010 ", "+5", "-7\n", "1_000", "2021.7", "abc", "", None, "10d", " 5"]
    assert evaluate(spark, fn.parse_int("x"), values, "string") == [2010, 5, -7, 1000, None, None, None, None, None, 5]


def test_parse_float(spark):
    values = ["1e3", " .5", "5.", "10d", "0x1p3", "-2.5", "", "abc", None]
    assert evaluate(spark, fn.parse_float("x"), values, "string") == [1000.0, 0.5, 5.0, None, None, -2.5, None, None, None]
    special = evaluate(spark, fn.parse_float("x"), ["nan", "INF", "-infinity"], "string")
    assert math.isnan(special[0]) and special[1:] == [math.inf, -math.inf]


def test_parse_key_truncates_and_drops_junk(spark):
    values = [" 2010 ", "2010.7", "-3.9", "abc", "", "NaN", "inf", "1e30", None]
    assert evaluate(spark, fn.parse_key("x"), values, "string") == [2010, 2010, -3, None, None, None, None, None, None]


def test_parse_date(spark):
    values = ["2020-01-05", "2020-1-5", "2020-02-30", "x", "2020-01-05 10:00", "", None, "0000-01-01", " 2020-02-29 "]
    day = dt.date(2020, 1, 5)
    assert evaluate(spark, fn.parse_date("x"), values, "string") == [
        day, day, None, None, None, None, None, None, dt.date(2020, 2, 29),
    ]


@pytest.mark.parametrize("value", [" <b>O'x</b>\t", "a & b", '"q"', "　wide\xa0", "", None, "&amp;", "it''s"])
def test_sanitize(spark, value):
    assert evaluate(spark, fn.sanitize("x"), [value], "string") == [html.escape((value or "").strip())]


def test_strip_matches_python_for_every_space(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert evaluate(spark, fn.strip("x"), [s + "a b" + s for s in spaces], "string") == ["a b"] * len(spaces)


def test_ascii_lower_keeps_accents(spark):
    assert evaluate(spark, fn.ascii_lower("x"), ["ÉCOLE Zed"], "string") == ["École zed"]


def test_labels(spark):
    df = spark.createDataFrame([(2021, 3)], "y int, m int")
    got = df.select(F.expr(fn.month_name("m")), F.expr(fn.period_label("y", "m"))).first()
    assert tuple(got) == ("March", "2021-03")
