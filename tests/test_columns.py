"""Scalar functions: money, flags, percentages, labels, hours, NA tokens."""

import math

import pytest
from pyspark.errors import ArithmeticException, NumberFormatException
from pyspark.sql import functions as F

from ledgerlens.functions import (daily_hours, density_class, lenient_number, money_from_text,
                                  pct, period_label, yes_flag)
from ledgerlens.sources.files import NA_TOKENS, na_to_null, read_csv_na


def test_money_from_text(spark):
    df = spark.createDataFrame([("$68,423.46",), ("$-77.00",), ("$1,234.5",), (None,)], "a string")
    got = [r[0] for r in df.select(money_from_text("a").cast("double")).collect()]
    assert got == [68423.46, -77.0, 1234.5, None]


@pytest.mark.parametrize("junk", ["", "abc", "$"])
def test_money_junk_raises(spark, junk):
    df = spark.createDataFrame([(junk,)], "a string")
    with pytest.raises((NumberFormatException, ArithmeticException, Exception)):
        df.select(money_from_text("a")).collect()


def test_yes_flag_three_valued(spark):
    df = spark.createDataFrame([("YES",), ("Yes",), ("no",), (" yes",), (None,)], "a string")
    assert [r[0] for r in df.select(yes_flag("a")).collect()] == [True, True, False, False, None]


def test_pct_zero_guard(spark):
    df = spark.createDataFrame([(1, 6), (0, 0)], "n long, d long")
    got = [r[0] for r in df.select(pct("n", "d")).collect()]
    assert math.isclose(got[0], 16.666666666666668) and got[1] == 0.0


def test_period_label_no_padding_null_safe(spark):
    df = spark.createDataFrame([(2019, 1), (2020, 11), (None, 3)], "y int, m int")
    assert [r[0] for r in df.select(period_label("y", "m")).collect()] == ["2019-1", "2020-11", None]


# F3
HOURS = [("9", "18", 9.0), ("22", "6", 8.0), ("8", "8", 0.0), (" 7 ", "15.5", 8.5),
         ("1e1", "12", 2.0), ("08:30", "18", None), ("nan", "5", None), ("1f", "5", None)]


def test_hours_parse_and_wrap(spark):
    from ledgerlens.plans.star import operating_hours
    df = spark.createDataFrame([(i, o, c) for i, (o, c, _) in enumerate(HOURS)],
                               "id int, horaApertura string, horaCierre string")
    got = {r.id: r.horas_operacion_diarias for r in operating_hours(df).collect()}
    want = {i: h for i, (_, _, h) in enumerate(HOURS) if h is not None}
    assert got == want


def test_lenient_number_grammar(spark):
    vals = ["1.", "+.5", "-3.5\t", "1_0", "0x10", "1.0d", "Infinity", "-inf", ""]
    df = spark.createDataFrame([(v,) for v in vals], "a string")
    got = [r[0] for r in df.select(lenient_number("a")).collect()]
    assert got[:3] == [1.0, 0.5, -3.5]
    assert got[3:6] == [None, None, None]
    assert got[6] == math.inf and got[7] == -math.inf and got[8] is None


def test_daily_hours_equal_is_zero(spark):
    df = spark.createDataFrame([(8.0, 8.0), (23.0, 1.0)], "o double, c double")
    assert [r[0] for r in df.select(daily_hours("o", "c")).collect()] == [0.0, 2.0]


# F8
def test_density_class(spark):
    df = spark.createDataFrame([(0.0,), (40.0,), (50.0,), (100.0,)], "v double")
    got = [r[0] for r in df.select(density_class("v", F.lit(100.0))).collect()]
    assert got == [0.4, 0.4, 0.8, 0.8]
    one = spark.createDataFrame([(0.0,)], "v double")
    assert one.select(density_class("v", F.lit(0.0))).first()[0] == 0.4


# F11
def test_na_tokens_csv(spark, tmp_path):
    p = tmp_path / "na.csv"
    p.write_text('k,v\n1,NA\n2,null\n3,None\n4,n/a\n5,\n6,""\n7,x\n8, NA \n')
    got = {r.k: r.v for r in read_csv_na(spark, str(p)).collect()}
    assert [got[str(i)] for i in range(1, 7)] == [None] * 6
    assert got["7"] == "x" and got["8"] == " NA "


def test_na_tokens_leave_numbers(spark):
    df = spark.createDataFrame([("NaN", 1.5)], "s string, d double")
    r = na_to_null(df).first()
    assert r.s is None and r.d == 1.5 and "nan" in NA_TOKENS


def _py_float(v):
    """The behaviour to match: Python's float(), minus digit underscores."""
    if "_" in v:
        return None
    try:
        return float(v)
    except ValueError:
        return None


def test_lenient_number_matches_python_float(spark):
    import random
    rnd = random.Random(11)
    alphabet = "0123456789..++--eE  \tinfatyx"
    words = ["inf", "nan", "infinity", "-inf", "+nan", "1e", "e1", ".", "1.", ".5"]
    vals = []
    for _ in range(4000):
        if rnd.random() < 0.15:
            v = rnd.choice(words)
            if rnd.random() < 0.5:
                v = v.upper() if rnd.random() < 0.5 else " " + v + "\t"
        else:
            v = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 7)))
        vals.append(v)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = {r.i: r.x for r in df.select("i", lenient_number("v").alias("x")).collect()}
    for i, v in enumerate(vals):
        want, have = _py_float(v), got[i]
        if want is not None and math.isnan(want):
            assert have is not None and math.isnan(have), v
        else:
            assert have == want, (v, have, want)


def test_lenient_date(spark):
    from ledgerlens.functions.columns import parse_yyyymmdd
    df = spark.createDataFrame([("20210131",), ("junk",), ("20210230",), (None,)], "d string")
    got = [r[0] for r in df.select(parse_yyyymmdd("d", strict=False)).collect()]
    assert [g and g.isoformat() for g in got] == ["2021-01-31", None, None, None]
