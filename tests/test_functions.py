import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortloom import functions as fn
from cohortloom.functions import student
from cohortloom.operators.stats import t_quantile, t_two_sided


def test_flag_keeps_missing(column):
    assert column(["Y", "N", "U", None], "string", fn.flag01) == [1, 0, 0, None]
    assert column(["Y", "N", None], "string", lambda c: fn.yes_no(F.col(c) == "Y")) == ["Y", "N", None]


@pytest.mark.parametrize("values, strict, lenient", [([1, None], None, 1), ([1, 2], 3, 3)])
def test_sum_with_missing(spark, values, strict, lenient):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    row = df.agg(fn.na_sum("x").alias("a"), fn.na_sum("x", na_rm=True).alias("b")).first()
    assert tuple(row) == (strict, lenient)


def test_other_guarded_aggregates(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    strict = df.agg(*[f("x") for f in (fn.na_mean, fn.na_min, fn.na_max, fn.na_sd)]).first()
    assert tuple(strict) == (None,) * 4
    lenient = df.agg(*[f("x", True) for f in (fn.na_mean, fn.na_min, fn.na_max)]).first()
    assert tuple(lenient) == (2.0, 1.0, 3.0)
    assert df.limit(1).agg(fn.na_sd("x", True)).first()[0] is None


@pytest.mark.parametrize(
    "flags, expected",
    [("NUY", "Y"), ("NU", "U"), ("NN", "N"), (["Y", None], None), (["N", "Q"], None)],
)
def test_ever_flag(spark, flags, expected):
    df = spark.createDataFrame([(f,) for f in flags], "x string")
    assert df.agg(fn.ever_flag("x")).first()[0] == expected


def test_first_by_keeps_missing_first_value(spark):
    df = spark.createDataFrame([(2, "b"), (1, None), (3, "c")], "o int, x string")
    assert df.agg(fn.first_by("x", "o")).first()[0] is None


def test_percent_half_even_and_missing(spark):
    df = spark.createDataFrame([(i,) for i in range(800)], "x int")
    assert df.agg(fn.pct_where(F.col("x") < 1)).first()[0] == 0.12  # 0.125
    assert df.agg(fn.pct_where(F.col("x") < 20, 0)).first()[0] == 2.0  # 2.5
    with_null = df.withColumn("x", F.nullif("x", F.lit(5)))
    assert with_null.agg(fn.pct_where(F.col("x") < 1)).first()[0] is None


def test_blank_labels(column):
    out = column(["", "  ", "NA", None, "X"], "string", lambda c: fn.or_label(c, "NO COLLEGE"))
    assert out == ["NO COLLEGE"] * 4 + ["X"]


def test_terms(column):
    codes = [200920, 201730, 201740, 201799, None]
    assert column(codes, "int", fn.term_year) == [2009, 2017, 2017, 2017, None]
    assert column(codes, "int", fn.term_season) == ["Spring", "Summer", "Fall", None, None]
    assert column(codes, "int", fn.term_end) == [
        date(2009, 5, 31), date(2017, 8, 31), date(2017, 12, 31), None, None,
    ]


def test_term_of_begin_date(column):
    dates = [20120101, 20120430, 20120501, 20120731, 20120801, 20121231, 20120431, 20081231, 20180101, None]
    expected = [201220, 201220, 201230, 201230, 201240, 201240, None, None, None, None]
    assert column(dates, "int", lambda c: fn.term_of_ymd(c, (2009, 2017))) == expected
    assert column([date(2012, 5, 1)], "date", fn.term_of_date) == [201230]


def test_gap_and_limit(column):
    gaps = [80, 100, 120, 121, None]
    assert column(gaps, "int", lambda c: fn.within(c, 100)) == [1, 1, 0, 0, None]
    assert column(gaps, "int", lambda c: fn.within(c, 120)) == [1, 1, 1, 0, None]
    assert column([201340], "int", lambda c: fn.gap(c, F.lit(201220))) == [120]


def test_grades(column):
    grades = ["A", "B+", "D-", "E", "W", "I", "P", None]
    assert column(grades, "string", fn.grade_points) == [4.0, 3.3, 0.7, 0.0, 0.0, 0.0, None, None]
    filled = column(grades, "string", lambda c: fn.grade_points(c, other=0))
    assert filled == [4.0, 3.3, 0.7, 0.0, 0.0, 0.0, 0.0, None]


def test_completed_years(column):
    births = [date(2000, 2, 29), date(2000, 2, 28), date(2000, 3, 1), None]
    ages = column(births, "date", lambda c: fn.age_years(c, F.lit("2018-02-28").cast("date")))
    assert ages == [17, 18, 17, None]
    day_after = column(births[:1], "date", lambda c: fn.age_years(c, F.lit("2018-03-01").cast("date")))
    assert day_after == [18]


def test_dates(column):
    assert column(["05-JUN-2012", "5 June"], "string", fn.parse_date) == [date(2012, 6, 5), None]
    inside = column([1, 2, 3, None], "int", lambda c: fn.between_open(c, 1, 3))
    assert inside == [False, True, False, None]


def test_text(column):
    assert column(["84095-1234", "8409x", None], "string", fn.zip5) == [84095.0, None, None]
    names = ["Alta High School", "High School high school", "Alta", None]
    stripped = column(names, "string", lambda c: fn.strip_suffix(c, "High School"))
    assert stripped == ["Alta ", " high school", "Alta", None]
    assert column([1, None], "int", lambda c: fn.label(c, F.lit("a"), sep="")) == ["1a", "NAa"]
    assert column([0.005, 0.257], "double", fn.percent_label) == ["0%", "26%"]
    assert column([15, 16, 40, None], "int", lambda c: fn.cap(c, 16)) == [15, 16, 16, None]


@pytest.mark.parametrize("df", [0.3, 1.0, 2.0, 5.0, 30.7, 1000.0, 1e5])
def test_student(column, df):
    values = [0.0, 0.01, 0.5, 1.7, 1.75, -2.5, 12.7, -40.0]
    tails = column(values, "double", lambda t: student.two_sided_tail(F.col(t), F.lit(df) + F.col(t) * 0))
    assert tails == pytest.approx([t_two_sided(t, df) for t in values], rel=1e-8)
    for tail in (0.05, 1e-6):
        found = column([df], "double", lambda d: student.quantile(tail, F.col(d)))
        assert found == pytest.approx([t_quantile(tail, df)], rel=1e-8)


def test_student_of_missing_and_many(column):
    assert column([None, 2.0], "double", lambda t: student.two_sided_tail(F.col(t), F.lit(0.0) + F.col(t) * 0)) == [None, None]
    assert column([None, 0.0], "double", lambda d: student.quantile(0.05, F.col(d))) == [None, None]
    # Close to the normal distribution.
    assert column([1e7], "double", lambda d: student.quantile(0.05, F.col(d))) == pytest.approx([1.959964], abs=1e-5)
    assert column([1.0, 1.5, 10.0, 171.2], "double", lambda x: student.log_gamma(F.col(x))) == pytest.approx(
        [math.lgamma(x) for x in (1.0, 1.5, 10.0, 171.2)], abs=1e-12, rel=1e-13
    )
