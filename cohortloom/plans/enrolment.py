"""What students enrolled in: counts, loads, courses, ages and later enrolment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    age_years,
    cap,
    count_null,
    ever_flag,
    flag01,
    na_max,
    na_mean,
    na_min,
    na_sum,
    term_end,
    term_season,
    term_year,
    yes_no,
)
from ..operators import (
    counts,
    first_row,
    freq,
    headcount,
    loess,
    per_entity_then,
    share,
    slice_range,
    top_k,
)


def null_audit(
    ce: DataFrame,
    column: str = "hs_grad_year",
    ever: str = "ever_nonconcurrent",
    after: str = "enrolled_after",
) -> DataFrame:
    """Missing values of a column, over all rows and among "ever but not after" rows: one pass."""
    odd = (F.col(ever) == "Y") & (F.col(after) == "N")
    return ce.agg(
        count_null(column).alias("null_all"),
        F.count_if(odd & F.col(column).isNull()).alias("null_odd"),
        F.count_if(odd).alias("n_odd"),
    )


def grad_year_funnel(
    ce: DataFrame, after: int, before: int, order_by: Sequence[str], year: str = "hs_grad_year"
) -> DataFrame:
    """Students per graduation year, and how many ever enrolled, enrolled after, and within a year."""
    flags = ["ever_nonconcurrent", "enrolled_after", "within_one_year"]
    in_range = ce.filter((F.col(year) > after) & (F.col(year) < before))
    students = first_row(in_range, ["sid", year], order_by, columns=flags)
    ever, later, within1 = [na_sum(flag01(f)) for f in flags]
    return counts(students, year, ever=ever, enrollafter=later, within1=within1)


def roster_distinct(ce: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct identity rows, for export with ``sources.write_delimited``."""
    return ce.select(*columns).distinct()


def term_bounds(ce: DataFrame) -> DataFrame:
    return ce.agg(F.min("term").alias("min_term"), F.max("term").alias("max_term"))


def student_rollup(
    ce: DataFrame, *columns: str, levels: dict[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """One row per student. Name the output columns needed, or get all of them.

    A column with a missing value on any row of a student is missing for the student. ``levels`` may
    declare the values of gender and ethnicity, lowest first: their maximum is then taken over
    integers in a hash aggregate, while a maximum over text sorts the input. Another value counts as
    missing.
    """
    levels = levels or {}
    text = {c: ever_flag(c, levels[c]) if c in levels else na_max(c) for c in ("gender", "ethnicity")}
    available: dict[str, Column] = {
        "num_ce": F.count(F.lit(1)),
        "max_ce_term": na_max("term"),
        "ce_gpa": na_mean("grade_num"),
        "enrolled_after": ever_flag("enrolled_after"),
        **text,
        "birth_date": na_max("birth_date"),
    }
    wanted = columns or tuple(available)
    return ce.groupBy("sid").agg(*[available[c].alias(c) for c in wanted])


def age_at_event(rollup: DataFrame, as_of: Column) -> DataFrame:
    """Completed age at the end of the last term and on a given day."""
    return rollup.withColumns(
        {
            "age_last_term": age_years("birth_date", term_end("max_ce_term")),
            "age_current": age_years("birth_date", as_of),
        }
    )


def adults(students: DataFrame, age: str = "age_current", at_least: int = 18) -> DataFrame:
    return students.filter(F.col(age) >= at_least)


def age_frequency(students: DataFrame, age: str = "age_current") -> DataFrame:
    return freq(students, age)


def with_outcome(students: DataFrame, flag: str = "enrolled_after") -> DataFrame:
    """Outcome Y for students ever flagged Y, N for any other known flag."""
    return students.withColumn("outcome", yes_no(F.col(flag) == "Y"))


def outcome_counts(students: DataFrame, *facet: str) -> DataFrame:
    """Rows per outcome, optionally per facet: the bars of a bar chart."""
    return counts(with_outcome(students), *facet, "outcome")


def outcome_share(students: DataFrame) -> DataFrame:
    return share(outcome_counts(students), name="freq")


def with_calendar(df: DataFrame, term: str = "term") -> DataFrame:
    return df.withColumns({"course_year": term_year(term), "course_sem": term_season(term)})


def term_volume(ce: DataFrame, after: int) -> DataFrame:
    """Enrolments per term, with year and season."""
    return with_calendar(counts(ce.filter(F.col("term") > after), "term"))


def term_headcount(ce: DataFrame, after: int) -> DataFrame:
    """Distinct students per term, with year and season."""
    return with_calendar(headcount(ce.filter(F.col("term") > after), "sid", "term"))


def mean_course_load(ce: DataFrame, after: int) -> DataFrame:
    """Mean courses per student and term."""
    loads = per_entity_then(
        ce.filter(F.col("term") > after),
        ["term", "sid"], {"n": F.count(F.lit(1))},
        ["term"], {"mean_courses": F.avg("n")},
    )
    return with_calendar(loads).withColumn("mean_courses_1dp", F.bround("mean_courses", 1))


def course_count_dist(ce: DataFrame) -> DataFrame:
    """Students by number of courses."""
    return counts(ce.groupBy("sid").agg(F.count(F.lit(1)).alias("num_courses")), "num_courses")


def overall_mean_load(ce: DataFrame, after: int | None = None) -> DataFrame:
    kept = ce if after is None else ce.filter(F.col("term") > after)
    return per_entity_then(
        kept, ["sid"], {"n": F.count(F.lit(1))}, [], {"avg_courses": F.avg("n")}
    )


def outcome_by_load(students: DataFrame) -> DataFrame:
    """Outcome by number of courses: count, and share among students with that many courses."""
    table = counts(with_outcome(students), "num_ce", "outcome")
    return share(table, within=["num_ce"], name="freq")


def outcome_by_load_capped(students: DataFrame, cap_at: int = 16) -> DataFrame:
    """The same with long course histories pooled."""
    table = counts(
        with_outcome(students).withColumn("load_capped", cap("num_ce", cap_at)),
        "load_capped", "outcome",
        min_load=F.min("num_ce"),
    )
    return share(table, within=["load_capped"], name="freq")


def outcome_loess(students: DataFrame, cap_at: int = 16, **options) -> DataFrame:
    """Smoothed share of outcome Y by number of courses, with a confidence band."""
    points = outcome_by_load_capped(students, cap_at).filter(F.col("outcome") == "Y")
    return loess(points, "min_load", "freq", **options)


def common_courses(courses: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent classes with their mean grade over known grades."""
    table = counts(courses, "class", average_grade=na_mean("grade_num", na_rm=True))
    return top_k(table, k, ["-n", "class"])


def common_subjects(courses: DataFrame, k: int = 10) -> DataFrame:
    return top_k(counts(courses, "subject"), k, ["-n", "subject"])


def retakes(courses: DataFrame) -> DataFrame:
    """Classes a student took more than once: how often, grades, first and last term."""
    g = F.col("grade_num")
    return counts(
        courses, "sid", "class",
        mean_grade=F.avg(g), min_grade=F.min(g), max_grade=F.max(g),
        first_term=na_min("term"), last_term=na_max("term"),
    ).filter(F.col("n") > 1)


def subset_outcome(
    courses: DataFrame,
    subject: str,
    as_of: Column,
    order_by: Sequence[str],
    facet: str | None = None,
    at_least: int = 18,
) -> DataFrame:
    """Outcome of the students of one subject, each counted on their first row.

    Later rows of a student are duplicates whatever the age on the first row, so the age filter
    comes after.
    """
    columns = ["enrolled_after", "birth_date", *([facet] if facet else [])]
    students = first_row(
        courses.filter(F.col("subject") == subject), ["sid"], order_by, columns
    ).withColumn("age", age_years("birth_date", as_of))
    return outcome_counts(adults(students, "age", at_least), *([facet] if facet else []))


def age_share_slice(ce: DataFrame, lo: int, hi: int, age: str = "age_first_day") -> DataFrame:
    """Percent of enrolments by age, age groups lo..hi in order."""
    table = share(counts(ce, age), name="pc", scale=100, digits=1)
    return slice_range(table, [age], lo, hi)


def person_lookup(df: DataFrame, key: str, value, columns: Sequence[str]) -> DataFrame:
    """All rows of one entity, selected columns."""
    return df.filter(F.col(key) == value).select(*columns)
