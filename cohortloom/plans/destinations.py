"""Where students went: first and later colleges, profiles, course mix, home zips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import na_mean, pct_where, yes_no
from ..operators import (
    box_outliers,
    box_stats,
    counts,
    drop_incomplete,
    left_join,
    share,
    t_test,
    top_k,
    with_sort_rank,
)
from ..session import cut_lineage
from .linkage import NO_COLLEGE


def first_college_top(
    first: DataFrame, k: int = 10, digits: int | None = None, without: str | None = None
) -> DataFrame:
    """Top destinations with percent of all students in ``first`` (after leaving one out, if named).

    With ``digits`` the cut goes by the rounded percent, so that shown ties break by name.
    """
    kept = first if without is None else first.filter(F.col("college") != without)
    table = share(counts(kept, "college"), name="percent", scale=100, digits=digits)
    return top_k(table, k, ["-n" if digits is None else "-percent", "college"])


def college_ever_top(later: DataFrame, k: int = 10, denominator: int | None = None) -> DataFrame:
    """Students ever at each college, as percent of all students with a later spell.

    ``denominator`` overrides that number.
    """
    # One pass counts the students of each college and of all; the row of all has the most.
    sets = later.rollup("college").agg(
        F.grouping_id().alias("_all"), F.count_distinct("sid").alias("n")
    )
    top = top_k(sets, k + 1, ["-_all", "-n", "college"])
    if denominator is None:
        few = Window.partitionBy(F.lit(0))  # k + 1 rows
        total = F.max(F.when(F.col("_all") == 1, F.col("n"))).over(few)
    else:
        total = F.lit(denominator)
    found = top.withColumn("percent", F.col("n") / total * 100)
    return found.filter(F.col("_all") == 0).drop("_all")


def first_or_none_top(bindall: DataFrame, k: int = 10) -> DataFrame:
    return top_k(counts(bindall, "college"), k, ["-n", "college"])


def attend_share(first: DataFrame, college: str) -> DataFrame:
    """First destination is the target college or not."""
    table = counts(first.withColumn("attend", yes_no(F.col("college") == college)), "attend")
    return share(table, name="pc_attend", scale=100, digits=1)


def boundary_check(first: DataFrame) -> DataFrame:
    """How often the first later term equals the last enrolment term."""
    return counts(first.withColumn("same_term", F.col("max_ce_term") == F.col("term")), "same_term")


def college_profile(
    bindall: DataFrame,
    ages: Sequence[int] = (18, 19, 20),
    terms: Sequence[int] = (),
    genders: dict[str, str] | None = None,
    ethnicities: dict[str, str] | None = None,
) -> DataFrame:
    """Per destination: students, percent by age, by last enrolment term, by gender and ethnicity,
    mean number of courses and mean gpa.

    ``genders`` and ``ethnicities`` map an output column to the value it counts. A percent is
    missing where the attribute is missing for any student.
    """
    age, last = F.col("age_current"), F.col("max_ce_term")
    metrics: dict[str, Column] = {f"pc_age_{a}": pct_where(age == a) for a in ages}
    if ages:
        metrics[f"pc_age_gt_{max(ages)}"] = pct_where(age > max(ages))
    metrics |= {f"pc_term_{t}": pct_where(last == t) for t in terms}
    for column, wanted in (("gender", genders), ("ethnicity", ethnicities)):
        metrics |= {name: pct_where(F.col(column) == v) for name, v in (wanted or {}).items()}
    metrics |= {
        "mean_age": F.bround(na_mean("age_current"), 2),
        "num_ce": F.bround(na_mean("num_ce", na_rm=True), 2),
        "ce_gpa": F.bround(na_mean("ce_gpa", na_rm=True), 2),
    }
    return counts(bindall, "college", **metrics)


def profile_metric_rank(
    profile: DataFrame,
    metric: str,
    colleges: Sequence[str] | None = None,
    by: str | None = None,
    k: int | None = None,
) -> DataFrame:
    """One metric for chosen colleges (or the k largest), ranked by the metric or another column."""
    chosen = profile if colleges is None else profile.filter(F.col("college").isin(*colleges))
    if k is not None:
        chosen = top_k(chosen, k, ["-n", "college"])
    ranked = with_sort_rank(chosen, ["-" + (by or metric), "college"])
    return ranked.select(*dict.fromkeys(["college", "n", metric, by or metric, "sort_rank"]))


def box_by_college(
    bindall: DataFrame, value: str, colleges: Sequence[str], **options
) -> DataFrame:
    """Box-plot summary of a measure by destination.

    The two columns are checkpointed: a quantile reads its input several times.
    """
    kept = bindall.filter(F.col("college").isin(*colleges)).select("college", value)
    return box_stats(cut_lineage(kept), ["college"], value, **options)


def box_outliers_by_college(
    bindall: DataFrame, value: str, colleges: Sequence[str], **options
) -> DataFrame:
    kept = bindall.filter(F.col("college").isin(*colleges)).select("sid", "college", value)
    return box_outliers(cut_lineage(kept), ["college"], value, **options)


def destination_test(
    bindall: DataFrame, value: str, target: str, none: str = NO_COLLEGE, equal_var: bool = False
) -> DataFrame:
    """Two-sample test of a measure, students without college against the target college."""
    return t_test(bindall, value, "college", none, target, equal_var)


def zip_top(
    students: DataFrame, k: int = 10, value: str = "zip5", college: str | None = None
) -> DataFrame:
    """Most frequent known zips, each student counted once."""
    kept = students if college is None else students.filter(F.col("college") == college)
    table = counts(kept.select("sid", value).distinct(), value)
    return top_k(drop_incomplete(table), k, ["-n", value])


def zip_top_by_college(students: DataFrame, colleges: Sequence[str], k: int = 5) -> DataFrame:
    """Most frequent known zips within chosen destinations.

    ``students`` is one row per student (``linkage.first_destination``) with zip5.
    """
    table = counts(students.filter(F.col("college").isin(*colleges)), "college", "zip5")
    return top_k(drop_incomplete(table), k, ["-n", "zip5"], within=["college"])


def course_mix(
    first: DataFrame,
    courses: DataFrame,
    colleges: Sequence[str],
    k: int = 10,
    grade: str = "grade_num",
) -> DataFrame:
    """Top classes per destination: enrolments, mean grade, percent of the destination's enrolments.

    Enrolments are summed per student and class before the students' destinations are joined.
    """
    chosen = first.filter(F.col("college").isin(*colleges)).select("sid", "college")
    taken = counts(
        courses.select("sid", "class", grade), "sid", "class", name="_n",
        _known=F.count(grade), _points=F.sum(grade),
    )
    # A student with no enrolment still counts as one row of a missing class.
    joined = left_join(chosen, taken, ["sid"], null_safe=False).withColumns(
        {"_n": F.coalesce("_n", F.lit(1)), "_known": F.coalesce("_known", F.lit(0))}
    )
    mean = F.try_divide(F.sum("_points"), F.sum("_known"))
    table = joined.groupBy("college", "class").agg(
        F.sum("_n").alias("n"),
        F.when(F.sum("_known") == F.sum("_n"), mean).alias("avg_grade"),
    )
    table = share(table, within=["college"], name="pc_course", scale=100, digits=1)
    return top_k(table, k, ["-pc_course", "class"], within=["college"])


