"""Gender, ethnicity, region and indicator breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import first_by, flag01, na_max, na_sum
from ..operators import counts, exclude, per_entity_then, share, top_k
from .enrolment import with_calendar


def _after(ce: DataFrame, after: int | None) -> DataFrame:
    return ce if after is None else ce.filter(F.col("term") > after)


def gender_share(
    ce: DataFrame, after: int, by: str = "term", male: str = "Male", female: str = "Female"
) -> DataFrame:
    """Students per term (or course_year) and how many are male and female."""
    table = per_entity_then(
        with_calendar(_after(ce, after)),
        [by, "sid"], {"gender": na_max("gender")},
        [by], {
            "n": F.count(F.lit(1)),
            "male": na_sum(flag01("gender", male)),
            "female": na_sum(flag01("gender", female)),
        },
    )
    return table.withColumn("pcfemale", F.col("female") / F.col("n"))


def load_by_group(
    ce: DataFrame, attribute: str = "gender", without: Sequence[str] = ("Unknown",)
) -> DataFrame:
    """Mean and spread of the number of courses per student, by a student attribute."""
    students = ce.groupBy("sid").agg(
        F.count(F.lit(1)).alias("n"), na_max(attribute).alias(attribute)
    )
    return counts(
        exclude(students, attribute, without), attribute, name="students",
        avg_courses=F.avg("n"), sd=F.stddev_samp("n"),
    )


def race_by_term(ce: DataFrame, after: int, attribute: str = "ethnicity") -> DataFrame:
    """Students per term and ethnicity."""
    return per_entity_then(
        _after(ce, after),
        ["term", "sid"], {"race": na_max(attribute)},
        ["term", "race"], {"n": F.count(F.lit(1))},
    )


def race_share(
    ce: DataFrame, after: int, without: Sequence[str] = ("Unknown",), attribute: str = "ethnicity"
) -> DataFrame:
    """Share of students by ethnicity; the left-out values stay in the denominator."""
    students = _after(ce, after).groupBy("sid").agg(na_max(attribute).alias("race"))
    return exclude(share(counts(students, "race"), name="percent"), "race", without)


def race_by_district(
    ce: DataFrame,
    within: str,
    across: str,
    only: str | None = None,
    without: Sequence[str] = (),
    hidden: Sequence[str] = (),
) -> DataFrame:
    """Enrolments by two attributes with the share inside ``within``.

    ``only`` and ``without`` filter ``within`` values before the share; ``hidden`` drops ``across``
    values after it, leaving them in the denominator.
    """
    kept = ce if only is None else ce.filter(F.col(within) == only)
    if without:
        kept = exclude(kept, within, without)
    table = share(counts(kept, within, across), within=[within], name="pc")
    return exclude(table, across, hidden) if hidden else table


def zip_region_top(
    ce: DataFrame,
    order_by: Sequence[str],
    k: int = 15,
    after: int | None = None,
    terms: Sequence[int] | None = None,
    with_share: bool = False,
    by_term: bool = False,
) -> DataFrame:
    """Most frequent zips with region and city, optionally with share, overall or per term.

    A student counts once (per term) at their highest zip, with the region and city of their first
    row. Students without a zip stay in the denominator and leave before the cut.
    """
    kept = _after(ce, after) if terms is None else ce.filter(F.col("term").isin(*terms))
    leading = ["term"] if by_term else []
    students = kept.groupBy(*leading, "sid").agg(
        na_max("zip5").alias("zip"),
        first_by("region", *order_by).alias("region"),
        first_by("city", *order_by).alias("city"),
    )
    table = counts(
        students, *leading, "zip",
        region=first_by("region", "sid"), city=first_by("city", "sid"),
    )
    if with_share:
        table = share(table, within=leading, name="pczip")
    return top_k(table.filter(F.col("zip").isNotNull()), k, ["-n", "zip"], within=leading)


def zip_counts_top(ce: DataFrame, after: int, k: int = 10) -> DataFrame:
    """Most frequent zips, a student counted once at their highest zip."""
    students = _after(ce, after).groupBy("sid").agg(na_max("zip5").alias("zip"))
    table = counts(students, "zip").filter(F.col("zip").isNotNull())
    return top_k(table, k, ["-n", "zip"])


def indicator_counts(ce: DataFrame, indicator: str) -> DataFrame:
    """Rows by an indicator such as pell_eligible or first_generation."""
    return counts(ce, indicator)
