"""Cohorts of students by their last enrolment term: who went on, how soon and where."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gap, term_season, within
from ..operators import (
    attach_crosswalk,
    counts,
    exclude,
    first_row,
    left_join,
    share,
    top_k,
)
from .linkage import first_destination


def cohort_gap(people: DataFrame, one_year: int = 100, five_years: int = 500) -> DataFrame:
    """Each student's first later spell, or none: term gap and whether it is within the limits.

    ``people`` are the ``adult_spells`` (``first_college_or_none`` gives the same result). A student
    with both a spell and a no-college row keeps the spell. A missing gap counts as "not within".
    """
    first = first_destination(people).withColumn("enroll_gap", gap("term", "max_ce_term"))
    return first.withColumns(
        {
            "enroll_1_yr": F.coalesce(within("enroll_gap", one_year), F.lit(0)),
            "enroll_5_yr": F.coalesce(within("enroll_gap", five_years), F.lit(0)),
        }
    )


def _full_cohorts(cohorts: DataFrame, without: Sequence[int], before: int) -> DataFrame:
    return exclude(cohorts, "max_ce_term", without).filter(F.col("max_ce_term") < before)


def cohort_yield_overall(cohorts: DataFrame, without: Sequence[int], before: int) -> DataFrame:
    """Students, how many enrolled within each limit, and the rate, over the complete cohorts."""
    sums = _full_cohorts(cohorts, without, before).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("enroll_1_yr").alias("sum_1_yr"),
        F.sum("enroll_5_yr").alias("sum_5_yr"),
    )
    return sums.withColumn("pc_enroll", F.try_divide("sum_1_yr", "n"))


def _yields(cohorts: DataFrame) -> DataFrame:
    sums = counts(
        cohorts, "max_ce_term",
        enroll_1_yr=F.sum("enroll_1_yr"), enroll_5_yr=F.sum("enroll_5_yr"),
    )
    return sums.withColumns(
        {"pc_1_year": F.col("enroll_1_yr") / F.col("n"), "pc_5_yr": F.col("enroll_5_yr") / F.col("n")}
    )


def cohort_yield(cohorts: DataFrame, without: Sequence[int], before: int) -> DataFrame:
    """The same per cohort, with its season."""
    table = _yields(_full_cohorts(cohorts, without, before))
    return table.withColumn("semester", term_season("max_ce_term"))


def cohort_yield_of(cohorts: DataFrame, terms: Sequence[int]) -> DataFrame:
    """Yields of chosen cohorts."""
    return _yields(cohorts.filter(F.col("max_ce_term").isin(*terms)))


def cohort_yield_mean(cohorts: DataFrame, terms: Sequence[int]) -> DataFrame:
    """Unweighted mean of the one-year yields of chosen cohorts."""
    return cohort_yield_of(cohorts, terms).agg(F.avg("pc_1_year").alias("avg"))


def cohort_campus_attach(
    cohorts: DataFrame, ce: DataFrame, order_by: Sequence[str], districts: DataFrame
) -> DataFrame:
    """Cohorts with each student's first campus and its district."""
    campus = first_row(ce, ["sid"], order_by, ["campus"])
    joined = left_join(cohorts, campus, ["sid"], null_safe=False)
    return attach_crosswalk(joined, districts, "campus")


def _counted_share(df: DataFrame, by: str) -> DataFrame:
    return share(counts(df, by), name="pc", scale=100, digits=1)


def nonenrolled_by(cohorts: DataFrame, by: str, without: Sequence[int] = ()) -> DataFrame:
    """Students not enrolled within a year by campus or district, with percent of all of them."""
    kept = exclude(cohorts, "max_ce_term", without) if without else cohorts
    return _counted_share(kept.filter(F.col("enroll_1_yr") == 0), by)


def enrolled_by(cohorts: DataFrame, by: str, college: str) -> DataFrame:
    """Students enrolled at one college within a year by campus or district."""
    kept = cohorts.filter((F.col("enroll_1_yr") == 1) & (F.col("college") == college))
    return _counted_share(kept, by)


def destination_top_by_cohort(
    cohorts: DataFrame,
    k: int = 5,
    terms: Sequence[int] | None = None,
    after: int | None = None,
    without: Sequence[int] = (),
    by_share: bool = False,
) -> DataFrame:
    """Top destinations of each cohort within a year, by count or by share of the cohort."""
    kept = cohorts.filter(F.col("enroll_1_yr") == 1)
    if terms is not None:
        kept = kept.filter(F.col("max_ce_term").isin(*terms))
    if after is not None:
        kept = kept.filter(F.col("max_ce_term") > after)
    if without:
        kept = exclude(kept, "max_ce_term", without)
    table = counts(kept, "max_ce_term", "college")
    if by_share:
        table = share(table, within=["max_ce_term"], name="pc")
    return top_k(table, k, ["-pc" if by_share else "-n", "college"], within=["max_ce_term"])


def destination_share_top(cohorts: DataFrame, k: int = 10) -> DataFrame:
    """Top destinations within a year over all cohorts."""
    table = counts(cohorts.filter(F.col("enroll_1_yr") == 1), "college")
    return top_k(share(table, name="pc"), k, ["-pc", "college"])
