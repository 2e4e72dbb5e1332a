"""Schools, campuses and districts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import count_null, strip_suffix
from ..operators import attach_crosswalk, counts, exclude, headcount, share, top_k, with_group_max


def _terms(ce: DataFrame, after: int | None, without: Sequence[int], terms: Sequence[int] | None):
    if terms is not None:
        return ce.filter(F.col("term").isin(*terms))
    kept = ce if after is None else ce.filter(F.col("term") > after)
    return exclude(kept, "term", without) if without else kept


def school_student_counts(ce: DataFrame, after: int, school: str = "high_school") -> DataFrame:
    """Enrolments per term, school and student."""
    return counts(ce.filter(F.col("term") > after), "term", school, "sid")


def school_headcount_top(
    ce: DataFrame, after: int, without: Sequence[int], k: int = 10, school: str = "high_school"
) -> DataFrame:
    """Largest schools of each term by students; a missing school counts as one."""
    table = headcount(_terms(ce, after, without, None), "sid", "term", school)
    return top_k(table, k, ["-n", school], within=["term"])


def school_share_top(
    ce: DataFrame,
    districts: DataFrame,
    k: int,
    school: str = "high_school",
    after: int | None = None,
    without: Sequence[int] = (),
    terms: Sequence[int] | None = None,
    keep_missing: bool = False,
    digits: int = 1,
) -> DataFrame:
    """Largest schools of each term with percent of the term's students, and their district.

    Rows without a school leave the denominator unless ``keep_missing``. The district depends on the
    school alone, so it is attached to the few rows kept.
    """
    kept = _terms(ce, after, without, terms)
    if not keep_missing:
        kept = kept.filter(F.col(school).isNotNull())
    table = headcount(kept, "sid", "term", school)
    table = share(table, within=["term"], name="pc", scale=100, digits=digits)
    return attach_crosswalk(top_k(table, k, ["-n", school], within=["term"]), districts, school)


def school_names(
    ce: DataFrame, junk: Sequence[str], suffix: str, school: str = "high_school"
) -> DataFrame:
    """Distinct school names without junk values and suffix."""
    names = exclude(ce.select(school).distinct(), school, junk)
    return names.select(strip_suffix(school, suffix).alias("school"))


def district_share(
    ce: DataFrame, after: int, without: Sequence[int], district: str = "district"
) -> DataFrame:
    """Percent of each term's students by district; unknown districts leave the denominator."""
    kept = _terms(ce, after, without, None).filter(F.col(district).isNotNull())
    table = headcount(kept, "sid", "term", district)
    return share(table, within=["term"], name="pc", scale=100, digits=1)


def district_overall(ce: DataFrame, district: str = "district") -> DataFrame:
    """Percent of all enrolments by district."""
    return share(counts(ce, district), name="pc", scale=100, digits=1)


def campus_overall_top(
    ce: DataFrame, districts: DataFrame, k: int = 20, campus: str = "campus"
) -> DataFrame:
    """Largest campuses by enrolments with percent of all, and their district."""
    table = share(counts(ce, campus), name="pc", scale=100, digits=1)
    return attach_crosswalk(top_k(table, k, ["-n", campus]), districts, campus)


def missing_school_audit(ce: DataFrame, after: int, credits: int = 3) -> DataFrame:
    """Per term: enrolments and credits, and how many lack a school."""
    table = counts(ce.filter(F.col("term") > after), "term", hs_na=count_null("high_school"))
    return table.withColumns({"sch": F.col("n") * credits, "hs_na_sch": F.col("hs_na") * credits})


def campus_list(ce: DataFrame, campus: str = "campus") -> DataFrame:
    """Enrolments per campus, by name."""
    return counts(ce, campus).orderBy(F.col(campus).asc_nulls_last())


def group_max_attach(ce: DataFrame) -> DataFrame:
    """Every enrolment with the student's last term."""
    return with_group_max(ce, ["sid"], "term", "max_ce_term")
