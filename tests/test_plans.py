from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortloom.plans import cohorts, demographics, destinations, enrolment, linkage, schools


@pytest.fixture
def linked(spark):
    """Spells of seven invented students whose last enrolment term is 201240, two of them minors."""
    return spark.createDataFrame(
        [
            (1, 201320, "B", 20), (1, 201320, "A", 20), (1, 201240, "C", 20),  # two in one term
            (2, 201240, "A", 19),  # spell in the last enrolment term itself
            (3, 201220, "A", 18),  # only earlier spells
            (4, None, "", 18), (4, 201340, "B", 18),  # none and a later spell
            (5, None, None, 30), (5, None, " ", 30),  # none, twice
            (6, 201320, "A", 17), (7, None, "", 16),  # minors
        ],
        "sid long, term int, college string, age_current int",
    ).withColumn("max_ce_term", F.lit(201240))


def test_first_college_ties_by_name(linked, rows):
    assert rows(linkage.first_college(linked, ["term", "college"])) == [
        (1, 201320, "A"), (4, 201340, "B"), (6, 201320, "A"),
    ]


def test_first_or_none(linked, rows):
    people = linkage.adult_spells(linked)
    both = linkage.first_college_or_none(people, ["term", "college", "max_ce_term"])
    assert rows(both, "sid", "college") == [
        (1, "A"), (4, "B"), (4, "NO COLLEGE"), (5, "NO COLLEGE"), (5, "NO COLLEGE"),
    ]
    one_each = linkage.first_destination(people)
    assert rows(one_each, "sid", "college") == [(1, "A"), (4, "B"), (5, "NO COLLEGE")]
    assert rows(cohorts.cohort_gap(people)) == rows(cohorts.cohort_gap(both))


def test_a_spell_may_be_later_and_without_college(spark, rows):
    people = spark.createDataFrame(
        [(1, 3, 2, "NO COLLEGE"), (1, 4, 2, "A"), (2, None, 2, "NO COLLEGE"), (2, None, 2, "NO COLLEGE"), (3, 1, 2, "A")],
        "sid long, term int, max_ce_term int, college string",
    )
    both = linkage.first_college_or_none(people, ["term", "college", "max_ce_term"])
    assert rows(both, "sid", "term", "college") == [
        (1, 3, "NO COLLEGE"), (1, 3, "NO COLLEGE"), (2, None, "NO COLLEGE"), (2, None, "NO COLLEGE"),
    ]


def test_a_missing_id_makes_the_students_id_missing(spark, rows):
    ce = spark.createDataFrame([(1, "B1"), (1, None), (2, "B2")], "sid long, inst_id string")
    assert rows(linkage.id_by_student(ce)) == [(1, None), (2, "B2")]


def test_boundary(linked, rows):
    at_boundary = destinations.boundary_check(linked.filter("sid = 2"))
    assert rows(at_boundary) == [(True, 1)]


@pytest.mark.parametrize("limits, flags", [((100, 500), [1, 1, 0, 0, 0]), ((120, 520), [1, 1, 1, 0, 0])])
def test_gap_limits(spark, rows, limits, flags):
    people = spark.createDataFrame(
        [
            (1, 201320, 201240, "A"), (2, 201320, 201220, "A"), (3, 201340, 201220, "A"),
            (4, 201341, 201220, "A"), (5, None, 201220, "NO COLLEGE"),
        ],
        "sid long, term int, max_ce_term int, college string",
    )
    out = cohorts.cohort_gap(people, *limits)
    assert [r[1] for r in rows(out, "sid", "enroll_1_yr")] == flags
    assert rows(out, "enroll_gap") == [(80,), (100,), (120,), (121,), (None,)]


def test_spell_kind(spark, rows):
    spells = spark.createDataFrame([("",), (None,), ("A",)], "college string")
    assert rows(linkage.spell_kind(spells)) == [
        ("", "concurrent", "NO COLLEGE"), ("A", "college", "A"), (None, None, "NO COLLEGE"),
    ]


def test_subset_outcome_flags_duplicates_before_age(spark, rows):
    """A student whose first row is under age does not come back through a later row."""
    courses = spark.createDataFrame(
        [
            (1, 1, "MATH", "N", date(2001, 1, 1)), (1, 2, "MATH", "Y", date(1990, 1, 1)),
            (2, 3, "MATH", "Y", date(1990, 1, 1)), (3, 4, "ART", "Y", date(1990, 1, 1)),
        ],
        "sid long, id int, subject string, enrolled_after string, birth_date date",
    )
    as_of = F.lit("2018-01-01").cast("date")
    assert rows(enrolment.subset_outcome(courses, "MATH", as_of, ["id"])) == [("Y", 1)]


def test_rollup_missing_values(spark, rows):
    ce = spark.createDataFrame(
        [(1, 201220, 4.0, "N"), (1, 201240, None, "Y"), (2, 201220, 3.0, "U")],
        "sid long, term int, grade_num double, enrolled_after string",
    )
    out = enrolment.student_rollup(ce, "num_ce", "max_ce_term", "ce_gpa", "enrolled_after")
    assert rows(out) == [(1, 2, 201240, None, "Y"), (2, 1, 201220, 3.0, "U")]


def test_capped_load(spark, rows):
    students = spark.createDataFrame(
        [(15, "Y"), (16, "Y"), (40, "Y")], "num_ce int, enrolled_after string"
    )
    assert rows(enrolment.outcome_by_load_capped(students)) == [
        (15, "Y", 1, 15, 1.0), (16, "Y", 2, 16, 1.0),
    ]


def test_denominators_before_and_after(spark, rows):
    ce = spark.createDataFrame(
        [(1, 201540, "White", "S1"), (2, 201540, "Unknown", None), (3, 201540, "White", "S1"),
         (4, 201540, "Asian", "S2")],
        "sid long, term int, ethnicity string, high_school string",
    )
    kept = demographics.race_share(ce, 201520)
    assert rows(kept, "race", "percent") == [("Asian", 0.25), ("White", 0.5)]
    districts = spark.createDataFrame([("S1", "D")], "high_school string, district string")
    dropped = schools.school_share_top(ce, districts, 5, after=201520)
    assert rows(dropped, "high_school", "pc", "district") == [("S1", 66.7, "D"), ("S2", 33.3, None)]
    whole = schools.school_share_top(ce, districts, 5, after=201520, keep_missing=True)
    assert rows(whole, "high_school", "pc") == [("S1", 50.0), ("S2", 25.0), (None, 25.0)]


def test_zip_share_keeps_unknown_in_denominator(spark, rows):
    ce = spark.createDataFrame(
        [(1, 1, 201540, 84001.0, "N", "a"), (2, 2, 201540, None, None, None),
         (1, 3, 201540, 84002.0, "S", "b"), (3, 4, 201540, 84002.0, "S", "b")],
        "sid long, id int, term int, zip5 double, region string, city string",
    )
    out = demographics.zip_region_top(ce, ["id"], after=201520, with_share=True)
    # Student 1 counts at the highest zip, with the place of the first row.
    assert rows(out, "zip", "n", "region", "pczip") == [(84002.0, 2, "N", 2 / 3)]


def test_course_mix_fans_out(spark, rows):
    first = spark.createDataFrame(
        [(1, "A"), (1, "A"), (2, "A"), (3, "A"), (4, "B")], "sid long, college string"
    )
    courses = spark.createDataFrame(
        [(1, "M", 4.0), (1, "M", 2.0), (2, "M", 3.0), (2, "E", None), (4, "M", 1.0)],
        "sid long, class string, grade_num double",
    )
    out = destinations.course_mix(first, courses, ["A"])
    assert rows(out) == [("A", "E", 1, None, 14.3), ("A", "M", 5, 3.0, 71.4), ("A", None, 1, None, 14.3)]


def test_college_ever_counts_students_once(spark, rows):
    later = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, "A")], "sid long, college string")
    assert rows(destinations.college_ever_top(later)) == [("A", 2, 100.0), ("B", 1, 50.0)]
    assert rows(destinations.college_ever_top(later, 1, denominator=8)) == [("A", 2, 25.0)]


def test_profile_percent_missing_attribute(spark, rows):
    people = spark.createDataFrame(
        [("A", 18, 201240, "Female", 2, 4.0), ("A", 25, 201240, None, 3, None)],
        "college string, age_current int, max_ce_term int, gender string, num_ce int, ce_gpa double",
    )
    profile = destinations.college_profile(people, (18,), (201240,), {"pc_female": "Female"})
    assert rows(profile) == [("A", 2, 50.0, 50.0, 100.0, None, 21.5, 2.5, 4.0)]


def test_prior_target(spark, rows):
    linked = spark.createDataFrame(
        [(1, 201220, "T", "N"), (1, 201240, "T", "N"), (1, 201320, "T", "N"), (2, 201220, "T", "Y"),
         (3, 201220, "X", "N")],
        "sid long, term int, college string, graduated string",
    ).withColumn("max_ce_term", F.lit(201240))
    assert rows(linkage.prior_target(linked, "T"), "sid", "term") == [(1, 201220)]
    assert linkage.linked_without_prior(linked, "T").count() == 4
