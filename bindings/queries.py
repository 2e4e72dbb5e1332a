"""Every registered query: an analysis applied to the driver tables."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from cohortloom import operators as op
from cohortloom.functions import flag01, label, percent_label, strip_suffix
from cohortloom.plans import cohorts, demographics, destinations, enrolment, linkage, schools
from cohortloom.session import shared_folder
from cohortloom.sources import (
    ENROLLMENTS,
    SPELLS,
    audit_delimited,
    export_delimited,
    from_lines,
    prepare_enrollments,
    prepare_spells,
    read_enrollments,
    read_export,
    read_spells,
    save_by_entity,
    to_lines,
    write_lines,
)

from .views import Views

TARGET = "NATION_2"
OTHERS = ["NATION_9", "NATION_14", "NATION_20", "NATION_23"]
CHOSEN = [TARGET, linkage.NO_COLLEGE, *OTHERS]
SUMMERS = [199530, 199630, 199730]
PROFILE_TERMS = [199620, 199640, 199720, 199740]
ORDER = ["enroll_id"]


def _r6(df, *columns):
    """Means of doubles depend on the order of addition: compare six digits."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _profile(v: Views):
    return destinations.college_profile(
        v.bindall("num_ce", "ce_gpa", "gender", "ethnicity", "age_current"),
        ages=(16, 17, 18, 19),
        terms=PROFILE_TERMS,
        genders={"pc_female": "Female", "pc_male": "Male"},
        ethnicities={"pc_building": "BUILDING", "pc_machinery": "MACHINERY"},
    )


def _cohorts(v: Views, one: int = 100, five: int = 500):
    return cohorts.cohort_gap(v.visitors(), one, five)


def _cohort_campus(v: Views):
    return cohorts.cohort_campus_attach(_cohorts(v), v.ce_full("sid", "enroll_id", "campus"), ORDER, v.campus_districts())


def _ce_district(v: Views):
    ce = v.ce_full("sid", "enroll_id", "term", "high_school", "ethnicity")
    return op.attach_crosswalk(ce, v.school_districts(), "high_school")


def _fitted(v: Views, age: str):
    return enrolment.adults(
        enrolment.with_outcome(v.students("num_ce", "enrolled_after")), age
    ).select(flag01("outcome").alias("after"), "num_ce")


def _logit(v: Views, age: str):
    fit = op.logit_summary(_fitted(v, age), "after", ["num_ce"])
    return _r6(
        fit.select(
            "term", "estimate", "std_error", "z", "p_value", "null_deviance", "null_df",
            "residual_deviance", "residual_df", "aic", "iterations",
        ),
        "estimate", "std_error", "z", "p_value", "null_deviance", "residual_deviance", "aic",
    )


def _test(v: Views, value: str, equal_var: bool):
    table = destinations.destination_test(v.bindall("num_ce", "ce_gpa"), value, TARGET, equal_var=equal_var)
    kept = ["mean_a", "mean_b", "std_error", "df", "t", "p_value", "ci_low", "ci_high"]
    return _r6(table.select("n_a", "n_b", *kept), *kept)


def _loess(v: Views, **options):
    students = enrolment.adults(v.students("num_ce", "enrolled_after"))
    return _r6(
        enrolment.outcome_loess(students, 16, **options), "x", "fitted", "std_error", "lower", "upper"
    )


def _box(v: Views, value: str, **options):
    table = destinations.box_by_college(
        v.bindall("num_ce", "ce_gpa"), value, [TARGET, linkage.NO_COLLEGE], **options
    )
    return _r6(table, "q1", "median", "q3", "whisker_low", "whisker_high")


def _round_trip(df, layout, sep: str):
    """Rows written as delimited text and typed again by the readers' rules."""
    kept = tuple(entry for entry in layout if entry[1] in df.columns)
    return from_lines(to_lines(df.select(*[ours for _, ours, _ in kept]), sep), kept, sep)


def _exported(v: Views, name: str, df, sep: str):
    """The rows as read back from their export."""
    path = f"{shared_folder(v.spark)}/exports/{name}"
    export_delimited(df, path, sep)
    return read_export(v.spark, path, sep)


def _layout(table, columns):
    return tuple(entry for entry in table if entry[1] in columns)


ENROLLMENT_COLUMNS = (
    "sid", "term", "hs_grad_year", "enrolled_after", "ever_nonconcurrent", "last_name",
    "birth_date", "inst_id", "gender", "ethnicity", "final_grade", "high_school", "age_first_day",
)
SPELL_COLUMNS = ("sid", "record_found", "college", "begin_ymd", "graduated", "degree_title")


def _enrollment_file(v: Views):
    """A file of all enrolments in which some ages and birth dates do not parse and some lines end early."""
    path = f"{shared_folder(v.spark)}/files/enrollments"
    layout = _layout(ENROLLMENTS, ENROLLMENT_COLUMNS)
    sid = F.col("sid")
    ce = v.ce_full(*ENROLLMENT_COLUMNS).withColumns(
        {
            "age_first_day": F.when(sid % 13 == 1, "about 17").otherwise(F.col("age_first_day").cast("string")),
            "birth_date": F.when(sid % 17 == 2, "31-FEB-1979").otherwise(F.date_format("birth_date", "dd-MMM-yyyy")),
        }
    )
    lines = to_lines(ce.select(*[ours for _, ours, _ in layout]), "\t")
    number = F.split("line", "\t")[0].cast("long")
    cut = F.when(number % 11 == 0, F.regexp_replace("line", "\t[^\t]*$", "")).otherwise(F.col("line"))
    write_lines(lines.select(cut.alias("line")), path, "\t".join(name for name, _, _ in layout))
    return path, layout


def _spell_file(v: Views):
    """A file of all spells in which some begin dates do not parse and some lines have a field too many."""
    path = f"{shared_folder(v.spark)}/files/spells"
    layout = _layout(SPELLS, SPELL_COLUMNS)
    begin = F.when(F.col("sid") % 13 == 4, "May 1997").otherwise(F.col("begin_ymd").cast("string"))
    spells = v.all_spells().select(*SPELL_COLUMNS).withColumn("begin_ymd", begin)
    lines = to_lines(spells.select(*[ours for _, ours, _ in layout]), ",")
    number = F.split("line", ",")[0].cast("long")
    longer = F.when(number % 11 == 3, F.concat("line", F.lit(",more"))).otherwise(F.col("line"))
    write_lines(lines.select(longer.alias("line")), path, ",".join(name for name, _, _ in layout))
    return path, layout


def _intact(rows):
    return rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def _linked_by_bucket(v: Views):
    """Spells with their student's rollup, both from tables in buckets by student."""
    folder = f"{shared_folder(v.spark)}/tables/{zlib.crc32(v.dir.encode())}"
    rollup = save_by_entity(
        v.rollup("num_ce", "max_ce_term"), "rollup_by_student", "sid", 16, path=f"{folder}/rollup"
    )
    spells = save_by_entity(
        v.all_spells().select("sid", "term", "college"), "spells_by_student", "sid", 16, "term", f"{folder}/spells"
    )
    return linkage.linked_spells(spells.filter("term >= 199620"), rollup, null_safe=False)


def _with_missing_ids(v: Views):
    """Enrolments of which a seventh lack the institutional id."""
    ce = v.ce("sid", "enroll_id", "inst_id")
    return ce.withColumn("inst_id", F.when(F.col("enroll_id") % 7 != 0, F.col("inst_id")))


def _zip_top(v: Views, college: str | None = None):
    if college is None:
        return destinations.zip_top(v.zips())
    return destinations.zip_top(linkage.with_zip(v.bindall(), v.zips()), college=college)


def _prepared(v: Views):
    done = prepare_enrollments(
        v.ce_full().withColumnRenamed("gender", "stale").drop("grade_num", "grade_or_zero", "zip5"),
        drop=("stale",),
    )
    return done.select(
        "sid", "enroll_id", "enrolled_after_01", "ever_nonconcurrent_01", "within_one_year_01",
        "course_year", "course_sem", "grade_num", "zip5", "source", "ce_term",
    )


QUERIES = {
    # enrolment
    "null_audit": lambda v: enrolment.null_audit(v.ce()),
    "grad_year_funnel": lambda v: enrolment.grad_year_funnel(v.ce(), 1994, 1998, ORDER),
    "roster_distinct": lambda v: _exported(
        v, "roster_distinct",
        enrolment.roster_distinct(
            v.ce_full("sid", "last_name", "birth_date"), ["sid", "last_name", "birth_date"]
        ),
        ",",
    ),
    "term_bounds": lambda v: enrolment.term_bounds(v.ce("term")),
    "student_rollup": lambda v: _r6(v.rollup(), "ce_gpa"),
    "age_at_event": lambda v: v.students(),
    "age_frequency": lambda v: enrolment.age_frequency(v.students()),
    "adult_students": lambda v: enrolment.adults(v.students(), "age_last_term").select(
        "sid", "age_last_term"
    ),
    "outcome_counts": lambda v: enrolment.outcome_counts(
        enrolment.adults(v.students("enrolled_after"), "age_last_term")
    ),
    "outcome_counts_current": lambda v: enrolment.outcome_counts(
        enrolment.adults(v.students("enrolled_after"))
    ),
    "outcome_share": lambda v: enrolment.outcome_share(
        enrolment.adults(v.students("enrolled_after"), "age_last_term")
    ),
    "outcome_share_current": lambda v: enrolment.outcome_share(
        enrolment.adults(v.students("enrolled_after"))
    ).withColumn("freq_label", percent_label("freq")),
    "term_volume": lambda v: enrolment.term_volume(v.ce("term"), 199520),
    "term_headcount": lambda v: enrolment.term_headcount(v.ce("sid", "term"), 199520),
    "mean_course_load": lambda v: enrolment.mean_course_load(v.ce("sid", "term"), 199520),
    "course_count_dist": lambda v: enrolment.course_count_dist(v.ce("sid")),
    "overall_mean_load": lambda v: enrolment.overall_mean_load(v.ce("sid", "term"), 199620),
    "logit_outcome": lambda v: _logit(v, "age_last_term"),
    "logit_outcome_current": lambda v: _logit(v, "age_current"),
    "logit_residuals": lambda v: _r6(
        op.logit_residuals(_fitted(v, "age_last_term"), "after", ["num_ce"]),
        "min", "q1", "median", "q3", "max",
    ),
    "outcome_by_load": lambda v: enrolment.outcome_by_load(
        enrolment.adults(v.students("num_ce", "enrolled_after"))
    ),
    "outcome_by_load_capped": lambda v: enrolment.outcome_by_load_capped(
        enrolment.adults(v.students("num_ce", "enrolled_after")), 8
    ),
    "outcome_by_load_capped_yes": lambda v: enrolment.outcome_by_load_capped(
        enrolment.adults(v.students("num_ce", "enrolled_after")), 8
    ).filter(F.col("outcome") == "Y"),
    "outcome_loess": lambda v: _loess(v),
    "outcome_loess_direct": lambda v: _loess(v, surface="direct"),
    "common_courses": lambda v: _r6(enrolment.common_courses(v.courses()), "average_grade"),
    "retakes": lambda v: _r6(enrolment.retakes(v.courses()), "mean_grade"),
    "common_subjects": lambda v: enrolment.common_subjects(v.courses(), 4),
    "subset_outcome": lambda v: enrolment.subset_outcome(
        v.courses(), "PROMO", v.as_of(), ["enroll_id", "section", "course_no"]
    ),
    "subset_outcome_by_course": lambda v: enrolment.subset_outcome(
        v.courses(), "PROMO", v.as_of(), ["enroll_id", "section", "course_no"], "course_no"
    ),
    "age_share_slice": lambda v: enrolment.age_share_slice(v.ce("age_first_day"), 3, 5),
    "person_lookup": lambda v: enrolment.person_lookup(
        v.ce(), "sid", 17, ["sid", "enroll_id", "term", "enrolled_after", "age_first_day"]
    ),
    "enrollment_lines": lambda v: _round_trip(v.ce_full(*ENROLLMENT_COLUMNS), ENROLLMENTS, "\t"),
    "spell_lines": lambda v: _round_trip(v.all_spells().select(*SPELL_COLUMNS), SPELLS, ","),
    "enrollment_file": lambda v: _intact(
        read_enrollments(v.spark, *_enrollment_file(v), corrupt="_corrupt")
    ),
    "enrollment_file_audit": lambda v: audit_delimited(v.spark, *_enrollment_file(v), "\t"),
    "spell_file": lambda v: _intact(read_spells(v.spark, *_spell_file(v), corrupt="_corrupt")),
    "spell_file_audit": lambda v: audit_delimited(v.spark, *_spell_file(v), ","),
    "prepare_enrollments": _prepared,
    "prepare_spells": lambda v: prepare_spells(v.all_spells(), domain=(1995, 2000)).select(
        "sid", "college", "begin_ymd", "term", "source"
    ),
    # linkage
    "spell_term": lambda v: linkage.spell_term(v.all_spells()),
    "target_begin_dates": lambda v: linkage.target_begin_dates(
        v.all_spells(), TARGET, 19970501, 19970731, 199730
    ),
    "unmatched_left": lambda v: linkage.unmatched(
        v.ce("sid", "term", "enroll_id"), v.all_spells()
    ),
    "unmatched_right": lambda v: linkage.unmatched(
        v.all_spells().select("sid", "term", "college"), v.ce()
    ),
    "stack_sources": lambda v: linkage.stack(
        enrollments=v.ce("sid", "term", "final_grade"),
        spells=v.all_spells().select("sid", "term", "college"),
    ),
    "linked_term": lambda v: linkage.linked_term(
        v.ce("sid", "term", "enroll_id"), v.all_spells().select("sid", "term", "college")
    ),
    "linked_term_split": lambda v: linkage.linked_term(
        v.ce("sid", "term", "enroll_id"), v.all_spells().select("sid", "term", "college"), pairs=2
    ),
    "linked_term_size": lambda v: linkage.term_link(
        v.ce("sid", "term", "enroll_id"), v.all_spells().select("sid", "term", "college")
    ).size(),
    "linked_term_by_college": lambda v: linkage.term_link(
        v.ce("sid", "term", "enrolled_after"), v.all_spells().select("sid", "term", "college")
    ).counts("term", "enrolled_after", "college"),
    "linked_by_bucket": _linked_by_bucket,
    "linked_spells": lambda v: _r6(
        v.linked("num_ce", "ce_gpa", "max_ce_term", "enrolled_after", "gender").select(
            "sid", "term", "college", "num_ce", "ce_gpa", "max_ce_term", "enrolled_after", "gender",
        ),
        "ce_gpa",
    ),
    "spells_after": lambda v: linkage.spells_after(v.linked()).select(
        "sid", "term", "college", "max_ce_term"
    ),
    "first_college": lambda v: v.first(),
    "award_titles": lambda v: linkage.award_titles(
        linkage.linked_spells(v.all_spells(), v.rollup("max_ce_term"))
    ),
    "latest_spell": lambda v: linkage.latest_spell(
        enrolment.adults(v.students()).select("sid", "age_current"), v.all_spells()
    ),
    "completions": lambda v: linkage.completions(v.all_spells()).select(
        "sid", "term", "college", "degree_title"
    ),
    "non_completions": lambda v: v.spells().select("sid", "term", "college"),
    "prior_target": lambda v: linkage.prior_target(v.linked(), TARGET),
    "linked_without_prior": lambda v: linkage.linked_without_prior(v.linked(), TARGET).select(
        "sid", "term", "college", "max_ce_term"
    ),
    "max_term_attach": lambda v: linkage.max_term_attach(
        v.all_spells().select("sid", "term", "college")
    ),
    "no_record_export": lambda v: _exported(
        v, "no_record_export",
        linkage.no_record_export(v.all_spells().select("sid", "record_found", "graduated"), v.ce()),
        "\t",
    ),
    "id_by_student": lambda v: linkage.id_by_student(v.ce("sid", "inst_id")),
    "id_by_student_missing": lambda v: linkage.id_by_student(_with_missing_ids(v)),
    "no_record_export_missing": lambda v: _exported(
        v, "no_record_export_missing",
        linkage.no_record_export(
            v.all_spells().select("sid", "record_found", "graduated"), _with_missing_ids(v)
        ),
        "\t",
    ),
    "spell_kind": lambda v: linkage.spell_kind(v.all_spells()).select(
        "sid", "begin_ymd", "con_college", "college_label"
    ),
    "first_college_or_none": lambda v: _r6(
        v.bindall("num_ce", "ce_gpa", "gender", "age_current"), "ce_gpa"
    ),
    "student_zip": lambda v: v.zips(),
    "linked_with_zip": lambda v: linkage.with_zip(v.first(), v.zips()),
    # destinations
    "first_college_top": lambda v: destinations.first_college_top(v.first()),
    "first_college_top_rounded": lambda v: destinations.first_college_top(v.bindall(), 11, digits=1),
    "first_college_top_without_target": lambda v: destinations.first_college_top(
        v.bindall(), 10, digits=1, without=TARGET
    ),
    "college_ever_top": lambda v: destinations.college_ever_top(
        linkage.spells_after(v.linked_visits())
    ),
    "first_or_none_top": lambda v: destinations.first_or_none_top(v.bindall()),
    "college_profile": _profile,
    "profile_metric_rank": lambda v: destinations.profile_metric_rank(
        _profile(v), "pc_building", CHOSEN
    ),
    "profile_metric_rank_by_size": lambda v: destinations.profile_metric_rank(
        _profile(v), "ce_gpa", None, by="n", k=10
    ),
    "gpa_box": lambda v: _box(v, "ce_gpa"),
    "gpa_box_hinges": lambda v: _box(v, "ce_gpa", method="hinges"),
    "load_box": lambda v: _box(v, "num_ce"),
    "load_box_outliers": lambda v: destinations.box_outliers_by_college(
        v.bindall("num_ce"), "num_ce", [TARGET, linkage.NO_COLLEGE]
    ),
    "price_box": lambda v: _r6(
        op.box_stats(v.table("orders"), ["o_orderpriority"], "o_totalprice"),
        "q1", "median", "q3", "whisker_low", "whisker_high",
    ),
    "gpa_welch": lambda v: _test(v, "ce_gpa", False),
    "load_ttest": lambda v: _test(v, "num_ce", True),
    "load_welch": lambda v: _test(v, "num_ce", False),
    "zip_top": lambda v: _zip_top(v),
    "zip_top_target": lambda v: _zip_top(v, TARGET),
    "zip_top_none": lambda v: _zip_top(v, linkage.NO_COLLEGE),
    "zip_top_by_college": lambda v: destinations.zip_top_by_college(
        linkage.with_zip(linkage.first_destination(v.visitors()), v.zips()), CHOSEN
    ),
    "course_mix": lambda v: _r6(
        destinations.course_mix(v.bindall(), v.courses(), CHOSEN[:3], grade="grade_or_zero"),
        "avg_grade",
    ),
    "attend_share": lambda v: destinations.attend_share(v.bindall(), TARGET),
    "boundary_check": lambda v: destinations.boundary_check(v.bindall()),
    # cohorts
    "cohort_gap": lambda v: _cohorts(v),
    "cohort_gap_inclusive": lambda v: _cohorts(v, 120, 520),
    "cohort_yield_overall": lambda v: cohorts.cohort_yield_overall(_cohorts(v), SUMMERS, 199800),
    "cohort_yield_overall_inclusive": lambda v: cohorts.cohort_yield_overall(
        _cohorts(v, 120, 520), SUMMERS, 199800
    ),
    "cohort_yield": lambda v: cohorts.cohort_yield(_cohorts(v), SUMMERS, 199800),
    "cohort_yield_inclusive": lambda v: cohorts.cohort_yield(_cohorts(v, 120, 520), SUMMERS, 199800),
    "cohort_yield_mean": lambda v: _r6(
        cohorts.cohort_yield_mean(_cohorts(v), [199520, 199620, 199720]), "avg"
    ),
    "cohort_yield_mean_fall": lambda v: _r6(
        cohorts.cohort_yield_mean(_cohorts(v), [199540, 199640, 199740]), "avg"
    ),
    "cohort_yield_reference_line": lambda v: _r6(
        op.with_overall_mean(
            cohorts.cohort_yield_of(_cohorts(v), [199540, 199640, 199740]), "pc_1_year"
        ),
        "overall_mean",
    ),
    "cohort_campus_attach": lambda v: _cohort_campus(v).select(
        "sid", "max_ce_term", "college", "enroll_1_yr", "campus", "district"
    ),
    "nonenrolled_by_campus": lambda v: cohorts.nonenrolled_by(_cohort_campus(v), "campus", [199640, 199740]),
    "nonenrolled_by_district": lambda v: cohorts.nonenrolled_by(_cohort_campus(v), "district"),
    "nonenrolled_by_district_spring": lambda v: cohorts.nonenrolled_by(
        _cohort_campus(v), "district", [199640, 199740]
    ),
    "enrolled_by_campus": lambda v: cohorts.enrolled_by(_cohort_campus(v), "campus", TARGET),
    "enrolled_by_district": lambda v: cohorts.enrolled_by(_cohort_campus(v), "district", TARGET),
    "destination_top_by_cohort": lambda v: cohorts.destination_top_by_cohort(
        _cohorts(v), after=199540, without=SUMMERS
    ),
    "destination_share_top_by_cohort": lambda v: cohorts.destination_top_by_cohort(
        _cohorts(v), terms=[199620, 199720, 199740], by_share=True
    ),
    "destination_share_top": lambda v: cohorts.destination_share_top(_cohorts(v)),
    # schools
    "school_student_counts": lambda v: schools.school_student_counts(v.ce_full("sid", "term", "high_school"), 199540),
    "campus_student_counts": lambda v: schools.school_student_counts(v.ce_full("sid", "term", "campus"), 199540, "campus"),
    "school_headcount_top": lambda v: schools.school_headcount_top(v.ce_full("sid", "term", "high_school"), 199520, SUMMERS),
    "campus_headcount_top": lambda v: schools.school_headcount_top(
        v.ce_full("sid", "term", "campus"), 199520, SUMMERS, school="campus"
    ),
    "school_share_top": lambda v: schools.school_share_top(
        v.ce_full("sid", "term", "high_school"), v.school_districts(), 20, after=199540, without=SUMMERS
    ),
    "school_share_top_terms": lambda v: schools.school_share_top(
        v.ce_full("sid", "term", "high_school"), v.school_districts(), 20, terms=[199640, 199720]
    ),
    "campus_share_top": lambda v: schools.school_share_top(
        v.ce_full("sid", "term", "campus"), v.campus_districts(), 10, "campus", after=199540, without=SUMMERS,
        keep_missing=True,
    ),
    "campus_share_top_whole": lambda v: schools.school_share_top(
        v.ce_full("sid", "term", "campus"), v.campus_districts(), 20, "campus", terms=[199640, 199720], digits=0
    ),
    "school_names": lambda v: schools.school_names(
        v.ce_full("high_school").withColumn("high_school", F.concat("high_school", F.lit(" High School"))),
        ["NATION_4 High School"], "high school",
    ),
    "crosswalk_attach": lambda v: _ce_district(v).select("sid", "enroll_id", "high_school", "district"),
    "crosswalk_attach_campus": lambda v: op.attach_crosswalk(
        v.ce_full("sid", "enroll_id", "campus"), v.campus_districts(), "campus"
    ),
    "crosswalk_attach_zip": lambda v: op.attach_crosswalk(
        v.ce_full("sid", "enroll_id", "zip5"), v.zip_places(), "zip5"
    ),
    "campus_district_share": lambda v: schools.district_share(
        op.attach_crosswalk(v.ce_full("sid", "term", "campus"), v.campus_districts(), "campus"),
        199540, SUMMERS,
    ),
    "district_share": lambda v: schools.district_share(_ce_district(v), 199540, SUMMERS),
    "district_overall": lambda v: schools.district_overall(_ce_district(v)),
    "campus_overall_top": lambda v: schools.campus_overall_top(v.ce_full("campus"), v.campus_districts(), 20),
    "missing_school_audit": lambda v: schools.missing_school_audit(v.ce_full("term", "high_school"), 199520),
    "campus_list": lambda v: schools.campus_list(v.ce_full("campus")),
    "group_max_attach": lambda v: schools.group_max_attach(v.ce("sid", "enroll_id", "term")),
    # demographics
    "gender_share": lambda v: demographics.gender_share(v.ce("sid", "term", "gender"), 199540),
    "gender_share_by_year": lambda v: demographics.gender_share(v.ce("sid", "term", "gender"), 199540, "course_year"),
    "load_by_gender": lambda v: _r6(demographics.load_by_group(v.ce("sid", "gender")), "avg_courses", "sd"),
    "load_by_ethnicity": lambda v: _r6(
        demographics.load_by_group(
            v.ce_full("sid", "ethnicity"), "ethnicity", ["FURNITURE"]
        ), "avg_courses", "sd"
    ),
    "race_by_term": lambda v: demographics.race_by_term(v.ce_full("sid", "term", "ethnicity"), 199540),
    "race_share": lambda v: demographics.race_share(v.ce_full("sid", "term", "ethnicity"), 199540, ["FURNITURE"]),
    "race_by_district": lambda v: demographics.race_by_district(_ce_district(v), "district", "ethnicity"),
    "district_by_race": lambda v: demographics.race_by_district(
        _ce_district(v), "ethnicity", "district", only="BUILDING"
    ),
    "district_by_race_hidden": lambda v: demographics.race_by_district(
        _ce_district(v), "ethnicity", "district", without=["FURNITURE"], hidden=["ASIA", "EUROPE"]
    ),
    "zip_counts_top": lambda v: demographics.zip_counts_top(v.ce_full("sid", "term", "zip5"), 199540),
    "zip_region_top": lambda v: demographics.zip_region_top(v.ce_full("sid", "enroll_id", "term", "zip5", "region", "city"), ORDER, 15, after=199540),
    "zip_region_share_top": lambda v: demographics.zip_region_top(
        v.ce_full("sid", "enroll_id", "term", "zip5", "region", "city"), ORDER, 15, after=199540, with_share=True
    ),
    "zip_region_share_top_by_term": lambda v: demographics.zip_region_top(
        v.ce_full("sid", "enroll_id", "term", "zip5", "region", "city"), ORDER, 15, terms=[199640, 199720], with_share=True, by_term=True
    ),
    "pell_counts": lambda v: demographics.indicator_counts(v.ce_full("pell_eligible"), "pell_eligible"),
    "firstgen_counts": lambda v: demographics.indicator_counts(v.ce_full("first_generation"), "first_generation"),
    # operators not reached by name above
    "is_duplicate": lambda v: op.is_duplicate(
        v.ce("sid", "enroll_id", "term"), ["sid"], ["term", "enroll_id"]
    ),
    "frequency_table": lambda v: op.freq(v.ce("hs_grad_year"), "hs_grad_year"),
    "fill_where": lambda v: op.fill_where(
        v.ce("enroll_id", "ever_nonconcurrent"), "ever_nonconcurrent",
        F.col("ever_nonconcurrent").isNull(), "N",
    ),
    "drop_incomplete": lambda v: op.drop_incomplete(
        v.ce("enroll_id", "hs_grad_year", "ever_nonconcurrent")
    ),
    "labels": lambda v: v.ce("enroll_id", "term", "ever_nonconcurrent", "inst_id").select(
        "enroll_id",
        label("term", "ever_nonconcurrent", sep="").alias("term_key"),
        strip_suffix("inst_id", "b").alias("bare_id"),
    ),
}
