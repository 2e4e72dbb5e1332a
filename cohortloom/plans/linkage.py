"""Linking enrolments with college spells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import between_open, na_max, or_label, zip5
from ..operators.ordering import sort_key
from ..operators import (
    Link,
    anti_join,
    counts,
    first_event,
    first_row,
    last_event,
    left_join,
    stack_sources,
    with_group_max,
)

NO_COLLEGE = "NO COLLEGE"


def spell_term(spells: DataFrame) -> DataFrame:
    """Spells per begin date with the term each date falls in."""
    return counts(spells, "begin_ymd", "term")


def target_begin_dates(
    spells: DataFrame, college: str, after: int, before: int, term_code: int
) -> DataFrame:
    """Spells of one college by begin date; dates strictly inside the interval carry the term code."""
    table = counts(spells.filter(F.col("college") == college), "begin_ymd")
    inside = between_open("begin_ymd", after, before)
    return table.withColumn("term_code", F.when(inside, term_code).when(~inside, 0))


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows without a counterpart for the same student and term; missing terms match each other."""
    return anti_join(left, right, ["sid", "term"])


def linked_term(ce: DataFrame, spells: DataFrame, pairs: int | None = None) -> DataFrame:
    """Enrolments with the spells of the same student and term.

    With ``pairs`` a student's term with more joined rows than that is dealt out over several tasks.
    """
    return term_link(ce, spells).expand(pairs)


def term_link(ce: DataFrame, spells: DataFrame) -> Link:
    """The same link unexpanded: its sizes and counts need no joined row."""
    return Link(ce, spells, ["sid", "term"])


def visits(spells: DataFrame) -> DataFrame:
    """Distinct (student, term, college).

    First and later colleges need no more of the spells. Map tasks already combine them, so a student
    with very many spells is a few rows before any join.
    """
    return spells.select("sid", "term", "college").distinct()


def linked_spells(spells: DataFrame, rollup: DataFrame, null_safe: bool = True) -> DataFrame:
    """Spells with their student's rollup.

    Of ``visits``, where no student is missing, ``null_safe=False`` joins on the partitioning that the
    rollup and later steps per student have anyway.
    """
    return left_join(spells, rollup, ["sid"], null_safe)


def spells_after(linked: DataFrame) -> DataFrame:
    """Spells later than the student's last enrolment term."""
    return linked.filter(F.col("term") > F.col("max_ce_term"))


def first_college(linked: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First later spell of each student; two colleges in the same term go by name."""
    return first_event(spells_after(linked), "sid", "term", ["college"], columns)


def award_titles(linked: DataFrame) -> DataFrame:
    return counts(linked, "degree_title")


def latest_spell(
    students: DataFrame, spells: DataFrame, columns: Sequence[str] = ("term", "college")
) -> DataFrame:
    """Every student with their latest spell, or none. Spells are reduced before the join."""
    latest = last_event(spells, "sid", "term", ["college"], columns)
    return left_join(students, latest, ["sid"], null_safe=False)


def completions(spells: DataFrame, keep: bool = True) -> DataFrame:
    """Spells that are completions, or with ``keep=False`` those that are not."""
    return spells.filter(F.col("graduated") == ("Y" if keep else "N"))


def prior_target(linked: DataFrame, college: str) -> DataFrame:
    """Students at one college no later than their last enrolment term: the first such spell."""
    prior = completions(linked, keep=False).filter(
        (F.col("college") == college) & (F.col("term") <= F.col("max_ce_term"))
    )
    return first_row(prior, ["sid"], ["term"], ["term", "max_ce_term"])


def linked_without_prior(linked: DataFrame, college: str) -> DataFrame:
    """Linked rows except those of a prior spell's student and term."""
    return anti_join(linked, prior_target(linked, college), ["sid", "term"])


def max_term_attach(spells: DataFrame) -> DataFrame:
    """Every spell with the student's last term; undated spells do not count towards it."""
    return with_group_max(spells, ["sid"], "term", "max_term")


def id_by_student(ce: DataFrame) -> DataFrame:
    """Institutional id per student; missing if it is missing on any of the student's rows."""
    return ce.groupBy("sid").agg(na_max("inst_id").alias("inst_id"))


def no_record_export(spells: DataFrame, ce: DataFrame) -> DataFrame:
    """Spell rows without a record, with the institutional id, for export."""
    missing = spells.filter(F.col("record_found") == "N")
    return left_join(missing, id_by_student(ce), ["sid"])


def spell_kind(spells: DataFrame) -> DataFrame:
    """A blank college is a concurrent semester; its label becomes NO COLLEGE.

    A missing college has an unknown kind and the same label.
    """
    blank = F.trim("college") == ""
    return spells.withColumns(
        {
            "con_college": F.when(blank, "concurrent").when(~blank, "college"),
            "college_label": or_label("college", NO_COLLEGE),
        }
    )


def adult_spells(linked: DataFrame, at_least: int = 18) -> DataFrame:
    """Spells of adult students, a blank or missing college labelled NO COLLEGE.

    ``linked`` carries age_current; completions must have been removed.
    """
    return linked.filter(F.col("age_current") >= at_least).withColumn(
        "college", or_label("college", NO_COLLEGE)
    )


def first_college_or_none(
    people: DataFrame,
    columns: Sequence[str] = (
        "term", "college", "max_ce_term", "num_ce", "ce_gpa", "gender", "ethnicity", "age_current",
    ),
) -> DataFrame:
    """First later spell of each adult student, together with all their no-college rows.

    ``people`` comes from ``adult_spells``. A student whose spells are all at or before the last
    enrolment term, and at real colleges, appears in neither part. Both parts come from one pass: a
    student's later spells are reduced to the first, equal no-college rows to one with their number.
    """
    columns = list(columns)
    kept = people.select("sid", *columns)
    none = F.when(F.col("college") == NO_COLLEGE, F.struct(*columns))
    later = F.col("term") > F.col("max_ce_term")
    # A row per part that a spell belongs to: as a later spell it has no _none, as a no-college row
    # it is its own.
    parts = F.when(later & none.isNotNull(), F.array(F.nullif(none, none), none)).when(
        later | none.isNotNull(), F.array(none)
    )
    tagged = kept.withColumn("_none", F.explode(parts))
    order = sort_key(kept, ["term", "college"], carry=columns)
    found = tagged.groupBy("sid", "_none").agg(
        F.min(order).alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    copies = F.when(F.col("_none").isNull(), 1).otherwise(F.col("_rows"))
    repeated = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return repeated.select("sid", *[F.col("_first")[c].alias(c) for c in columns])


def first_destination(
    people: DataFrame, columns: Sequence[str] = ("term", "max_ce_term", "college")
) -> DataFrame:
    """One row per adult student: the first later spell, else a no-college row.

    This is the first row per student of ``first_college_or_none`` (an undated row sorts last),
    computed in one pass: the earliest of the later spells is also the earliest of these rows.
    """
    kept = people.filter(
        (F.col("term") > F.col("max_ce_term")) | (F.col("college") == NO_COLLEGE)
    )
    return first_event(kept, "sid", "term", ["college"], columns)


def student_zip(ce: DataFrame, order_by: Sequence[str], raw: str = "address_zip") -> DataFrame:
    """One five-digit zip per student: the one on the first row."""
    return first_row(ce, ["sid"], order_by, [raw]).select("sid", zip5(raw).alias("zip5"))


def with_zip(df: DataFrame, zips: DataFrame) -> DataFrame:
    return left_join(df, zips, ["sid"])


def stack(**frames: DataFrame) -> DataFrame:
    """Both inputs in one frame, tagged by source."""
    return stack_sources("source", **frames)
