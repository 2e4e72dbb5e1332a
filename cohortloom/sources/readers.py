"""Reading the two inputs and deriving their standard columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import flag01, grade_points, label, parse_date, term_of_ymd, term_season, term_year, zip5
from .schemas import ENROLLMENTS, SPELLS

Layout = tuple[tuple[str, str, str], ...]
# How a value is written in either file.
TEXT = {"nullValue": "NA", "quote": '"', "escape": '"'}


def _plain(name: str) -> str:
    """Header names compare without case, dots and spaces: 'College Name' is 'College.Name'."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _typed(column: Column, kind: str) -> Column:
    if kind == "string":
        return column
    if kind == "date":
        return parse_date(column)
    return F.trim(column).try_cast(kind)


def _raw(
    spark: SparkSession, path: str, sep: str, header: list[str] | None, corrupt: str | None
) -> DataFrame:
    """The file's columns as text."""
    reader = spark.read.options(**TEXT, sep=sep, header=True, mode="PERMISSIVE", enforceSchema=False)
    if corrupt is not None:
        header = header or reader.csv(path).columns
        # A pruned line would not be checked for its number of fields.
        reader = reader.options(columnNameOfCorruptRecord=corrupt, columnPruning=False)
    if header is not None:
        names = [*header, *([corrupt] if corrupt is not None else [])]
        reader = reader.schema(T.StructType([T.StructField(h, T.StringType()) for h in names]))
    return reader.csv(path)


def read_delimited(
    spark: SparkSession,
    path: str,
    layout: Layout,
    sep: str,
    header: list[str] | None = None,
    corrupt: str | None = None,
) -> DataFrame:
    """Read delimited text with a header by column name; nothing is inferred.

    ``header`` names the file's columns in order and saves opening a file to read them. A value that
    does not parse, and the text NA, become NULL. Apostrophes and '#' are ordinary characters.

    A line with too few or too many fields gives a row with the fields it has. With ``corrupt`` such a
    row carries its whole line in a column of that name, where all other rows have NULL.
    """
    raw = _raw(spark, path, sep, header, corrupt)
    found = typed(raw, layout)
    return found if corrupt is None else typed(raw, (*layout, (corrupt, corrupt, "string")))


def audit_delimited(
    spark: SparkSession, path: str, layout: Layout, sep: str, header: list[str] | None = None
) -> DataFrame:
    """What a file's reading rejects: (field, expected, n_lines, n_rejected, example).

    The first row counts the lines with a wrong number of fields; then comes a row per column that is
    not text, with the values of intact lines that do not parse. ``example`` is the least of those
    rejected. One pass over the file.
    """
    corrupt = "_corrupt_line"
    raw = _raw(spark, path, sep, header, corrupt)
    at = {_plain(c): F.col(f"`{c}`") for c in raw.columns if c != corrupt}
    line = F.col(corrupt)
    checks = [("(line)", "as many fields as the header", line.isNotNull(), line)]
    for name, ours, kind in layout:
        if kind != "string":
            value = at[_plain(name)]
            given = line.isNull() & (F.trim(value) != "")
            checks.append((ours, kind, given & _typed(value, kind).isNull(), value))
    any_column = next(iter(at.values()))  # Spark reads no file for its corrupt lines alone
    counted = raw.agg(
        (F.count(any_column) + F.count_if(any_column.isNull())).alias("n_lines"),
        *[F.count_if(bad).alias(f"n_{i}") for i, (_, _, bad, _) in enumerate(checks)],
        *[F.min(F.when(bad, value)).alias(f"e_{i}") for i, (_, _, bad, value) in enumerate(checks)],
    )
    rows = F.array(*[
        F.struct(
            F.lit(field).alias("field"), F.lit(expected).alias("expected"), F.col("n_lines"),
            F.col(f"n_{i}").alias("n_rejected"), F.col(f"e_{i}").alias("example"),
        )
        for i, (field, expected, _, _) in enumerate(checks)
    ])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def from_lines(lines: DataFrame, layout: Layout, sep: str, line: str = "line") -> DataFrame:
    """Type lines of delimited text that hold the layout's columns in its order, by the same rules."""
    fields = ", ".join(f"`{name}` string" for name, _, _ in layout)
    parsed = F.from_csv(line, F.lit(fields), {**TEXT, "sep": sep})
    return typed(lines.select(parsed.alias("parsed")).select("parsed.*"), layout)


def typed(raw: DataFrame, layout: Layout) -> DataFrame:
    """Text columns by the layout's names, in its types."""
    at = {_plain(c): f"`{c}`" for c in raw.columns}
    missing = [name for name, _, _ in layout if _plain(name) not in at]
    if missing:
        raise ValueError(f"columns not in the file: {missing}")
    return raw.select(
        *[_typed(F.col(at[_plain(name)]), kind).alias(ours) for name, ours, kind in layout]
    )


def read_enrollments(
    spark: SparkSession,
    path: str,
    layout: Layout = ENROLLMENTS,
    header: list[str] | None = None,
    corrupt: str | None = None,
) -> DataFrame:
    """Tab-separated enrolments, one row per student, term and course section."""
    return read_delimited(spark, path, layout, "\t", header, corrupt)


def read_spells(
    spark: SparkSession,
    path: str,
    layout: Layout = SPELLS,
    header: list[str] | None = None,
    corrupt: str | None = None,
) -> DataFrame:
    """Comma-separated college spells, one row per student and spell."""
    return read_delimited(spark, path, layout, ",", header, corrupt)


def prepare_enrollments(ce: DataFrame, source: str = "enrollments", drop: tuple[str, ...] = ()) -> DataFrame:
    """Standard derived columns: 0/1 flags, grade points, class, zip5, year, season and tags."""
    derived = {
        "enrolled_after_01": flag01("enrolled_after"),
        "ever_nonconcurrent_01": flag01("ever_nonconcurrent"),
        "within_one_year_01": flag01("within_one_year"),
        "course_year": term_year("term"),
        "course_sem": term_season("term"),
        "source": F.lit(source),
        "ce_term": F.lit("Y"),
    }
    optional = {
        "final_grade": ("grade_num", grade_points("final_grade")),
        "course_no": ("class", label("subject", "course_no")),
        "address_zip": ("zip5", zip5("address_zip")),
    }
    derived |= {name: c for needs, (name, c) in optional.items() if needs in ce.columns}
    return ce.withColumns(derived).drop(*drop)


def prepare_spells(
    spells: DataFrame,
    source: str = "spells",
    domain: tuple[int, int] | None = (2009, 2017),
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Standard derived columns: term of the begin date and tag; blank colleges become ''."""
    return spells.withColumns(
        {
            "term": term_of_ymd("begin_ymd", domain),
            "college": F.coalesce(F.trim("college"), F.lit("")),
            "source": F.lit(source),
        }
    ).drop(*drop)
