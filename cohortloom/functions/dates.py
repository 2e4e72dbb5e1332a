"""Dates and completed ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import as_col


def parse_date(c: Column | str, pattern: str = "dd-MMM-yyyy") -> Column:
    """Date, NULL when the text does not parse."""
    return F.try_to_date(as_col(c), pattern)


def age_years(birth: Column | str, as_of: Column | str) -> Column:
    """Completed years. Compared on month and day, so a Feb 29 birthday completes on Mar 1."""
    b, a = as_col(birth), as_col(as_of)
    not_yet = F.month(a) * 100 + F.dayofmonth(a) < F.month(b) * 100 + F.dayofmonth(b)
    return F.year(a) - F.year(b) - not_yet.cast("int")


def between_open(c: Column | str, lo, hi) -> Column:
    """Strictly between; NULL stays NULL."""
    c = as_col(c)
    return (c > F.lit(lo)) & (c < F.lit(hi))
