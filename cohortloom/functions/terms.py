"""Academic term codes: year * 100 + 20 (spring), 30 (summer) or 40 (fall)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import as_col

# Season suffix -> name, and the last month and day of that season.
SEASONS = {20: "Spring", 30: "Summer", 40: "Fall"}
SEASON_END = {20: (5, 31), 30: (8, 31), 40: (12, 31)}
# Month-day ranges (as mmdd) in which a begin date counts for a season.
BEGIN_RANGES = {20: (101, 430), 30: (501, 731), 40: (801, 1231)}


def _by_season(code: Column, values: dict[int, Column]) -> Column:
    picked = F.when(F.lit(False), next(iter(values.values())))
    for suffix, value in values.items():
        picked = picked.when(code % 100 == suffix, value)
    return picked


def _div(c: Column, by: int) -> Column:
    return F.call_function("div", c, F.lit(by)).cast("int")


def term_year(c: Column | str) -> Column:
    return _div(as_col(c), 100)


def term_season(c: Column | str) -> Column:
    """Season name; NULL for a suffix that is not a known season."""
    return _by_season(as_col(c), {s: F.lit(name) for s, name in SEASONS.items()})


def term_end(c: Column | str) -> Column:
    """Last day of the term as a date."""
    c = as_col(c)
    return _by_season(
        c, {s: F.make_date(term_year(c), F.lit(m), F.lit(d)) for s, (m, d) in SEASON_END.items()}
    )


def term_of_ymd(c: Column | str, domain: tuple[int, int] | None = None) -> Column:
    """Term code of an integer date YYYYMMDD; outside the year domain, or no known range, is NULL."""
    c = as_col(c)
    year, mmdd = _div(c, 10000), c % 10000
    term = F.when(F.lit(False), F.lit(0))
    for suffix, (lo, hi) in BEGIN_RANGES.items():
        term = term.when(mmdd.between(lo, hi), year * 100 + suffix)
    return term if domain is None else F.when(year.between(*domain), term)


def term_of_date(c: Column | str, domain: tuple[int, int] | None = None) -> Column:
    """Term code of a date; outside the year domain it is NULL."""
    year, month = F.year(as_col(c)), F.month(as_col(c))
    term = F.when(F.lit(False), F.lit(0))
    for suffix, (_, last) in BEGIN_RANGES.items():
        term = term.when(month <= last // 100, year * 100 + suffix)
    return term if domain is None else F.when(year.between(*domain), term)


def gap(term: Column | str, base: Column | str) -> Column:
    """Difference of term codes; 100 is one year."""
    return as_col(term) - as_col(base)


def within(gap_col: Column | str, limit: int) -> Column:
    """1 / 0 / NULL."""
    return (as_col(gap_col) <= F.lit(limit)).cast("int")
