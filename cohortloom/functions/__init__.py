"""Column functions: everything here takes and returns Spark Columns."""

from .dates import age_years, between_open, parse_date
from .grades import grade_points
from .nulls import (
    count_null,
    ever_flag,
    first_by,
    flag01,
    na_max,
    na_mean,
    na_min,
    na_sd,
    na_sum,
    or_label,
    pct_where,
    yes_no,
)
from .terms import gap, term_end, term_of_date, term_of_ymd, term_season, term_year, within
from .text import cap, label, percent_label, strip_suffix, zip5

__all__ = [
    "age_years", "between_open", "cap", "count_null", "ever_flag", "first_by", "flag01", "gap",
    "grade_points", "label", "na_max", "na_mean", "na_min", "na_sd", "na_sum", "or_label",
    "parse_date", "pct_where", "percent_label", "strip_suffix", "term_end", "term_of_date",
    "term_of_ymd", "term_season", "term_year", "within", "yes_no", "zip5",
]
