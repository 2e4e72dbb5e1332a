"""Flags and aggregates that keep a missing value missing.

The analyses treat an unknown flag as unknown, not as "no", and a sum over a column with a missing
value as missing unless told to drop it. Spark's own aggregates skip nulls, so ``na_rm=False`` adds a
guard that compares the row count with the non-null count in the same aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag01(c: Column | str, yes: str = "Y") -> Column:
    """1 / 0 / NULL."""
    return (as_col(c) == F.lit(yes)).cast("int")


def yes_no(cond: Column) -> Column:
    """'Y' / 'N', NULL where the condition is unknown."""
    return F.when(cond, "Y").when(~cond, "N")


def or_label(c: Column | str, text: str) -> Column:
    """Blank, whitespace, literal NA and NULL all become ``text``."""
    trimmed = F.trim(as_col(c))
    return F.coalesce(F.nullif(F.nullif(trimmed, F.lit("")), F.lit("NA")), F.lit(text))


def _guarded(agg: Column, c: Column, na_rm: bool) -> Column:
    return agg if na_rm else F.when(F.count(F.lit(1)) == F.count(c), agg)


def na_sum(c: Column | str, na_rm: bool = False) -> Column:
    c = as_col(c)
    return _guarded(F.sum(c), c, na_rm)


def na_mean(c: Column | str, na_rm: bool = False) -> Column:
    c = as_col(c)
    return _guarded(F.avg(c), c, na_rm)


def na_min(c: Column | str, na_rm: bool = False) -> Column:
    c = as_col(c)
    return _guarded(F.min(c), c, na_rm)


def na_max(c: Column | str, na_rm: bool = False) -> Column:
    c = as_col(c)
    return _guarded(F.max(c), c, na_rm)


def na_sd(c: Column | str, na_rm: bool = False) -> Column:
    """Sample standard deviation; NULL for a single row."""
    c = as_col(c)
    return _guarded(F.stddev_samp(c), c, na_rm)


def ever_flag(c: Column | str, levels: tuple[str, ...] = ("N", "U", "Y")) -> Column:
    """Highest flag seen, in the order of ``levels``: "ever Y" beats "ever U" beats N.

    The flag is aggregated as its position, so the buffer is a plain integer and Spark can keep the
    rollup in a hash aggregate; a maximum over text would force a sort of the whole input. A missing
    flag makes the result missing, as does a value outside ``levels``.
    """
    c = as_col(c)
    # when-chain, not array_position: that one answers 0 for "not found", which max would hide.
    position = F.lit(None).cast("int")
    for i, level in reversed(list(enumerate(levels, 1))):
        position = F.when(c == F.lit(level), i).otherwise(position)
    names = F.array(*[F.lit(level) for level in levels])
    top = F.when(F.count(F.lit(1)) == F.count(position), F.max(position))
    return F.get(names, top - 1)


def first_by(c: Column | str, *order: Column | str) -> Column:
    """Value on the first row of the group in a declared order; a missing first value stays missing."""
    return F.min_by(as_col(c), F.struct(*[as_col(o) for o in order]))


def pct_where(cond: Column, digits: int = 2) -> Column:
    """Percent of rows meeting a condition, half-even rounded; NULL if it is unknown on any row."""
    n = F.count(F.lit(1))
    return F.when(n == F.count(cond), F.bround(F.count_if(cond) / n * 100, digits))


def count_null(c: Column | str) -> Column:
    return F.count_if(as_col(c).isNull())
