"""Labels, prefixes and small numeric helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import as_col


def label(*cols: Column | str, sep: str = " ") -> Column:
    """Joined label in which a missing part shows as NA (keys are compared as columns, never as labels)."""
    return F.concat_ws(sep, *[F.coalesce(as_col(c).cast("string"), F.lit("NA")) for c in cols])


def percent_label(share: Column | str, digits: int = 0) -> Column:
    """0.257 -> '26%'."""
    pct = F.bround(as_col(share) * 100, digits)
    return F.concat((pct.cast("long") if digits == 0 else pct).cast("string"), F.lit("%"))


def zip5(c: Column | str) -> Column:
    """Five-digit prefix as a number; NULL when it is not one."""
    return F.substring(as_col(c), 1, 5).try_cast("double")


def strip_suffix(c: Column | str, text: str) -> Column:
    """Remove the first occurrence of a text, whatever its case."""
    return F.regexp_replace(as_col(c), rf"(?is)^(.*?){re.escape(text)}", "$1")


def cap(c: Column | str, at: int) -> Column:
    """Integers above ``at - 1`` become ``at``; NULL stays NULL."""
    c = as_col(c)
    return F.when(c > at, F.lit(at)).otherwise(c)
