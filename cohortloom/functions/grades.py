"""Letter grades as points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import as_col

# Points per letter grade.
POINTS = {
    "A": 4.0, "A-": 3.7, "B+": 3.3, "B": 3.0, "B-": 2.7, "C+": 2.3,
    "C": 2.0, "C-": 1.7, "D+": 1.3, "D": 1.0, "D-": 0.7,
}
# Grades that count as zero points in a grade average.
ZERO_GRADES = ("E", "W", "I")


def grade_points(c: Column | str, other: float | None = None) -> Column:
    """Points of a letter grade. ``other`` is given to any remaining letter; a missing grade stays NULL."""
    c = as_col(c)
    table = POINTS | {g: 0.0 for g in ZERO_GRADES}
    lookup = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    points = F.try_element_at(lookup, c)
    if other is None:
        return points
    return F.when(c.isNotNull(), F.coalesce(points, F.lit(float(other))))
