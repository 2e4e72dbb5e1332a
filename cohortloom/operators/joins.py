"""Linkage: left and anti joins in which missing keys match, crosswalks, tagged unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _condition(on: Sequence[str], null_safe: bool | Sequence[str]) -> Column:
    safe = (on if null_safe else ()) if isinstance(null_safe, bool) else null_safe
    pairs = [(k, F.col(k), F.col(f"_right_{k}")) for k in on]
    tests = [a.eqNullSafe(b) if k in safe else a == b for k, a, b in pairs]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def left_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    null_safe: bool | Sequence[str] = True,
    suffix: str = "_y",
) -> DataFrame:
    """Left join in which two missing keys match; right columns that collide get a suffix.

    A null-safe key also gives each side a shuffle of its own, so that Spark can split a hot key of
    the left side at run time even where the right side is an aggregate on that key. Where both sides
    hold one row per key and the key is never missing, ``null_safe=False`` gives the same result and
    reuses the aggregates' partitioning; a list names the keys that need null-safety.
    """
    on = list(on)
    others = [c for c in right.columns if c not in on]
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in on],
        *[F.col(c).alias(c + suffix if c in left.columns else c) for c in others],
    )
    return left.join(renamed, _condition(on, null_safe), "left").drop(*[f"_right_{k}" for k in on])


def anti_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    null_safe: bool | Sequence[str] = True,
) -> DataFrame:
    """Left rows without a match, where two missing keys match.

    The right side is reduced to its distinct keys before the shuffle.
    """
    on = list(on)
    keys = right.select(*[F.col(k).alias(f"_right_{k}") for k in on]).distinct()
    return left.join(keys, _condition(on, null_safe), "left_anti")


def attach_crosswalk(
    df: DataFrame, crosswalk: DataFrame, key: str, null_safe: bool = False
) -> DataFrame:
    """Attach the values of a lookup whose keys were checked by ``sources.crosswalk``.

    No broadcast hint: Spark broadcasts the lookup while its size is under the session's threshold
    and joins by shuffle beyond it.
    """
    return left_join(df, crosswalk, [key], null_safe)


def stack_sources(tag: str = "source", **frames: DataFrame) -> DataFrame:
    """Union all by name, each row tagged with the name of its frame; absent columns are NULL."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
