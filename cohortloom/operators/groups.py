"""Counts, shares and two-level aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import left_join


def counts(df: DataFrame, *keys: str, name: str = "n", **aggregates: Column) -> DataFrame:
    """Rows per group, with any further aggregates; a missing key is a group of its own."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(name), *[c.alias(k) for k, c in aggregates.items()]
    )


def freq(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Frequency table; rows with a missing key are left out."""
    return counts(df.na.drop("any", subset=list(keys)), *keys, name=name)


def headcount(df: DataFrame, entity: str, *keys: str, name: str = "n") -> DataFrame:
    """Distinct entities per group. Spark deduplicates by (group, entity) first, so a large group is
    spread over its entities."""
    return df.groupBy(*keys).agg(F.count_distinct(entity).alias(name))


def per_entity_then(
    df: DataFrame,
    entity_keys: Sequence[str],
    first: dict[str, Column],
    keys: Sequence[str],
    then: dict[str, Column],
) -> DataFrame:
    """Aggregate per entity, then aggregate the entities."""
    inner = df.groupBy(*entity_keys).agg(*[c.alias(k) for k, c in first.items()])
    return inner.groupBy(*keys).agg(*[c.alias(k) for k, c in then.items()])


def share(
    df: DataFrame,
    value: str = "n",
    within: Sequence[str] = (),
    name: str = "share",
    scale: int = 1,
    digits: int | None = None,
) -> DataFrame:
    """Each row's part of the total, overall or within leading keys; the filters applied before this
    call decide the denominator.

    The total is an aggregate of the same rows, joined back or taken as one value, so no group is ever
    read by one task. Spark computes the rows once and reuses their shuffle for the total.
    """
    within = list(within)
    if not within:
        total = df.agg(F.sum(value).alias("total")).scalar()
    else:
        df = left_join(df, df.groupBy(*within).agg(F.sum(value).alias("_total")), within)
        total = F.col("_total")
    part = F.try_divide(F.col(value), total)
    if scale != 1:
        part = part * scale
    if digits is not None:
        part = F.bround(part, digits)
    return df.withColumn(name, part).drop("_total")


def exclude(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Drop listed values; rows with a missing value drop too."""
    c = F.col(column)
    return df.filter(c.isNotNull() & ~c.isin(*values)) if values else df.filter(c.isNotNull())


def drop_incomplete(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop("any", subset=list(columns) or None)


def fill_where(df: DataFrame, column: str, cond: Column, value) -> DataFrame:
    """Set a value on the rows meeting a condition; an unknown condition leaves the row alone."""
    return df.withColumn(column, F.when(cond, F.lit(value)).otherwise(F.col(column)))


def with_overall_mean(df: DataFrame, value: str, name: str = "overall_mean") -> DataFrame:
    """Reference line of a chart dataset: its mean on every row."""
    return df.withColumn(name, df.agg(F.avg(value).alias("mean")).scalar())
