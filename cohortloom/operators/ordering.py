"""Order specifications: column names, a leading '-' for descending, missing values always last.

There is no file order in Spark, so every operator that picks rows takes such a list; ending it with
a unique key makes the result independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _parse(order_by: Sequence[str]) -> list[tuple[str, bool]]:
    if isinstance(order_by, str):
        order_by = [order_by]
    return [(o.lstrip("-"), o.startswith("-")) for o in order_by]


def sort_columns(order_by: Sequence[str]) -> list[Column]:
    return [
        F.col(name).desc_nulls_last() if desc else F.col(name).asc_nulls_last()
        for name, desc in _parse(order_by)
    ]


def _reversed(c: Column, dtype: T.DataType) -> Column | None:
    if isinstance(dtype, T.IntegralType):
        return F.bitwise_not(c)
    if isinstance(dtype, T.DateType):
        return F.bitwise_not(F.unix_date(c))
    if isinstance(dtype, T.TimestampType):
        return F.bitwise_not(F.unix_micros(c))
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return -c
    return None


def sort_key(
    df: DataFrame, order_by: Sequence[str], carry: Sequence[str] = ()
) -> Column | None:
    """One comparable struct for the whole order, smallest first; None if a text sorts descending.

    It also holds the columns to ``carry``, under their names; those the order does not determine
    come last and settle ties.
    """
    parts: list[Column] = []
    held = set()
    for i, (name, desc) in enumerate(_parse(order_by)):
        value = F.col(name)
        parts.append(F.isnull(value).alias(f"_missing_{i}"))
        if desc:
            value = _reversed(value, df.schema[name].dataType)
            if value is None:
                return None
            parts.append(value.alias(f"_order_{i}"))
        else:
            parts.append(value.alias(name))
            held.add(name)
    return F.struct(*parts, *[F.col(c) for c in carry if c not in held])
