"""Picking rows: first and last per entity, top k, positional ranges, group maxima."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import left_join
from .ordering import sort_columns, sort_key


def first_row(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The first row of each key in the given order; the other columns settle ties, in their order.

    A minimum over (order, columns) rather than a ranked window: every map task already reduces each
    key to one candidate, so an entity with a third of all rows never gathers in one task. Name the
    ``columns`` needed later, so that the others are not read.
    """
    keys = list(keys)
    payload = [c for c in (columns or df.columns) if c not in keys]
    if not payload:
        return df.select(*keys).distinct()
    row = sort_key(df, order_by, carry=payload)
    if row is None:  # descending text has no such minimum
        return top_k(df, 1, [*order_by, *payload], within=keys).select(*keys, *payload)
    picked = df.groupBy(*keys).agg(F.min(row).alias("_first"))
    return picked.select(*keys, *[F.col("_first")[c].alias(c) for c in payload])


def first_event(df, entity, when, tie_break=(), columns=None) -> DataFrame:
    """Earliest event per entity; an undated event counts only when nothing else exists."""
    return first_row(df, [entity], [when, *tie_break], columns)


def last_event(df, entity, when, tie_break=(), columns=None) -> DataFrame:
    """Latest event per entity; an undated event counts only when nothing else exists."""
    return first_row(df, [entity], ["-" + when, *tie_break], columns)


def top_k(
    df: DataFrame, k: int, order_by: Sequence[str], within: Sequence[str] = ()
) -> DataFrame:
    """First k rows overall, or within each group.

    Overall this is one bounded heap per task. Within groups the rank filter becomes a group limit
    before the shuffle, so each task sends at most k rows per group.
    """
    if not within:
        return df.orderBy(*sort_columns(order_by)).limit(k)
    w = Window.partitionBy(*within).orderBy(*sort_columns(order_by))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def slice_range(df: DataFrame, order_by: Sequence[str], lo: int, hi: int) -> DataFrame:
    """Rows lo..hi (1-based, inclusive) of the sorted frame; a bounded heap of hi rows per task."""
    return df.orderBy(*sort_columns(order_by)).offset(lo - 1).limit(hi - lo + 1)


def with_sort_rank(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Explicit plot order (1, 2, ...) of all rows.

    The rows are range-partitioned on the order and numbered inside their partition; the partitions'
    sizes give the offsets, so no task sees all rows. The partitioning is checkpointed, as both steps
    must see the same one.
    """
    columns = sort_columns(order_by)
    parts = cut_lineage(
        df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id())
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = parts.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*columns))
    ranked = parts.withColumn("_rn", inside).join(offsets, "_part")
    return ranked.select(*df.columns, (F.col("_before") + F.col("_rn")).alias("sort_rank"))


def is_duplicate(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    name: str = "is_duplicate",
    null_safe: bool = True,
) -> DataFrame:
    """Flag every row after the first of its key, over the whole frame.

    The order must be unique within a key. The first position of each key is aggregated and joined
    back, which lets a hot key be split; a ranked window would sort it in one task.
    """
    keys = list(keys)
    key = sort_key(df, order_by)
    if key is None:
        raise ValueError("descending text is not supported here")
    firsts = df.groupBy(*keys).agg(F.min(key).alias("_first_key"))
    marked = left_join(df.withColumn("_key", key), firsts, keys, null_safe)
    return marked.withColumn(name, F.col("_key") > F.col("_first_key")).drop("_key", "_first_key")


def with_group_max(
    df: DataFrame, keys: Sequence[str], value: str, name: str, null_safe: bool = True
) -> DataFrame:
    """Every row with the maximum of its group.

    Aggregate and join back: the aggregate combines before its shuffle and the join may split a hot
    key, while a window would hold all rows of the key in one task.
    """
    keys = list(keys)
    return left_join(df, df.groupBy(*keys).agg(F.max(value).alias(name)), keys, null_safe)

