"""Tables laid out by entity, so that joins and rollups per entity need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_by_entity(
    df: DataFrame, table: str, key: str, buckets: int, by: str | None = None, path: str | None = None
) -> DataFrame:
    """Save as a Parquet table in buckets by ``key``, in folders by ``by``; returns the table.

    Tables with as many buckets of the same key join, and group by it, without an exchange; a filter on
    ``by`` reads its folders alone. Rows go to the tasks by key, where a task with a hot key is split, so
    that few tasks write to a bucket. An existing table is replaced; ``path`` puts its files elsewhere
    than the warehouse. Keys should not be missing: a null-safe join cannot use the buckets.
    """
    dealt = df.hint("rebalance", buckets, key)
    writer = dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if by is not None:
        writer = writer.partitionBy(by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)
