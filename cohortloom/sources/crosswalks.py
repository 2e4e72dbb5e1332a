"""Lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_crosswalk(
    spark: SparkSession, path: str, key: str, *values: str, sep: str = ","
) -> DataFrame:
    """A checked lookup from delimited text with a header."""
    raw = spark.read.csv(path, sep=sep, header=True, nullValue="NA", quote='"', escape='"')
    return crosswalk(raw.select(key, *values), key, *values)


def crosswalk(df: DataFrame, key: str, *values: str) -> DataFrame:
    """A lookup with one row per key. A repeated key fails the query that uses it: joining it would
    multiply the rows of the fact table."""
    repeated = F.raise_error(F.concat(F.lit(f"crosswalk repeats {key} "), F.col(key).cast("string")))
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(v).alias(v) for v in values])
        .select(
            key, *[F.when(F.col("_n") > 1, repeated).otherwise(F.col(v)).alias(v) for v in values]
        )
    )
