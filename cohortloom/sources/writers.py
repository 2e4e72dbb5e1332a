"""Delimited export."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import TEXT, typed

_MANIFEST = "parts string, part string, rows long, columns array<string>, kinds array<string>"


def _texts(df: DataFrame) -> list[Column]:
    """Values as the readers expect them: dates in their pattern."""
    return [
        F.date_format(name, "dd-MMM-yyyy").alias(name) if kind == "date" else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ]


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Write delimited text with a header, one part file per task; missing values as NA."""
    df.write.mode(mode).csv(path, sep=sep, header=True, **TEXT)


def to_lines(df: DataFrame, sep: str = ",") -> DataFrame:
    """The same rows as text in a column ``line``; dates in the pattern that the readers expect."""
    return df.select(F.to_csv(F.struct(*_texts(df)), {"sep": sep, **TEXT}).alias("line"))


def write_lines(lines: DataFrame, path: str, header: str, line: str = "line") -> None:
    """Write lines as they are, but for empty ones, each part file under the header line.

    An existing folder is replaced.
    """
    # No character of a line has a meaning.
    plain = {"sep": "\u0001", "quote": "\u0000", "escape": "\u0000", "comment": "\u0002", "emptyValue": ""}
    as_is = dict.fromkeys(("escapeQuotes", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"), False)
    named = lines.select(F.col(line).alias(header))
    named.write.mode("overwrite").options(header=True, **plain, **as_is).csv(path)


def _read_parts(spark: SparkSession, path: str, columns: list[str], sep: str) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, sep=sep, header=True, multiLine=True, **TEXT)


def _manifest(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifest").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def export_delimited(df: DataFrame, path: str, sep: str = ",") -> DataFrame:
    """Export once: delimited part files and a manifest of them; returns the manifest.

    Parts go to a folder named by the rows' digest. The manifest names that folder, its columns and the
    rows of each part, as counted by reading the parts again, and is written last: readers see the old
    export or the whole new one, a write that broke off has no manifest, and exporting equal rows again
    finds the manifest and writes nothing. A count that differs from the rows given is an error.
    """
    spark = df.sparkSession
    texts = df.select(*_texts(df))
    found = texts.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(F.to_csv(F.struct(*texts.columns))).cast("decimal(38,0)")).alias("digest"),
    ).first()
    kinds = [kind for _, kind in df.dtypes]
    key = hashlib.md5(repr((sep, df.dtypes, found["n"], str(found["digest"]))).encode()).hexdigest()
    parts = f"parts-{key}"
    held = _manifest(spark, path)
    if not held or held[0]["parts"] != parts:
        texts.write.mode("overwrite").csv(f"{path}/{parts}", sep=sep, header=True, **TEXT)
        back = _read_parts(spark, f"{path}/{parts}", df.columns, sep)
        counts = back.groupBy(F.col("_metadata.file_name").alias("part")).count().collect()
        written = sum(r["count"] for r in counts)
        if written != found["n"]:
            raise ValueError(f"{written} rows written of {found['n']}")
        # The row without a part stands for the whole, so that an export of no rows has a manifest too.
        listed = [(None, written), *((r["part"], r["count"]) for r in counts)]
        rows = [(parts, part, n, df.columns, kinds) for part, n in listed]
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(_MANIFEST).json(f"{path}/manifest")


def read_export(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The rows of an export, in the types they had. Parts must be those of its manifest."""
    held = _manifest(spark, path)
    if not held:
        raise ValueError(f"no complete export in {path}")
    first = held[0]
    raw = _read_parts(spark, f"{path}/{first['parts']}", first["columns"], sep)
    counts = raw.groupBy(F.col("_metadata.file_name").alias("part")).count().collect()
    expected = {r["part"]: r["rows"] for r in held if r["part"] is not None}
    present = {r["part"]: r["count"] for r in counts}
    if present != expected:
        wrong = sorted(p for p in {*present, *expected} if present.get(p) != expected.get(p))
        raise ValueError(f"parts differ from the manifest: {wrong}")
    return typed(raw, tuple((c, c, k) for c, k in zip(first["columns"], first["kinds"], strict=True)))
