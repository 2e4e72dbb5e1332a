"""Packing documents for training: length buckets of least padding, batches within a token budget.

The lengths of all rows go into one histogram; dynamic programming over it chooses the bucket
boundaries for which padding every row to its bucket's boundary costs least. Within a bucket a batch
takes as many rows as fit the budget at the bucket's boundary. Rows are numbered without gathering a
bucket: a bucket is split into parts by a hash, each part is numbered, and the parts' sizes give the
offsets.

The histogram has a bin per length that occurs, so the boundaries are optimal. It comes to the driver:
a row per distinct length, never more than the words of the longest text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut_lineage

BUCKETS = 16
BUDGET = 32_768
_PART = 50_000  # rows of a part, on average


def word_count(text: str = "text") -> Column:
    """Words (runs without white space) of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def best_boundaries(tops: np.ndarray, rows: np.ndarray, buckets: int) -> list[int]:
    """Boundaries that minimise the summed padding of rows of the given lengths, in rising order.

    A bucket costs the rows it holds times its boundary. With one more bucket, ending at length j, the
    best start i minimises cost[i] - before[i] * tops[j]: lines in tops[j] whose slopes fall as i rises,
    so the lowest line moves on along their hull, and a round takes time in proportion to the lengths.
    """
    lengths = tops.tolist()
    n = len(lengths)
    before = [0]
    for count in rows.tolist():
        before.append(before[-1] + count)
    cost: list[int | None] = [0, *[None] * n]
    choice = []
    for _ in range(min(buckets, n)):
        after: list[int | None] = [None] * (n + 1)
        start = [0] * (n + 1)
        hull: list[int] = []
        at = 0
        for j in range(1, n + 1):
            new = cost[j - 1]
            if new is not None:
                # A line goes where those beside it are lower all along.
                while len(hull) - at >= 2:
                    a, b = hull[-2], hull[-1]
                    if (new - cost[a]) * (before[b] - before[a]) > (cost[b] - cost[a]) * (before[j - 1] - before[a]):
                        break
                    hull.pop()
                hull.append(j - 1)
            x = lengths[j - 1]
            while at + 1 < len(hull):
                a, b = hull[at], hull[at + 1]
                if cost[a] - before[a] * x < cost[b] - before[b] * x:
                    break
                at += 1
            if at < len(hull):
                i = hull[at]
                start[j], after[j] = i, cost[i] + (before[j] - before[i]) * x
        choice.append(start)
        cost = after
    out, j = [], n
    for start in reversed(choice):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = start[j]
    return sorted(out)


def boundaries(sized: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Optimal bucket boundaries for (length, copies); the last is the greatest length."""
    bins = sized.groupBy("length").agg(F.sum("copies").alias("rows"))
    found = sorted((r["length"], r["rows"]) for r in bins.collect())
    if not found:
        return []
    tops, rows = (np.array(x, dtype=np.int64) for x in zip(*found))
    return best_boundaries(tops, rows, buckets)


def pack(
    docs: DataFrame,
    length: Column | None = None,
    doc_id: str = "doc_id",
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """(doc_id, length, bucket, boundary, batch, place) of every row.

    ``length`` defaults to the words of ``text``. ``bucket`` counts from 0 by length, ``batch`` from 0
    in its bucket, ``place`` from 0 in its batch. Every batch but its bucket's last holds
    max(1, budget // boundary) rows: a row longer than the budget is a batch of its own. A null length
    counts as 0. Rows with equal id and length are interchangeable and each gets a place; a null id
    is a value like others.
    """
    length = word_count() if length is None else length
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("length"))
    # Equal rows are counted, so that a hot id is one row until the end.
    kinds = cut_lineage(rows.groupBy("doc_id", "length").agg(F.count(F.lit(1)).alias("copies")))
    bounds = boundaries(kinds, buckets)
    if not bounds:
        empty = "doc_id {}, length long, bucket int, boundary long, batch long, place int"
        return docs.sparkSession.createDataFrame([], empty.format(rows.schema["doc_id"].dataType.simpleString()))
    bucket = sum((F.when(F.col("length") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    parts = -(-kinds.count() // _PART)
    placed = kinds.withColumn("bucket", bucket.cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "length"), F.lit(parts))
    )
    sizes = placed.groupBy("bucket", "part").agg(F.sum("copies").alias("rows"))
    # One row per bucket and part, not per document.
    over = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("rows").over(over), F.lit(0))).drop("rows")
    inside = Window.partitionBy("bucket", "part").orderBy("length", "doc_id")
    numbered = placed.withColumn(
        "first", F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    ).join(offsets, ["bucket", "part"])
    boundary = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    spread = numbered.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    slot = F.col("offset") + F.col("first") + F.col("copy") - 1
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("boundary", F.lit(1)))).cast("long")
    return (
        spread.withColumn("boundary", boundary)
        .withColumn("slot", slot)
        .withColumn("capacity", capacity)
        .select(
            "doc_id", "length", "bucket", "boundary",
            F.floor(F.col("slot") / F.col("capacity")).cast("long").alias("batch"),
            (F.col("slot") % F.col("capacity")).cast("int").alias("place"),
        )
    )
