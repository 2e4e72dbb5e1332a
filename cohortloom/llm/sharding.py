"""Shards of near equal bytes by sampled splitters.

Records are ordered by the hash of their text, then by a hash of their id, so equal texts are
neighbours. A sample drawn with probability in proportion to size gives splitters at its quantiles. A
text so heavy that it would overfill a range is split further by ids. The exact sizes of the ranges
(one row each) then turn places inside a range into places in the whole order, and a shard is an
equal part of all bytes.

A group of equal texts is never torn apart unless it weighs over ``WHOLE`` of a shard: it goes where
its middle byte falls. Heavier groups are dealt record by record. So shard sizes differ from equal
parts by at most about that fraction, or by one record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import added, cut_lineage

SHARDS = 8
WHOLE = 0.002
_RANGE_ROWS = 50_000  # rows of a range, on average
_LEAST_RANGES = 64
_DRAWS = 8  # sampled records per range


def splitters(drawn: list[tuple[int, int]], ranges: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Boundaries from sampled (key, second key) pairs.

    Returns the sorted first keys of all boundaries, and for keys that are split further their second
    keys. A boundary inside a key that is not heavy is moved to the key's start.
    """
    drawn = sorted(drawn)
    step = max(1, len(drawn) // ranges)
    keys = np.array([k for k, _ in drawn], dtype=np.int64)
    values, counts = np.unique(keys, return_counts=True)
    heavy = set(values[counts >= max(2 * step, 4)].tolist())
    cuts = sorted({(k, s if k in heavy else -(1 << 63)) for k, s in drawn[step::step]})
    inside: dict[int, list[int]] = {}
    for k, s in cuts:
        if k in heavy:
            inside.setdefault(k, []).append(s)
    firsts = np.array([k for k, _ in cuts], dtype=np.int64)
    return firsts, {k: np.array(v, dtype=np.int64) for k, v in inside.items()}


def _range_of(firsts: np.ndarray, inside: dict[int, np.ndarray]):
    def compute():
        def work(batch):
            key, second = (batch.column(c).to_numpy() for c in ("key", "second"))
            place = np.searchsorted(firsts, key, side="right")
            for k, cuts in inside.items():  # heavy keys: at most half the ranges
                rows = np.flatnonzero(key == k)
                place[rows] -= len(cuts) - np.searchsorted(cuts, second[rows], side="right")
            split = np.isin(key, np.array(list(inside), dtype=np.int64))
            return [pa.array(place.astype(np.int32)), pa.array(split)]

        return work

    return compute


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, with the columns ``carry``.

    ``size`` is the UTF-8 bytes of the text plus 1, and 1 for a null text, whose checksum is null.
    ``slot`` numbers a shard's rows from 0 without gaps. Equal rows are interchangeable and each gets
    a slot; ids may be null or repeated.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text)).alias("text_crc32"),
        F.xxhash64(F.col(text).isNull(), F.col(text)).alias("key"),
        *[F.col(c) for c in carry],
    )
    names = rows.columns
    # Equal rows are counted until the end, so that they are no hot key.
    kinds = cut_lineage(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("copies")))
    kinds = kinds.withColumn("second", F.xxhash64("doc_id", "size", F.lit(1))).withColumn(
        "weight", F.col("size") * F.col("copies")
    )
    whole = kinds.agg(F.sum("weight").alias("bytes"), F.sum("copies").alias("rows")).first()
    if not whole["rows"]:
        out = kinds.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
        return out.select("doc_id", "size", "text_crc32", "shard", "slot", *carry)
    ranges = max(_LEAST_RANGES, -(-whole["rows"] // _RANGE_ROWS))
    rate = ranges * _DRAWS / whole["bytes"]
    chance = F.pmod(F.xxhash64("key", "doc_id", "size", F.lit(2)), F.lit(1 << 31)) / (1 << 31)
    sample = kinds.filter(chance < F.col("weight") * rate).select("key", "second")
    drawn = [tuple(r) for r in sample.collect()]  # about _DRAWS per range, whatever the rows weigh
    cuts = _range_of(*splitters(drawn, ranges))
    fields = [T.StructField("range", T.IntegerType()), T.StructField("split", T.BooleanType())]
    placed = added(kinds, fields, cuts)

    sizes = placed.groupBy("range").agg(F.sum("weight").alias("w"), F.sum("copies").alias("n")).collect()
    offsets, bytes_, rows_ = [], 0, 0
    for r in sorted(sizes, key=lambda r: r["range"]):
        offsets.append((r["range"], bytes_, rows_))
        bytes_, rows_ = bytes_ + r["w"], rows_ + r["n"]
    starts = docs.sparkSession.createDataFrame(offsets, "range int, byte_start long, row_start long")
    order = Window.partitionBy("range").orderBy("key", "second", "doc_id", "size", *carry)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    before = placed.select(
        "*",
        (F.sum("weight").over(upto) - F.col("weight")).alias("bytes_before"),
        (F.sum("copies").over(upto) - F.col("copies")).alias("rows_before"),
        F.sum("weight").over(group).alias("group_end"),
    )
    same = Window.partitionBy("range", "key")
    before = before.withColumn("group_weight", F.sum("weight").over(same))
    total = whole["bytes"]
    together = ~F.col("split") & (F.col("group_weight") <= WHOLE * total / shards)
    numbered = (
        before.join(F.broadcast(starts), "range")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("row", F.col("row_start") + F.col("rows_before") + F.col("copy"))
        .withColumn("own", 2 * (F.col("bytes_before") + F.col("copy") * F.col("size")) + F.col("size"))
        .withColumn("shared", 2 * F.col("group_end") - F.col("group_weight"))
        .withColumn("middle", 2 * F.col("byte_start") + F.when(together, F.col("shared")).otherwise(F.col("own")))
        .withColumn(
            "shard",
            F.least(F.lit(shards - 1), F.expr(f"cast(middle * {shards}bd / {2 * total}bd as int)")),
        )
        .select("doc_id", "size", "text_crc32", "shard", "row", *carry)
    )
    numbered = cut_lineage(numbered)
    firsts = numbered.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard
    slotted = numbered.join(F.broadcast(firsts), "shard")
    return slotted.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"), *carry
    )
