"""Document fingerprints: threshold-scaled sketches of character shingles.

A shingle is a run of ``WIDTH`` code points (a shorter text is one shingle) with a 64-bit polynomial
hash. A sketch keeps every hash below a fixed fraction (1 / ``SCALE``) of the hash range, as its upper
32 bits. Whether a hash is kept does not depend on the text it comes from, so sketches of unequal
lengths compare without bias, the sketch of a union is the union of the sketches, and a text of any
length costs ``SCALE`` times less than its shingles. A text of which no hash lies below the threshold
keeps its least one, so only an empty text has an empty sketch.

The likeness of two sketches is the containment of the smaller one: shared hashes divided by the hashes
of the smaller sketch. Two empty sketches are alike, an empty one and any other are not.

Neighbours in the order of ids meet without a window over the table: ids are cut into parts at quantiles
of themselves, each part gets the first row of the part after it as its last row, and a task streams
through the sorted rows of its parts with one row in hand. Texts are shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import added, emitted
from .words import mix

WIDTH = 12
SCALE = 16
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 18  # code points hashed at once
_ACCURACY = 10_000
_NO_ID = -(1 << 63)
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, " \
    "near_edited double, near_next double"


def _window_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width``, put together from runs of powers of two."""
    if len(points) < width:
        width = len(points)
    part, size = points, 1
    whole, done = None, 0
    while True:
        if width & size:
            count = len(points) - done - size + 1
            if whole is None:
                whole = part
            else:
                factor = np.uint64(pow(_BASE, size, 1 << 64))
                whole = whole[:count] * factor + part[done : done + count]
            done += size
        if size * 2 > width:
            return mix(whole[: len(points) - width + 1])
        factor = np.uint64(pow(_BASE, size, 1 << 64))
        part = part[:-size] * factor + part[size:]
        size *= 2


def sketch(text: str, width: int = WIDTH, scale: int = SCALE) -> np.ndarray:
    """Kept hashes of one text, distinct and sorted."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    limit = np.uint64((1 << 64) // scale - 1)
    kept, least = [], None
    for at in range(0, len(text), _PIECE):
        if at and len(text) - at < width:
            break
        piece = text[at : at + _PIECE + width - 1].encode("utf-32-le", "surrogatepass")
        hashes = _window_hashes(np.frombuffer(piece, dtype=np.uint32).astype(np.uint64) + np.uint64(1), width)
        low = hashes.min()
        least = low if least is None else min(least, low)
        kept.append(hashes[hashes <= limit])
    found = np.concatenate(kept)
    if not len(found):
        found = np.array([least], dtype=np.uint64)
    return np.unique((found >> np.uint64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller sketch in the other one."""
    small = min(len(a), len(b))
    if small == 0:
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / small


def packed(kept: np.ndarray) -> str:
    return base64.b64encode(kept.astype("<u4").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


def sketches(docs: DataFrame, text: str = "text", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``docs`` with ``sketch``, the kept hashes as sorted longs; a null text counts as empty."""

    def compute():
        def work(batch):
            texts = batch.column(text).to_pylist()
            kept = [sketch(t or "", width, scale).astype(np.int64) for t in texts]
            return [pa.array(kept, pa.list_(pa.int64()))]

        return work

    return added(docs, [T.StructField("sketch", T.ArrayType(T.LongType()))], compute)


def merged(sketched: DataFrame, *group: str) -> DataFrame:
    """(group, hash): the sketch of all texts of each group, one row per kept hash.

    Map tasks combine repeated hashes, so a group may hold any part of the rows.
    """
    return sketched.select(*group, F.explode("sketch").alias("hash")).distinct()


def coverage(sketched: DataFrame, key: str, merges: DataFrame, *group: str) -> DataFrame:
    """(key, group, shared, size, contained): how much of each text lies in each group it meets.

    ``key`` is unique per row of ``sketched``. A hash meets one row per group that holds it.
    """
    rows = sketched.select(key, F.size("sketch").alias("size"), F.explode("sketch").alias("hash"))
    met = rows.join(merges, "hash").groupBy(key, *group)
    shared = met.agg(F.count(F.lit(1)).alias("shared"), F.max("size").alias("size"))
    return shared.withColumn("contained", F.col("shared") / F.col("size"))


def _part(key: Column, cuts: list[int]) -> Column:
    """How many of the falling ``cuts`` are greater than ``key`` or equal to it, less one."""
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = F.array(*map(F.lit, cuts[::step])), F.array(*map(F.lit, cuts))
    above = F.size(F.filter(coarse, lambda c: c >= key))
    near = F.slice(fine, (above - 1) * step + 1, F.lit(step))
    return (above - 1) * step + F.size(F.filter(near, lambda c: c >= key)) - 1


def _rows(held, following) -> tuple:
    """One result row from a document in hand and the one that follows."""
    doc_id, text, kept = held
    half = len(text) // 2
    edited = text[: len(text) - half] + following[1][:half]
    other = kept if edited == text else sketch(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return (
        doc_id, len(text), digest, packed(kept), packed(other),
        likeness(kept, other), likeness(kept, following[2]),
    )


def _stream(batches) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            piece, done = batch.slice(at, 512), []
            columns = [piece.column(c).to_pylist() for c in ("doc_id", "text", "last")]
            for doc_id, text, last in zip(*columns, strict=True):
                row = (doc_id, text, sketch(text))
                if held is not None:
                    done.append(_rows(held, row))
                held = None if last else row
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names
                )


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to that and to the next text.

    The next document is the one with the next smaller id; after the smallest comes the greatest. The
    edited text has the last half of the code points (rounded down) replaced by as many from the start
    of the next text, or by all of it if it is shorter. Null texts count as empty. Null ids come last,
    rows of equal id in the order of a hash of their text, so each row has one next row. A single row is
    its own next one. An empty table gives no rows; other columns of ``docs`` play no part.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("key", F.coalesce("doc_id", F.lit(_NO_ID)))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.max("key").alias("top"), F.percentile_approx("key", shares, _ACCURACY).alias("cuts"))
    top, cuts = found.first()
    if top is None:
        return spark.createDataFrame([], _OUT)
    # Cuts are ids of rows: each is the first row of its part.
    cuts = sorted({top, *cuts}, reverse=True)
    order = F.xxhash64("text")
    ends = spark.createDataFrame(
        [(c, (i - 1) % len(cuts)) for i, c in enumerate(cuts)], "key long, part int"
    )
    first = rows.join(F.broadcast(ends), "key").groupBy("part").agg(
        F.min(F.struct(order.alias("order"), "text")).alias("first")
    )
    last = first.select(
        "part", F.lit(True).alias("last"), F.lit(None).cast("long").alias("key"),
        F.lit(None).cast("long").alias("doc_id"), F.col("first.text").alias("text"),
    )
    own = rows.select(_part(F.col("key"), cuts).alias("part"), F.lit(False).alias("last"), "key", "doc_id", "text")
    lined = (
        own.unionAll(last)
        .repartition("part")
        .sortWithinPartitions("part", "last", F.desc("key"), F.xxhash64("text"), "text", F.col("doc_id").isNull())
    )
    return emitted(lined.select("doc_id", "text", "last"), _OUT, _stream)
