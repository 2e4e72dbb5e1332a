"""Exact top-k by inner product with a table of distances to pivots.

With integer vectors, q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, and by the triangle inequality |q - x| is
at least the difference of their distances to any pivot. The greatest such difference over many
pivots bounds the score from above. A query takes its candidates in the order of these bounds and
stops as soon as no bound left can reach its k-th best score.

Queries and candidates meet in cells: a block of candidates and a block of queries, both of bounded
size. A cell returns at most k candidates per query, and the cells' results are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import added, cut_lineage
from .integers import best, exact_scores, matrix, whole

TOP = 5
PIVOTS = 32
_SAMPLE = 2048  # vectors from which the pivots are taken
CANDIDATES = 16_384  # of a cell
QUERIES = 2_048
_STEP = 256


def farthest_first(vectors: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is farthest from those before it."""
    if not len(vectors):
        return vectors
    chosen = [0]
    nearest = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(vectors)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
    return vectors[chosen]


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    wide = max(vectors.shape[1], pivots.shape[1])
    v, p = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))).astype(np.float64) for m in (vectors, pivots))
    squares = (v * v).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * v @ p.T
    return np.sqrt(np.maximum(squares, 0))


def top_of_cell(
    ids: np.ndarray, vectors: np.ndarray, distances: np.ndarray,
    query_ids: np.ndarray, queries: np.ndarray, query_distances: np.ndarray, k: int,
) -> tuple[list[np.ndarray], int]:
    """Per query the rows and scores of its k best candidates; and how many scores were computed."""
    squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
    found, computed = [], 0
    for q, own, near in zip(queries, query_ids, query_distances):
        gap = np.abs(distances - near).max(axis=1) if distances.shape[1] else np.zeros(len(ids))
        square = float((q.astype(np.float64) ** 2).sum())
        # Distances are rounded: what they may be off by goes on top of the bound.
        slack = 1 + 1e-9 * (squares + square)
        off = 1e-6 * (1 + gap + np.sqrt(squares) + distances.max(axis=1, initial=0.0) + near.max(initial=0.0))
        bound = (squares + square - np.maximum(gap - off, 0) ** 2) / 2 + slack
        bound = np.nan_to_num(bound, nan=np.inf, posinf=np.inf)
        bound[ids == own] = -np.inf
        order = np.argsort(-bound)
        rows = np.empty(0, dtype=np.int64)
        scores = np.empty(0)
        for at in range(0, len(order), _STEP):
            step = order[at : at + _STEP]
            if bound[step[0]] == -np.inf or (len(rows) == k and bound[step[0]] < scores[-1]):
                break
            step = step[bound[step] > -np.inf]
            computed += len(step)
            rows = np.concatenate([rows, step])
            scores = np.concatenate([scores, exact_scores(vectors[step], q)])
            first = best(ids[rows], scores, k)
            rows, scores = rows[first], scores[first]
        found.append((rows, scores))
    return found, computed


def _cell(k: int):
    def search(table: pa.Table) -> pa.Table:
        is_query = table["is_query"].to_numpy()
        sides = []
        for side in (table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))):
            sides.append((side["vec_id"].to_numpy(), matrix(side["vector"]), side["far"].to_pylist()))
        (query_ids, queries, query_far), (ids, vectors, far) = sides
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(query_ids) and len(ids):
            wide = max(queries.shape[1], vectors.shape[1])
            queries, vectors = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (queries, vectors))
            found, _ = top_of_cell(
                ids, vectors, np.array(far, dtype=np.float64), query_ids, queries,
                np.array(query_far, dtype=np.float64), k,
            )
            for own, (rows, scores) in zip(query_ids.tolist(), found):
                out["query_id"] += [own] * len(rows)
                out["vec_id"] += ids[rows].tolist()
                out["score"] += [int(s) for s in scores]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return search


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = TOP,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    factor: int = 256,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest scores of every query.

    ``is_query`` is an expression of ``vec_id``. Candidates are all rows with another id; ties go to
    the smaller id. Vectors that are null, or hold a component that is null or not finite, take no part,
    nor do rows without an id. A score among the k that a long cannot hold is an error. Rows with equal id and vector count
    once; of rows that repeat an id with other vectors each is a candidate, and the queries of one id
    share one list. A shorter vector counts as filled up with zeros.
    """
    rows = (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole(F.col(vector), factor).alias("vector"))
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .distinct()
    )
    rows = cut_lineage(rows)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(_SAMPLE).select("vector").toArrow()
    chosen = farthest_first(matrix(sample["vector"]), pivots)

    def compute():
        def work(batch):
            far = _distances(matrix(batch.column("vector")), chosen)
            return [pa.array(list(far), pa.list_(pa.float64()))]

        return work

    table = added(rows, [T.StructField("far", T.ArrayType(T.DoubleType()))], compute)
    table = cut_lineage(table.withColumn("query", F.coalesce(is_query, F.lit(False))))
    size = table.agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("q")).first()
    blocks = max(1, -(-size["n"] // CANDIDATES))
    groups = max(1, -(-size["q"] // QUERIES))
    hashed = F.xxhash64("vec_id", "vector")
    # Each query visits every block of candidates, each candidate every block of queries.
    asked = table.filter("query").select(
        "vec_id", "vector", "far", F.lit(True).alias("is_query"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(hashed, F.lit(groups)).cast("int").alias("group"),
    )
    offered = table.select(
        "vec_id", "vector", "far", F.lit(False).alias("is_query"),
        F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
    )
    near = (
        asked.unionAll(offered)
        .groupBy("block", "group")
        .applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
