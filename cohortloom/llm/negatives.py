"""Hard negatives: a threshold join over an inverted index, with thresholds that fall until windows fill.

An anchor's positives are its best rows of the same label. Each positive gives a window of scores, a
share of its own score wide, in which the best rows of other labels are its hard negatives.

Both come from the same join, as L2AP does it for one threshold. Dimensions are put in order of their
weight. A row is indexed from the first dimension at which the norm of what lies before it, times the
greatest query norm, could reach the threshold; the dimensions before that are left out of the index
and kept aside, since a row that meets a query only there cannot reach the threshold. A query walks
the inverted lists from the last dimension to the first and adds up partial scores; rows whose partial
score and remaining norms (of the row and of the query) cannot reach the threshold drop out. What is
left gets its exact score from the dimensions kept aside. All rows at or above the threshold are then
known; where that fills no window, the threshold falls, down to the lower end of the window.

Anchors and rows meet in cells, blocks of bounded size of both, so no task holds a label, an anchor's
candidates or the table. A cell returns at most the asked number of rows per window.

Scores are exact: sums of products of integers below 2**53 in size are taken in doubles, greater ones
in Python's integers. A score that a result names and that a long cannot hold is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut_lineage
from .integers import best, exact_scores, matrix, whole

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # a negative's least and greatest score, in percent of the positive's
ROWS = 16_384  # of a cell
ANCHORS = 512
_STEPS = 8  # thresholds between the ends of a window
_LIST_STEP = 8  # dimensions between two prunings


class Block:
    """Rows of one cell, indexed anew for each threshold."""

    def __init__(self, vectors: np.ndarray):
        order = np.argsort(-(vectors * vectors).sum(axis=0), kind="stable")
        self.order = order
        self.vectors = np.ascontiguousarray(vectors[:, order])
        squares = np.cumsum(self.vectors * self.vectors, axis=1)
        # Norm of the dimensions before each one, and of all.
        self.before = np.sqrt(np.concatenate([np.zeros((len(vectors), 1)), squares], axis=1))
        # Exact scores computed, of pairs asked for; index entries, of components held.
        self.scored = self.asked = self.listed = self.held = 0

    def search(self, queries: np.ndarray, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the rows whose score is ``least`` or more, and the scores."""
        queries = queries[:, self.order]
        wide = queries.shape[1]
        squares = np.cumsum(queries * queries, axis=1)
        ahead = np.sqrt(np.concatenate([np.zeros((len(queries), 1)), squares], axis=1))
        largest = ahead[:, -1].max(initial=0.0)
        # Sums of rounded products: what they may be off by goes on top of every bound.
        slack = 1e-12 * (1 + wide) * (1 + largest * self.before[:, -1].max(initial=0.0))
        floor = least.min() - slack
        # The first indexed dimension of each row: what lies before it cannot reach the threshold.
        start = np.zeros(len(self.vectors), dtype=int)
        lists = self.vectors
        if floor > 0:
            start = np.maximum((self.before * largest < floor).sum(axis=1) - 1, 0)
            lists = np.where(np.arange(wide) >= start[:, None], self.vectors, 0.0)
        self.listed += int((wide - start).sum())
        self.held += wide * len(start)
        found = []
        for q, near, low in zip(queries, ahead, least - slack):
            alive = np.arange(len(start))
            partial = np.zeros(len(start))
            for stop in range(wide, 0, -_LIST_STEP):
                first = max(0, stop - _LIST_STEP)
                some = lists[:, first:stop] if len(alive) == len(start) else lists[alive, first:stop]
                partial = partial + some @ q[first:stop]
                # What may still come: the lists before, and the dimensions kept aside.
                open_to = np.maximum(first, start[alive])
                rest = np.nan_to_num(self.before[alive, open_to] * near[open_to], nan=np.inf, posinf=np.inf)
                keep = partial + rest >= low
                if not keep.all():
                    alive, partial = alive[keep], partial[keep]
                if not len(alive):
                    break
            self.scored += len(alive)
            found.append((alive, exact_scores(self.vectors[alive], q)))
        self.asked += len(queries) * len(start)
        return found


def falling(block: Block, queries: np.ndarray, top: np.ndarray, low: np.ndarray, done: Callable) -> list[tuple]:
    """Per query the rows and scores of a threshold join.

    Its threshold falls from ``top`` to ``low`` until ``done(query number, threshold, rows, scores)``.
    """
    found: list[tuple] = [()] * len(queries)
    open_queries = np.arange(len(queries))
    for step in range(1, _STEPS + 1):
        if not len(open_queries):
            break
        high, end = top[open_queries], low[open_queries]
        least = end if step == _STEPS else high - (high - end) * step / _STEPS
        left = []
        for i, at, (rows, scores) in zip(open_queries, least, block.search(queries[open_queries], least)):
            reached = np.asarray(scores >= at, dtype=bool)
            found[i] = rows[reached], scores[reached]
            if at > low[i] and not done(i, at, *found[i]):
                left.append(i)
        open_queries = np.array(left, dtype=int)
    return found


def positives_of(ids, labels, vectors, anchors, count: int) -> tuple[list[tuple], list[Block]]:
    """(anchor row, its id, row id, score) of the best rows of an anchor's label in one cell.

    ``anchors``: (anchor row, its id, label, query).
    """
    out, blocks = [], []
    for label in {a[2] for a in anchors}:
        same = np.flatnonzero(labels == label)
        mine = [a for a in anchors if a[2] == label]
        if not len(same):
            continue
        block, own = Block(vectors[same]), ids[same]
        queries = np.array([a[3] for a in mine])
        top = np.sqrt((queries * queries).sum(axis=1)) * block.before[:, -1].max()

        def enough(i, least, rows, scores):
            return (own[rows] != mine[i][1]).sum() >= count

        for (key, anchor, *_), (rows, scores) in zip(mine, falling(block, queries, top, -top, enough)):
            others = own[rows] != anchor
            rows, scores = rows[others], scores[others]
            for i in best(own[rows], scores, count):
                out.append((key, anchor, int(own[rows[i]]), int(scores[i])))
        blocks.append(block)
    return out, blocks


def negatives_of(ids, labels, vectors, anchors, count: int) -> tuple[list[tuple], list[Block]]:
    """(anchor row, its id, positive id, row id, positive score, score): the best rows of each window.

    ``anchors``: (anchor row, its id, label, query, [(positive id, positive score)]).
    """
    block, out = Block(vectors), []
    asked = []
    for key, anchor, label, query, positives in anchors:
        windows = [(p, s, -(-LOW * s // 100), HIGH * s // 100) for p, s in positives]
        windows = [w for w in windows if w[2] <= w[3]]
        if windows:
            asked.append(((key, anchor), (labels != label) & (ids != anchor), query, windows))
    if not asked:
        return out, [block]

    def filled(i, least, rows, scores):
        _, other, _, windows = asked[i]
        scores = scores[other[rows]]
        return all(
            least <= low or np.asarray(scores <= high, dtype=bool).sum() >= count for _, _, low, high in windows
        )

    queries = np.array([a[2] for a in asked])
    top = np.array([float(max(w[3] for w in a[3])) for a in asked])
    low = np.array([float(min(w[2] for w in a[3])) for a in asked])
    for (anchor, other, _, windows), (rows, scores) in zip(asked, falling(block, queries, top, low, filled)):
        rest = other[rows]
        rows, scores = rows[rest], scores[rest]
        for positive, score, least, most in windows:
            inside = np.asarray((scores >= least) & (scores <= most), dtype=bool)
            mine, its = rows[inside], scores[inside]
            for i in best(ids[mine], its, count):
                out.append((*anchor, positive, int(ids[mine[i]]), score, int(its[i])))
    return out, [block]


def _cell(columns: list[str], work: Callable, count: int):
    """A function of one cell: its rows and its anchors, told apart by ``is_anchor``."""

    def search(table: pa.Table) -> pa.Table:
        is_anchor = table["is_anchor"].combine_chunks()
        asked, rows = table.filter(is_anchor), table.filter(pa.compute.invert(is_anchor))
        found = []
        if asked.num_rows and rows.num_rows:
            queries, vectors = matrix(asked["vector"]), matrix(rows["vector"])
            wide = max(queries.shape[1], vectors.shape[1])
            queries, vectors = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (queries, vectors))
            named = [asked[c].to_pylist() for c in ("row", "vec_id", "label")]
            anchors = list(zip(*named, queries))
            if "positives" in asked.column_names:
                pairs = [[(p["positive_id"], p["positive_score"]) for p in x] for x in asked["positives"].to_pylist()]
                anchors = [(*a, p) for a, p in zip(anchors, pairs)]
            found, _ = work(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), vectors, anchors, count)
        values = list(zip(*found)) or [()] * len(columns)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(columns, values)})

    return search


def _in_cells(rows: DataFrame, asked: DataFrame, sizes, extra: list[str]) -> DataFrame:
    """Every anchor with every block of rows, every row with every block of anchors."""
    blocks = max(1, -(-sizes["rows"] // ROWS))
    groups = max(1, -(-sizes["anchors"] // ANCHORS))
    hashed = F.xxhash64("vec_id", "vector")
    asked = asked.select(
        "row", "vec_id", "label", "vector", *extra, F.lit(True).alias("is_anchor"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(hashed, F.lit(groups)).cast("int").alias("group"),
    )
    rows = rows.select(
        F.lit(None).cast("long").alias("row"), "vec_id", "label", "vector",
        *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in extra],
        F.lit(False).alias("is_anchor"),
        F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
    )
    return asked.unionAll(rows).groupBy("block", "group")


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    factor: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is an expression of ``vec_id``, ``label`` of any integer type. Rows without an id or
    label, and rows whose vector is null or holds a component that is null or not finite, take no part.
    Equal rows count once; other rows that share an id are rows and anchors of their own, but never
    positives or negatives of an anchor of their id; positives of equal id and score count once. A shorter vector counts as filled up with zeros. Ties go to the
    smaller id. An anchor without positives, or whose windows hold no row, has no result rows.
    """
    rows = cut_lineage(
        vectors.select(
            F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
            whole(F.col(vector), factor).alias("vector"),
        )
        .na.drop("any")
        .distinct()
    )
    asked = rows.filter(F.coalesce(is_anchor, F.lit(False))).withColumn("row", F.xxhash64(*rows.columns))
    sizes = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(is_anchor, F.lit(False))).alias("anchors")
    ).first()

    near = _in_cells(rows, asked, sizes, []).applyInArrow(
        _cell(["row", "anchor_id", "positive_id", "positive_score"], positives_of, positives),
        "row long, anchor_id long, positive_id long, positive_score long",
    )
    best = Window.partitionBy("anchor_id", "row").orderBy(F.desc("positive_score"), "positive_id")
    chosen = near.distinct().withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= positives)
    listed = cut_lineage(
        chosen.groupBy(F.col("anchor_id").alias("_of"), F.col("row").alias("_row")).agg(
            F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")
        )
    )
    with_positives = asked.join(listed, (F.col("vec_id") == F.col("_of")) & (F.col("row") == F.col("_row")))
    columns = ["row", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    hard = _in_cells(rows, with_positives, sizes, ["positives"]).applyInArrow(
        _cell(columns, negatives_of, negatives), ", ".join(f"{c} long" for c in columns)
    )
    order = Window.partitionBy("anchor_id", "row", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS row_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, row_id AS negative_id,
       positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id)
QUALIFY row_number() OVER w <= 10
"""
