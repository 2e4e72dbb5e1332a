"""Connected components: union-find inside the partitions, then alternating stars between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut_lineage, emitted

_CHUNK = 500_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node that each is joined with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist()):
        x, y = root(x), root(y)
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    return nodes, nodes[[root(x) for x in range(len(nodes))]]


def _forest(batches):
    """Edges of a partition replaced by one edge from each node to its root, chunk by chunk."""

    def out(parts):
        nodes, roots = union_find(*(np.concatenate(x) for x in zip(*parts)))
        other = nodes != roots
        arrays = [pa.array(nodes[other]), pa.array(roots[other])]
        return pa.RecordBatch.from_arrays(arrays, ["u", "v"])

    parts, size = [], 0
    for batch in batches:
        parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= _CHUNK:
            yield out(parts)
            parts, size = [], 0
    if parts:
        yield out(parts)


def _stars(tree: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child: then each star is a component."""
    ends = tree.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionAll(
        tree.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    roles = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return roles.filter("child > 1 or child = 1 and parent = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the edges; the root is the smallest node of its component.

    Each round hangs a node's larger neighbours under its smallest one, then the smaller ones too, and
    the rounds end when only stars are left. A node's neighbours are never gathered: minima are
    aggregated and joined back. Rounds are cut from each other by a checkpoint.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    tree = cut_lineage(emitted(pairs.filter("u <> v"), "u long, v long", _forest).distinct())
    while not _stars(tree):
        # Large star: every larger neighbour of u goes under the smallest of u and its neighbours.
        both = tree.unionAll(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: the smaller neighbours of u, and u, go under the smallest of them.
        large = large.filter("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = small.unionAll(least.select("u", F.col("m").alias("v"))).filter("u > v")
        tree = cut_lineage(hung.distinct())
    roots = tree.select("v").distinct()
    return tree.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
