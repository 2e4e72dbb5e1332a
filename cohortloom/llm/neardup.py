"""Near-duplicates by SuperMinHash signatures, banding, verification on full sets and union-find.

A document's set holds the hashes of its distinct word shingles. SuperMinHash gives every element a
pseudo-random permutation of the signature's places: in step j the element offers the value j + r,
0 <= r < 1, to its j-th place. A document stops as soon as no later step can lower one of its places.

Documents with equal sets form a class and are one node from there on. Nodes that agree in a band of
places are candidates. With 32 bands of 4 places, a pair of similarity 0.8 is missed with probability
5e-8. Inside a band's bucket every node is first compared with one node, and the pairs that may reach
the threshold are verified on their sets. Where these links leave a bucket in several components, the
pairs across them are looked at in blocks of bounded size: signatures first, which puts nodes that
may be linked into clusters, then the full sets of a cluster, block against block, by counting common
shingles as a product of matrices. A block returns no pairs but a spanning forest of its links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .among import maybe_among
from .components import components, union_find
from .frames import added, cut_lineage, settle
from .words import hashed_texts, mix, rolling

PLACES = 128
BANDS = 32
WIDTH = 5
SIMILARITY = 80  # percent
_BLOCK = 1024  # texts of a block
_SHINGLES = 1_000_000  # of a block, about
_SKETCHES = 4096  # signatures of a block
# Six standard deviations of a signature's agreement at the threshold.
_SLACK = 6


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of a text, sorted; a text of fewer words is one shingle."""
    if not len(hashes):
        return hashes
    if len(hashes) < width:
        factor = np.uint64(0xD6E8FEB86659FD93)
        return mix(np.array([len(hashes)], np.uint64) * factor + rolling(hashes, len(hashes)))
    return np.unique(rolling(hashes, width))


def super_minhash(elements: np.ndarray, owner: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """Signatures of ``n`` sets given as distinct elements and the set each belongs to.

    A value is step * 2**32 + 32 random bits; places that no element reached cannot occur, as an empty
    set has no signature.
    """
    low = np.full(n * places, np.iinfo(np.uint64).max, dtype=np.uint64)
    order = None
    for step in range(places):
        drawn = mix(elements + np.uint64((2 * step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        value = np.uint64(step << 32) | (drawn >> np.uint64(32))
        left = np.uint64(places - step)
        pick = step + (((drawn & np.uint64(0xFFFFFFFF)) * left) >> np.uint64(32)).astype(np.int64)
        if order is None:
            place = pick
        else:
            rows = np.arange(len(order))
            place = order[rows, pick]
            order[rows, pick] = order[:, step]
        np.minimum.at(low, owner * places + place, value)
        worst = low.reshape(n, places).max(axis=1)
        active = (worst >= np.uint64((step + 1) << 32))[owner]
        if not active.any():
            break
        if order is None:
            order = np.tile(np.arange(places, dtype=np.uint8), (int(active.sum()), 1))
            first = pick[active]
            order[np.arange(len(order)), first] = 0
        elif not active.all():
            order = order[active]
        if not active.all():
            elements, owner = elements[active], owner[active]
    return low.reshape(n, places)


def _signed(batch_texts: pa.Array, width: int):
    """Per text: set size, digest of the set, band keys, one byte of every place."""
    n = len(batch_texts)
    sizes = np.zeros(n, dtype=np.int64)
    digests: list[bytes | None] = [None] * n
    bands: list[list[int] | None] = [None] * n
    sketches: list[bytes | None] = [None] * n
    per_band = PLACES // BANDS
    salt = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(11))
    for row, stop, hashes, offsets in hashed_texts(batch_texts, lower=True):
        sets = [shingles(hashes[a:b], width) for a, b in zip(offsets[:-1], offsets[1:])]
        full = [i for i, s in enumerate(sets) if len(s)]
        if not full:
            continue
        owner = np.repeat(np.arange(len(full)), [len(sets[i]) for i in full])
        low = super_minhash(np.concatenate([sets[i] for i in full]), owner, len(full))
        keys = np.zeros((len(full), BANDS), dtype=np.uint64)
        for k in range(per_band):
            keys = mix(keys + low[:, k::per_band] + salt)
        small = (low & np.uint64(0xFF)).astype(np.uint8)
        for at, i in enumerate(full):
            sizes[row + i] = len(sets[i])
            digests[row + i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            bands[row + i] = keys[at].view(np.int64).tolist()
            sketches[row + i] = small[at].tobytes()
    return [
        pa.array(sizes),
        pa.array(digests, pa.binary()),
        pa.array(bands, pa.list_(pa.int64())),
        pa.array(sketches, pa.binary()),
    ]


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The shingle sets of a column of texts."""
    return [
        shingles(hashes[a:b], width)
        for _, _, hashes, offsets in hashed_texts(column, lower=True)
        for a, b in zip(offsets[:-1], offsets[1:])
    ]


def _reach(left: pa.Array, right: pa.Array, width: int, percent: int) -> np.ndarray:
    """Whether the sets of two columns of texts reach the threshold, row by row."""
    out = np.zeros(len(left), dtype=bool)
    for i, (a, b) in enumerate(zip(_sets(left, width), _sets(right, width))):
        common = len(np.intersect1d(a, b, assume_unique=True))
        either = len(a) + len(b) - common
        out[i] = either > 0 and 100 * common >= percent * either
    return out


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of some nodes."""
    keys = nodes.join(wanted, "node").select("node", "text_key")
    return (
        maybe_among(docs.select("text_key", "text"), F.col("text_key"), keys, F.col("text_key"))
        .groupBy("text_key")
        .agg(F.first("text").alias("text"))
        .join(keys, "text_key")
        .select("node", "text")
    )


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _texts(wanted, nodes, docs)
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def compute():
        def work(batch):
            parts = (batch.slice(at, 64) for at in range(0, batch.num_rows, 64))
            found = [_reach(p.column("text_a"), p.column("text_b"), width, percent) for p in parts]
            return [pa.array(np.concatenate(found))]

        return work

    checked = added(sides, [T.StructField("linked", T.BooleanType())], compute)
    return checked.filter("linked").select("a", "b")


def _may_reach(percent: int) -> float:
    """Least share of equal places for a pair worth verifying."""
    s = percent / 100
    return s - _SLACK * (s * (1 - s) / PLACES) ** 0.5


def _close(percent: int):
    """Keep pairs whose sizes and signatures allow the threshold."""
    least = _may_reach(percent) * PLACES

    def compute():
        def work(batch):
            a = np.frombuffer(b"".join(batch.column("sketch_a").to_pylist()), np.uint8)
            b = np.frombuffer(b"".join(batch.column("sketch_b").to_pylist()), np.uint8)
            same = (a == b).reshape(-1, PLACES).sum(axis=1)
            return [pa.array(same >= least)]

        return work

    return compute


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The two blocks of a group; they are the same where a block meets itself (side 0)."""
    side = table["side"].to_numpy()
    return table.filter(pa.array(side <= 1)), table.filter(pa.array(side != 1))


def _forest(a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
    """A spanning forest of the edges."""
    if not a:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    nodes, roots = union_find(np.concatenate(a), np.concatenate(b))
    other = nodes != roots
    return pa.table({"a": roots[other], "b": nodes[other]})


def _may_link(percent: int):
    """Edges between nodes of a block pair that lie in different components and may be linked."""
    least = _may_reach(percent) * PLACES

    def compare(table: pa.Table) -> pa.Table:
        left, right = _sides(table)
        sketch = [
            np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, PLACES)
            for t in (left, right)
        ]
        found_a, found_b = [], []
        node, root, n = (right[c].to_numpy() for c in ("node", "root", "n"))
        columns = (left[c].to_pylist() for c in ("node", "root", "n"))
        for i, (x, r, size) in enumerate(zip(*columns)):
            fits = (root != r) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
            rows = np.flatnonzero(fits)
            if len(rows):
                same = (sketch[1][rows] == sketch[0][i]).sum(axis=1)
                rows = rows[same >= least]
                found_a.append(np.full(len(rows), x))
                found_b.append(node[rows])
        return _forest(found_a, found_b)

    return compare


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every set on the right."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, held = np.unique(
        np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True, return_counts=True
    )
    shared = np.cumsum(held > 1) - 1  # a value that one set alone holds is in no intersection
    keep = held[place] > 1
    owner, place = owner[keep], shared[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        a, b = np.searchsorted(place, [first, first + columns])
        held_by = np.zeros((len(sets), columns), dtype=np.float32)
        held_by[owner[a:b], place[a:b] - first] = 1
        out += held_by[: len(left)] @ held_by[len(left) :].T
    return out.astype(np.int64)


def _links(width: int, percent: int):
    """Links between nodes of a block pair that lie in different components."""

    def sets_of(table: pa.Table) -> list[np.ndarray]:
        return [found for chunk in table["text"].chunks for found in _sets(chunk, width)]

    def compare(table: pa.Table) -> pa.Table:
        left, right = _sides(table)
        sets = sets_of(left), sets_of(right)
        common = common_counts(*sets)
        sizes = [np.array([len(s) for s in x], dtype=np.int64) for x in sets]
        either = sizes[0][:, None] + sizes[1][None, :] - common
        roots = [t["root"].to_numpy() for t in (left, right)]
        linked = (100 * common >= percent * either) & (roots[0][:, None] != roots[1][None, :])
        i, j = np.nonzero(linked)
        return _forest([left["node"].to_numpy()[i]], [right["node"].to_numpy()[j]])

    return compare


def _blocks_of_clusters(clustered: DataFrame) -> DataFrame:
    """(cluster, i, j, side, node, root): the block pairs that every node of a cluster takes part in.

    The nodes of a cluster's largest component need no look at each other, so their blocks meet only
    the blocks of the others; these meet all.
    """
    part = F.greatest(F.lit(1 / _BLOCK), F.col("n") / _SHINGLES)  # of a block
    by_root = clustered.groupBy("cluster", "root").agg(F.sum(part).alias("parts"))
    shape = by_root.groupBy("cluster").agg(
        F.max(F.struct("parts", "root")).alias("main"), F.sum("parts").alias("all")
    )
    main = F.ceil(F.col("main.parts")).cast("int")
    rest = F.greatest(F.lit(1), F.ceil(F.col("all") - F.col("main.parts"))).cast("int")
    shape = shape.select("cluster", F.col("main.root").alias("main_root"), main.alias("main"), rest.alias("rest"))
    hashed = F.xxhash64("node")
    own = F.when(
        F.col("root") == F.col("main_root"), F.col("rest") + F.pmod(hashed, F.col("main"))
    ).otherwise(F.pmod(hashed, F.col("rest"))).cast("int")
    last = F.when(F.col("own") < F.col("rest"), F.col("rest") + F.col("main")).otherwise(F.col("rest"))
    placed = clustered.join(shape, "cluster").withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return placed.select(
        "cluster", "node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        side.alias("side"),
    )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    percent: int = SIMILARITY,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_key`` (MD5 of the text), ``n_shingles``,
    ``component_id`` and ``group_id``.

    Two texts are linked when 100 times their shingles in common are at least ``percent`` times those
    of either. ``component_id`` is the smallest id reachable over links, null where no row of the
    group has an id; ``group_id`` names the group itself. A text that is null or without words has no
    shingles, is linked with nothing and is its own group by its id. Rows with equal texts are in one
    group, also when they repeat an id; an id given to different texts links nothing. Words are
    lower-cased (A-Z). ``percent`` should be at least 80 for the stated recall of the banding.
    """
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.unhex(F.md5(text)).alias("text_key")
    )
    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ]
    signed = added(keyed, fields, lambda: lambda batch: _signed(batch.column("text"), width))
    rows = cut_lineage(signed.drop("text"))
    nodes = cut_lineage(
        rows.filter("set_key is not null")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.min("text_key").alias("text_key"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    buckets = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = (
        buckets.groupBy("band")
        .agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("size"))
        .filter("size > 1")
    )
    sketches = nodes.select("node", "n", "sketch")
    stars = (
        buckets.join(shared, "band")
        .filter("node <> a")
        .select("a", F.col("node").alias("b"))
        .distinct()
        .join(sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
        .join(sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b")
        .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    )
    close = added(stars, [T.StructField("close", T.BooleanType())], _close(percent))
    compared = cut_lineage(close.filter("close").select("a", "b"))
    links = cut_lineage(_verified(compared, nodes, keyed, width, percent))
    grouped = cut_lineage(components(links))
    settle(docs.sparkSession)

    # Buckets that are left in several components: compare what the stars did not.
    member = buckets.join(shared.filter("size > 2").select("band", "size"), "band").join(grouped, "node", "left")
    member = member.withColumn("root", F.coalesce("root", "node"))
    mixed = member.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    open_rows = member.join(mixed.select("band"), "band").withColumn(
        "blocks", F.ceil(F.col("size") / _SKETCHES).cast("int")
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    open_rows = (
        open_rows.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "band", "node", "n", "root",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
        )
        .join(sketches.select("node", "sketch"), "node")
    )
    may_link = cut_lineage(
        open_rows.groupBy("band", "i", "j").applyInArrow(_may_link(percent), "a long, b long").distinct()
    )
    if not may_link.isEmpty():
        clusters = components(may_link).select("node", F.col("root").alias("cluster"))
        clustered = cut_lineage(
            clusters.join(grouped, "node", "left")
            .withColumn("root", F.coalesce("root", "node"))
            .join(nodes.select("node", "n"), "node")
        )
        more = (
            _blocks_of_clusters(clustered)
            .join(_texts(clustered.select("node"), nodes, keyed), "node")
            .groupBy("cluster", "i", "j")
            .applyInArrow(_links(width, percent), "a long, b long")
        )
        grouped = cut_lineage(components(links.unionAll(more)))
    settle(docs.sparkSession)

    roots = nodes.join(grouped, "node", "left").select(
        "set_key", "least_id", F.coalesce("root", "node").alias("root")
    )
    least = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = roots.join(least, "root").select("set_key", "component_id", F.col("root").alias("group_id"))
    joined = rows.select("doc_id", "text_key", "n_shingles", "set_key").join(known, "set_key", "left")
    empty = F.col("set_key").isNull()
    return joined.select(
        "doc_id", "text_key", "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "group_id",
    )
