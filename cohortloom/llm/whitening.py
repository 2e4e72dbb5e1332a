"""Whitening of vectors: the leading eigenpairs of their covariance by block Jacobi-Davidson.

The covariance V of whole vectors x (n of them, sums S) is never formed. A product V P of a block of
directions is one pass over the table: each task centres its vectors, exactly, as (n x - S) / n, and adds
up y (y . P); Spark sums the tasks' parts. Only blocks of directions and of products (dimensions times
a few dozen doubles) pass through the driver.

Eigenpairs come from Rayleigh-Ritz in a growing subspace. A pair whose residual is at double precision
is locked and the rest of the search kept orthogonal to it. For the pairs still open, the corrections t
solve the projected equation (I - Q Q')(V - e I)(I - Q Q') t = -r, with Q the locked and the open
vectors, by a few steps of MINRES; all open pairs take each step together, in one product. The
corrections extend the subspace, which is cut back to its best Ritz vectors when it is full. Where no
residual falls any more, the sums' own rounding is reached and the pairs are taken as they are, if they
are within ``WORST`` of it; otherwise the search fails.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import cut_lineage, emitted

COMPONENTS = 32
GUARD = 8  # directions beyond the wanted ones
SPACES = 3  # blocks that the subspace may hold
INNER = 8  # steps of MINRES
OUTER = 200
PRECISION = 64 * np.finfo(float).eps  # of a residual, relative to the greatest eigenvalue
WORST = 1e3 * PRECISION
_ROWS = 4096  # vectors packed into one row
_SEED = 11
_WHOLE = 2**62


def minres(product: Callable, right: np.ndarray, shifts: np.ndarray, project: Callable, steps: int) -> np.ndarray:
    """Columns t of project (product - shift) project t = right, after some steps of MINRES.

    Every column has a shift and a Krylov space of its own; ``product`` is called once per step, for the
    columns that go on.
    """
    old, new = np.zeros_like(right), project(right)
    beta = np.linalg.norm(new, axis=0)
    live = beta > 0
    new = np.divide(new, beta, where=live, out=np.zeros_like(new))
    residual = beta.copy()
    solution, w_old, w_new = (np.zeros_like(right) for _ in range(3))
    columns = right.shape[1]
    beta = np.zeros(columns)
    c_old, s_old, c_new, s_new = np.ones(columns), np.zeros(columns), np.ones(columns), np.zeros(columns)
    for _ in range(steps):
        at = np.flatnonzero(live)
        if not len(at):
            break
        v = new[:, at]
        image = project(product(v) - v * shifts[at])
        alpha = (v * image).sum(axis=0)
        image = image - v * alpha - old[:, at] * beta[at]
        following = np.linalg.norm(image, axis=0)
        # The two last plane rotations, applied to the new column of the tridiagonal matrix.
        far = s_old[at] * beta[at]
        middle = c_old[at] * beta[at]
        near = c_new[at] * middle + s_new[at] * alpha
        diagonal = c_new[at] * alpha - s_new[at] * middle
        length = np.hypot(diagonal, following)
        sound = length > 0
        safe = np.where(sound, length, 1.0)
        c, s = np.where(sound, diagonal / safe, 1.0), np.where(sound, following / safe, 0.0)
        w = (v - w_new[:, at] * near - w_old[:, at] * far) / safe
        solution[:, at] += np.where(sound, w * (c * residual[at]), 0.0)
        residual[at] *= -s
        w_old[:, at], w_new[:, at] = w_new[:, at], w
        c_old[at], s_old[at], c_new[at], s_new[at] = c_new[at], s_new[at], c, s
        old[:, at] = v
        go_on = sound & (following > 1e-14 * (np.abs(alpha) + np.abs(beta[at]) + following))
        new[:, at] = np.divide(image, following, where=following > 0, out=np.zeros_like(image))
        beta[at] = following
        live[at] = go_on
    return solution


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The block's directions that are new, orthonormal, and orthogonal to the given ones."""
    for _ in range(3):
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        for basis in against:
            block = block - basis @ (basis.T @ block)
        if block.shape[1]:
            u, sizes, _ = np.linalg.svd(block, full_matrices=False)
            block = u[:, sizes > 1e-10]
    return block


def leading(product: Callable, wide: int, count: int, seed: int = _SEED) -> tuple[np.ndarray, np.ndarray, dict]:
    """The ``count`` greatest eigenvalues, falling, their unit eigenvectors as columns, and what it took.

    ``product`` maps a block of columns to its products with a symmetric positive semidefinite matrix.
    """
    count = min(count, wide)
    block = min(wide, count + GUARD)
    most = min(wide, SPACES * block)
    spent = {"products": 0, "outer": 0, "residual": 0.0}

    def times(p: np.ndarray) -> np.ndarray:
        spent["products"] += 1
        return product(p)

    locked, values = np.empty((wide, 0)), np.empty(0)
    start = np.random.default_rng(seed).standard_normal((wide, block))
    space = _orthonormal(start)
    image = times(space)
    scale, best, stuck = 0.0, np.inf, 0
    for _ in range(OUTER):
        spent["outer"] += 1
        # Rayleigh-Ritz.
        small = space.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        scale = max(scale, float(ritz[0]), float(values.max(initial=0.0)))
        if scale <= 0:  # no spread in any direction
            return np.zeros(count), np.linalg.qr(start)[0][:, :count], spent
        wanted = count - len(values)
        # Locked directions are taken out of the images too, so that residuals are those of the open part.
        rest = image[:, :wanted] - space[:, :wanted] * ritz[:wanted]
        size = np.linalg.norm(rest, axis=0) / scale
        worst = float(size.max(initial=0.0))
        stuck = stuck + 1 if worst > best / 2 else 0
        best = min(best, worst)
        full = space.shape[1] + len(values) == wide
        at_rest = (full or stuck >= 3) and worst <= WORST
        done = size <= (WORST if at_rest else PRECISION)
        # Locked from the top down, so that no greater pair is still to come.
        sure = wanted if done.all() else int(np.argmin(done))
        if sure:
            spent["residual"] = max(spent["residual"], float(size[:sure].max()))
            locked = np.hstack([locked, space[:, :sure]])
            values = np.concatenate([values, ritz[:sure]])
            space, image, rest, size = space[:, sure:], image[:, sure:], rest[:, sure:], size[sure:]
            ritz = ritz[sure:]
            best, stuck = np.inf, 0
        if len(values) == count:
            return values, locked, spent
        open_pairs = np.flatnonzero(size > PRECISION)
        kept = np.hstack([locked, space[:, : count - len(values)]])

        def project(t: np.ndarray) -> np.ndarray:
            return t - kept @ (kept.T @ t)

        steps = minres(times, -rest[:, open_pairs], ritz[open_pairs], project, INNER)
        if space.shape[1] + len(open_pairs) > most:
            space, image = space[:, :block], image[:, :block]
        grown = _orthonormal(steps, locked, space)
        if not grown.shape[1] and not full:
            # The corrections lie in the subspace: a new random direction.
            grown = _orthonormal(np.random.default_rng(seed + spent["outer"]).standard_normal((wide, 1)), locked, space)
        # Rounding gathers in images that are turned again and again: they are made anew.
        space = np.hstack([_orthonormal(space, locked), grown]) if grown.shape[1] else _orthonormal(space, locked)
        image = times(space)
        image = image - locked @ (locked.T @ image)
    raise ArithmeticError(f"residual {best:.1e} of the greatest eigenvalue after {OUTER} rounds")


def whole(vector: Column, factor: int, offset: int) -> Column:
    """floor(factor * c) + offset of every component; null for a vector that takes no part."""
    known = vector.isNotNull() & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    )
    return F.when(known, F.transform(vector, lambda c: F.floor(c.cast("double") * factor) + offset))


def _packs(rows: DataFrame, wide: int, fill: int) -> DataFrame:
    """Vectors packed into rows (ids, whether known, matrix) of up to ``_ROWS`` vectors."""

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(at, _ROWS)
                column = piece.column("x")
                lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                matrix = np.full((len(lengths), wide), fill, dtype=np.int64)
                matrix[np.arange(wide) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
                ids = piece.column("vec_id")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                        pa.array([matrix.tobytes()], pa.binary()),
                        pa.array([len(lengths)], pa.int32()),
                    ],
                    ["ids", "matrix", "size"],
                )

    return emitted(rows, "ids array<long>, matrix binary, size int", pack)


def _matrix(data: bytes, wide: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64).reshape(-1, wide)


def _summed(packs: DataFrame, rows: int, columns: int, part: Callable) -> np.ndarray:
    """Sum over all packs of ``part``, a matrix of doubles: added up in each task, then by Spark."""

    def add(batches):
        total = np.zeros((rows, columns))
        for batch in batches:
            for data in batch.column("matrix"):
                total += part(data.as_py())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(rows * columns), pa.int32()), pa.array(total.ravel())], ["place", "value"]
        )

    parts = emitted(packs.select("matrix"), "place int, value double", add)
    found = parts.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(rows * columns)
    out[found["place"].to_numpy()] = found["value"].to_numpy()
    return out.reshape(rows, columns)


class Moments:
    """Vectors of a table with their number and exact sums; products with their covariance."""

    def __init__(self, packs: DataFrame, wide: int):
        self.packs, self.wide = packs, wide

        def add(batches):
            totals, rows, largest = [0] * wide, 0, 0
            for batch in batches:
                for data in batch.column("matrix"):
                    x = _matrix(data.as_py(), wide)
                    rows += len(x)
                    largest = max(largest, int(np.abs(x).max(initial=0)))
                    if largest * len(x) < _WHOLE:
                        part = x.sum(axis=0).tolist()
                    else:
                        part = x.astype(object).sum(axis=0).tolist()
                    totals = [a + int(b) for a, b in zip(totals, part)]
            # Sums in decimal digits: they may pass a long.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(wide + 2), pa.int32()),
                    pa.array([str(v) for v in (*totals, rows, largest)], pa.string()),
                ],
                ["place", "digits"],
            )

        parts = emitted(packs.select("matrix"), "place int, digits string", add)
        value = F.col("digits").cast("decimal(38,0)")
        found = dict(
            parts.groupBy("place").agg(F.when(F.col("place") > wide, F.max(value)).otherwise(F.sum(value)).alias("v"))
            .collect()
        )
        self.sums = [int(found.get(i, 0)) for i in range(wide)]
        self.count = int(found.get(wide, 0))
        self.largest = int(found.get(wide + 1, 0))

    def centred(self) -> Callable[[bytes], np.ndarray]:
        """A function from packed vectors to n x - S: exact, as longs where they fit."""
        wide, n, sums = self.wide, self.count, self.sums
        fits = 2 * n * max(self.largest, 1) < _WHOLE

        def centre(data: bytes) -> np.ndarray:
            x = _matrix(data, wide)
            if fits:
                return x * np.int64(n) - np.array(sums, dtype=np.int64)
            return x.astype(object) * n - np.array(sums, dtype=object)

        return centre

    def product(self, directions: np.ndarray) -> np.ndarray:
        """Covariance times a block of directions: one pass over the vectors."""
        centre, n = self.centred(), self.count

        def part(data: bytes) -> np.ndarray:
            y = centre(data).astype(np.float64) / n
            return y.T @ (y @ directions)

        return _summed(self.packs, self.wide, directions.shape[1], part) / n

    def trace(self) -> float:
        centre, n = self.centred(), self.count

        def part(data: bytes) -> np.ndarray:
            y = centre(data).astype(np.float64) / n
            return np.array([[(y * y).sum()]])

        return float(_summed(self.packs, 1, 1, part)[0, 0]) / n

    def identity_error(self, turn: np.ndarray) -> float:
        """Greatest entry by which the covariance of the whitened vectors differs from the identity."""
        centre, n, k = self.centred(), self.count, turn.shape[1]

        def sums(data: bytes) -> np.ndarray:
            return ((centre(data).astype(np.float64) / n) @ turn).sum(axis=0)[None, :]

        mean = _summed(self.packs, 1, k, sums)[0] / n

        def part(data: bytes) -> np.ndarray:
            z = (centre(data).astype(np.float64) / n) @ turn - mean
            return z.T @ z

        return float(np.abs(_summed(self.packs, k, k, part) / n - np.eye(k)).max())


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    factor: int = 64,
    offset: int = 1_000_000,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Rows whose vector is null, or holds a component that is null or not finite, are dropped; every other
    row counts, repeated ones too, and a row without an id keeps its null. A shorter vector counts as
    filled up with zeros. Components are numbered from 1; those without spread (an eigenvalue within
    rounding of zero, as of equal vectors or a single one) have no whitened value and no rows. Without
    any row, without dimensions or without spread the result is empty. Entries that a long cannot hold
    after scaling, and deviations that it cannot hold, are an error.
    """
    out = T.StructType(
        [
            T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), whole(F.col(vector), factor, offset).alias("x")
    ).filter(F.col("x").isNotNull())
    wide = rows.agg(F.max(F.size("x")).alias("wide")).first()["wide"]
    if not wide:
        return spark.createDataFrame([], out)
    packs = cut_lineage(_packs(rows, wide, offset))
    known = Moments(packs, wide)
    values, directions, _ = leading(known.product, wide, components)
    spread = values > max(values[0], 0.0) * wide * 1e3 * np.finfo(float).eps
    values, directions = values[spread], directions[:, spread]
    count = len(values)
    if not count:
        return spark.createDataFrame([], out)
    turn = directions / np.sqrt(values)
    explained = values / known.trace()
    error = known.identity_error(turn)
    centre, n = known.centred(), known.count

    def project(batches):
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("matrix"), strict=True):
                gaps = centre(data.as_py())
                # A square is exact as a long where the whole sum is.
                small = gaps.dtype != object and int(np.abs(gaps).max(initial=0)) ** 2 * wide < _WHOLE
                far = (gaps * gaps).sum(axis=1) if small else (gaps.astype(object) ** 2).sum(axis=1)
                z = (gaps.astype(np.float64) / n) @ turn
                size = len(z)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array(ids.as_py(), dtype=object), count), pa.int64()),
                        pa.array(np.tile(np.arange(1, count + 1), size), pa.int32()),
                        pa.array(np.full(size * count, n), pa.int64()),
                        pa.array(np.repeat(far, count), pa.int64()),
                        pa.array(z.ravel()),
                        pa.array(np.tile(explained, size)),
                        pa.array(np.full(size * count, error)),
                    ],
                    out.fieldNames(),
                )

    return packs.mapInArrow(project, out)
