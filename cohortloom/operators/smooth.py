"""Local quadratic regression with confidence bands, from sums over the distinct x values.

Points are first counted by x. Every later step is a pass over these counts that sends back a few sums
per position, whatever the number of points; no point is repeated for a position.

The surface is fitted at vertices and blended between them: the x range, a margin wider, is cut at the
middle of its points until a cell holds no more than a share of them, each vertex gets the value and the
slope of a local fit, and a cell takes the cubic that meets those of its ends. With ``surface="direct"``
each position has a local fit of its own.

The blended fits are linear in y: fitted = L y with L = B C', where C holds the operators of the vertex
values and slopes and B the blending, so that L has at most twice as many ranks as there are vertices.
The traces that residual scale and degrees of freedom need, of (I-L)(I-L)' and its square, follow from
the products of B and C alone, which are sums over the points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .stats import t_quantile

MARGIN = 0.1  # of the x range, beyond its ends
BINS = 64
FEW = 4096  # values of a rank's bin that are looked at one by one


def _summed(points: DataFrame, size: int, columns: list[str], part) -> np.ndarray:
    """Sum over the batches of ``points`` of ``part``, which maps arrays of the columns to ``size`` numbers."""

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            total += part(*[batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size), pa.int32()), pa.array(total)], ["place", "value"]
        )

    parts = points.select(*columns).mapInArrow(add, "place int, value double")
    out = np.zeros(size)
    for place, value in parts.groupBy("place").agg(F.sum("value")).collect():
        out[place] = value
    return out


def _ranked(points: DataFrame, centres: list[float | None], ranks: list[int]) -> list[float]:
    """The rank-th smallest distance of x from each centre (of x itself where there is none), exactly.

    Each round counts the values of every bracket in ``BINS`` even bins and goes on in the bin that holds
    the rank, until that has one distinct value, or few enough values to be fetched.
    """
    count = len(centres)
    lo, hi, rest = [-np.inf] * count, [np.inf] * count, list(ranks)
    found: list[float | None] = [None] * count
    shift = np.array([0.0 if c is None else c for c in centres])
    plain = np.array([c is None for c in centres])
    while True:
        left = [i for i in range(count) if found[i] is None]
        if not left:
            return found
        at, low, high = np.array(left), np.array([lo[i] for i in left]), np.array([hi[i] for i in left])

        def tally(batches, at=at, low=low, high=high, shift=shift, plain=plain, bins=BINS):
            bounded = np.isfinite(low) & np.isfinite(high) & (high > low)
            counts = np.zeros((len(at), bins))
            least, most = np.full((len(at), bins), np.inf), np.full((len(at), bins), -np.inf)
            for batch in batches:
                x, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "n"))
                for k, i in enumerate(at):
                    value = x if plain[i] else np.abs(x - shift[i])
                    inside = (value >= low[k]) & (value <= high[k])
                    value, weight = value[inside], n[inside]
                    if not len(value):
                        continue
                    place = np.zeros(len(value), dtype=int)
                    if bounded[k]:
                        place = ((value - low[k]) / (high[k] - low[k]) * bins).astype(int).clip(0, bins - 1)
                    counts[k] += np.bincount(place, weight, bins)
                    np.minimum.at(least[k], place, value)
                    np.maximum.at(most[k], place, value)
            rows, places = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at[rows], pa.int32()), pa.array(places, pa.int32()), pa.array(counts[rows, places]),
                    pa.array(least[rows, places]), pa.array(most[rows, places]),
                ],
                ["target", "bin", "n", "least", "most"],
            )

        tallied = points.select("x", "n").mapInArrow(tally, "target int, bin int, n double, least double, most double")
        bins = tallied.groupBy("target", "bin").agg(F.sum("n"), F.min("least"), F.max("most")).collect()
        by_target: dict[int, list] = {i: [] for i in left}
        for target, *row in bins:
            by_target[target].append(row)
        close = []
        for i in left:
            for _, n, least, most in sorted(by_target[i]):
                if rest[i] > n:
                    rest[i] -= int(n)
                    continue
                lo[i], hi[i] = least, most
                if least == most:
                    found[i] = least
                elif n <= FEW:
                    close.append(i)
                break
        if close:
            few = _between(points, shift[close], plain[close], [lo[i] for i in close], [hi[i] for i in close])
            for i, values in zip(close, few):
                upto = 0
                for value in sorted(values):
                    upto += values[value]
                    if upto >= rest[i]:
                        found[i] = value
                        break


def _between(points: DataFrame, shift, plain, low, high) -> list[dict[float, float]]:
    """Per bracket the values in it, at most ``FEW``, with how often each occurs."""

    def pick(batches):
        for batch in batches:
            x, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "n"))
            for k in range(len(low)):
                value = x if plain[k] else np.abs(x - shift[k])
                inside = np.flatnonzero((value >= low[k]) & (value <= high[k]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(inside), k), pa.int32()), pa.array(value[inside]), pa.array(n[inside])],
                    ["target", "value", "n"],
                )

    out: list[dict[float, float]] = [{} for _ in low]
    near = points.select("x", "n").mapInArrow(pick, "target int, value double, n double")
    for target, value, n in near.groupBy("target", "value").agg(F.sum("n")).collect():
        out[target][value] = n
    return out


def _cells(n: int, most: int) -> list[int]:
    """Ranks after which the sorted points are cut, until no cell has more than ``most`` of them."""
    cuts, todo = [], [(1, n)]
    while todo:
        low, high = todo.pop()
        if high - low + 1 > most and high > low:
            middle = (low + high) // 2
            cuts.append(middle)
            todo += [(low, middle), (middle + 1, high)]
    return sorted(cuts)


def _local(points: DataFrame, centres: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weighted power sums around each centre: distances are in units of its width.

    Returns the sums of w u^0..4, of w u^0..2 y, of w^2 u^0..4 and the number of distinct x with weight.
    """
    size = len(centres)

    def part(x, n, total):
        out = np.zeros((size, 14))
        for k in range(size):
            if not widths[k] > 0:
                continue
            u = (x - centres[k]) / widths[k]
            near = np.abs(u) < 1
            u = u[near]
            w = (1 - np.abs(u) ** 3) ** 3
            powers = np.vander(u, 5, increasing=True)
            out[k, :5] = (n[near] * w) @ powers
            out[k, 5:8] = (total[near] * w) @ powers[:, :3]
            out[k, 8:13] = (n[near] * w * w) @ powers
            out[k, 13] = (w > 0).sum()
        return out.ravel()

    sums = _summed(points, size * 14, ["x", "n", "total"], part).reshape(size, 14)
    return sums[:, :5], sums[:, 5:8], sums[:, 8:13], sums[:, 13]


def _solved(moments: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Inverses of the normal matrices of the quadratics; NaN with fewer than three distinct neighbours."""
    out = np.full((len(moments), 3, 3), np.nan)
    for k, s in enumerate(moments):
        if distinct[k] >= 3:
            out[k] = np.linalg.inv(np.array([s[0:3], s[1:4], s[2:5]]))
    return out


def _blender():
    """Made inside a function, so that it travels to the workers by value."""

    def blending(x: np.ndarray, vertices: np.ndarray) -> np.ndarray:
        size = len(vertices)
        cell = np.clip(np.searchsorted(vertices, x, side="right") - 1, 0, size - 2)
        a, width = vertices[cell], np.diff(vertices)[cell]
        t = (x - a) / width
        out = np.zeros((len(x), 2 * size))
        row = np.arange(len(x))
        out[row, cell] = (1 + 2 * t) * (1 - t) ** 2
        out[row, cell + 1] = t * t * (3 - 2 * t)
        out[row, size + cell] = width * t * (1 - t) ** 2
        out[row, size + cell + 1] = width * t * t * (t - 1)
        return out

    return blending


# Rows of B: the weights of all vertex values, then of all slopes, at each x.
_blending = _blender()


def _products(points: DataFrame, vertices, widths, inverses, heights) -> tuple[np.ndarray, float]:
    """The products of the columns of B and C over all points, and the residual sum of squares.

    ``heights`` are the fitted values and slopes at the vertices.
    """
    size = len(vertices)
    blending = _blending

    def part(x, n, total, spread):
        b, c = blending(x, vertices), np.zeros((len(x), 2 * size))
        for k in range(size):
            u = (x - vertices[k]) / widths[k]
            near = np.abs(u) < 1
            u = u[near]
            w = (1 - np.abs(u) ** 3) ** 3
            powers = np.vander(u, 3, increasing=True)
            c[near, k] = w * (powers @ inverses[k, 0])
            c[near, size + k] = w * (powers @ inverses[k, 1]) / widths[k]
        both = np.hstack([b, c])
        off = total / n - b @ heights
        return np.append(((both * n[:, None]).T @ both).ravel(), spread.sum() + (n * off * off).sum())

    found = _summed(points, (4 * size) ** 2 + 1, ["x", "n", "total", "spread"], part)
    return found[:-1].reshape(4 * size, 4 * size), float(found[-1])


def loess(
    df: DataFrame,
    x: str,
    y: str,
    grid: int = 80,
    span: float = 0.75,
    surface: str = "interpolate",
    cell: float = 0.2,
    level: float = 0.95,
) -> DataFrame:
    """Local quadratic regression with tricube weights on an even grid over the x range: a row per position.

    Columns are grid_id, x, fitted, std_error, and the ends ``lower`` and ``upper`` of the confidence
    interval of the mean. ``span`` is the share of the points in a neighbourhood; beyond 1 all points count
    and the bandwidth is that many times the greatest distance. ``cell`` is the share of a neighbourhood
    that a cell may hold. Residual scale and degrees of freedom are those of the blended surface also
    where ``surface="direct"``.

    Rows with a missing value are left out. Where a fit has fewer than three distinct neighbours it is
    NULL, and with it what depends on it; so are the interval's ends where no residual degree of freedom
    is left. The result is computed when the function is called: the points are counted by x, checkpointed
    and then read in a dozen passes.
    """
    if surface not in ("interpolate", "direct"):
        raise ValueError(f"surface is interpolate or direct, not {surface}")
    schema = "grid_id int, x double, fitted double, std_error double, lower double, upper double"
    given = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    known = given.na.drop("any").filter(~F.isnan("x") & ~F.isnan("y"))
    points = cut_lineage(
        known.groupBy("x").agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.sum("y").alias("total"),
            (F.var_pop("y") * F.count(F.lit(1))).alias("spread"),
        )
    )
    n, lo, hi = points.agg(F.sum("n"), F.min("x"), F.max("x")).first()
    if n is None:
        return df.sparkSession.createDataFrame([], schema)
    n = int(n)
    places = lo + np.arange(grid) * ((hi - lo) / (grid - 1))

    cuts = _cells(n, int(n * span * cell))
    edges = _ranked(points, [None] * (2 * len(cuts)), [r for c in cuts for r in (c, c + 1)])
    middles = [(a + b) / 2 for a, b in zip(edges[::2], edges[1::2])]
    margin = MARGIN * max(hi - lo, 1e-10 * max(abs(lo), abs(hi)) + 1e-30)
    vertices = np.unique([lo - margin, *middles, hi + margin])

    neighbours = max(1, int(n * min(span, 1.0) + 1e-5))
    centres = np.concatenate([vertices, places if surface == "direct" else []])
    widths = np.array(_ranked(points, centres.tolist(), [neighbours] * len(centres))) * max(1.0, span)
    moments, with_y, squared, distinct = _local(points, centres, widths)
    inverses = _solved(moments, distinct)
    fits = np.einsum("kij,kj->ki", inverses, with_y)
    size = len(vertices)
    heights = np.concatenate([fits[:size, 0], fits[:size, 1] / np.where(widths[:size] > 0, widths[:size], np.nan)])

    scale, freedom, kernel = np.nan, np.nan, None
    if np.isfinite(heights).all():
        gram, residual = _products(points, vertices, widths[:size], inverses[:size], heights)
        half = 2 * size
        kernel = gram[half:, half:]
        # (I-L)(I-L)' = I + U W U' with U = [B C].
        turn = np.block([[kernel, -np.eye(half)], [-np.eye(half), np.zeros((half, half))]]) @ gram
        first, second = n + np.trace(turn), n + 2 * np.trace(turn) + np.trace(turn @ turn)
        if first > 1e-9 * n and second > 0:
            scale, freedom = float(np.sqrt(residual / first)), float(first * first / second)
    if surface == "direct":
        fitted = fits[size:, 0]
        rows = inverses[size:, 0]
        powers = np.array([[[s[i + j] for j in range(3)] for i in range(3)] for s in squared[size:]])
        norms = np.einsum("ki,kij,kj->k", rows, powers, rows)
    else:
        blend = _blending(places, vertices)
        fitted = blend @ heights
        norms = np.full(grid, np.nan) if kernel is None else np.einsum("ki,ij,kj->k", blend, kernel, blend)
    error = scale * np.sqrt(np.maximum(norms, 0))
    reach = error * (t_quantile(1 - level, freedom) if np.isfinite(freedom) else np.nan)
    table = np.column_stack([places, fitted, error, fitted - reach, fitted + reach])
    rows = [(g, *[None if np.isnan(v) else float(v) for v in row]) for g, row in enumerate(table)]
    return df.sparkSession.createDataFrame(rows, schema)
