"""Local regression against dense matrices."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom import operators as op
from cohortloom.operators import smooth
from cohortloom.operators.stats import t_quantile


def local_rows(x, at, span):
    """Operators of the fitted value and slope at one position: a weight per point, by least squares."""
    distance = np.abs(x - at)
    q = int(len(x) * min(span, 1) + 1e-5)
    width = np.sort(distance)[q - 1] * max(1, span)
    root = np.sqrt(np.where(distance < width, (1 - np.minimum(distance / width, 1) ** 3) ** 3, 0))
    design = np.column_stack([np.ones(len(x)), x - at, (x - at) ** 2])
    solved = np.linalg.pinv(design * root[:, None]) * root
    return solved[0], solved[1]


def vertices_of(x, span, cell):
    ordered, cuts, todo = np.sort(x), [], [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a > int(len(x) * span * cell) and b - a > 1:
            middle = a + (b - a + 1) // 2
            cuts.append((ordered[middle - 1] + ordered[middle]) / 2)
            todo += [(a, middle), (middle, b)]
    wide = ordered[-1] - ordered[0]
    return np.unique([ordered[0] - 0.1 * wide, *cuts, ordered[-1] + 0.1 * wide])


def blended_rows(x, targets, span, cell):
    """The operator of the blended surface at each target, from the cubic through two heights and slopes."""
    v = vertices_of(x, span, cell)
    ends = [local_rows(x, at, span) for at in v]
    out = []
    for t in targets:
        k = min(np.searchsorted(v, t, side="right") - 1, len(v) - 2)
        a, b = v[k], v[k + 1]
        powers = np.array([[1, a, a**2, a**3], [0, 1, 2 * a, 3 * a**2], [1, b, b**2, b**3], [0, 1, 2 * b, 3 * b**2]])
        weights = np.linalg.solve(powers.T, [1, t, t**2, t**3])
        out.append(weights @ np.array([ends[k][0], ends[k][1], ends[k + 1][0], ends[k + 1][1]]))
    return np.array(out)


def band_by_force(x, y, grid, span, cell, direct, level=0.95):
    targets = x.min() + np.arange(grid) * (x.max() - x.min()) / (grid - 1)
    hat = blended_rows(x, x, span, cell)
    gap = (np.eye(len(x)) - hat) @ (np.eye(len(x)) - hat).T
    scale = math.sqrt(np.sum((y - hat @ y) ** 2) / np.trace(gap))
    freedom = np.trace(gap) ** 2 / np.trace(gap @ gap)
    rows = blended_rows(x, targets, span, cell)
    if direct:
        rows = np.array([local_rows(x, at, span)[0] for at in targets])
    fitted, error = rows @ y, scale * np.linalg.norm(rows, axis=1)
    reach = t_quantile(1 - level, freedom) * error
    return targets, fitted, error, fitted - reach, fitted + reach


@pytest.mark.parametrize("surface", ["interpolate", "direct"])
@pytest.mark.parametrize("span, cell, ties", [(0.75, 0.2, False), (0.5, 0.3, True), (1.4, 0.2, False)])
def test_band_against_dense_matrices(spark, surface, span, cell, ties):
    draw = np.random.default_rng(2)
    x = np.sort(draw.uniform(-2, 3, 120))
    x = x.round(1) if ties else x
    y = np.sin(2 * x) + draw.normal(0, 0.1, len(x))
    rows = [(float(a), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame([*rows, (None, 1.0), (0.5, None), (float("nan"), 2.0)], "x double, y double")
    found = op.loess(df.repartition(5), "x", "y", grid=15, span=span, surface=surface, cell=cell).orderBy("grid_id")
    found = np.array([list(r)[1:] for r in found.collect()])
    expected = np.column_stack(band_by_force(x, y, 15, span, cell, surface == "direct"))
    assert np.allclose(found, expected, rtol=1e-6, atol=1e-8)


def test_surfaces_meet_at_vertices(spark):
    """Positions that are vertices have the direct fit; elsewhere blending is off by under 3 % of the range."""
    draw = np.random.default_rng(3)
    x = np.arange(0.0, 160.0)
    y = np.sin(x / 20) + draw.normal(0, 0.05, len(x))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    both = [op.loess(df, "x", "y", grid=319, surface=s).orderBy("grid_id").collect() for s in ("interpolate", "direct")]
    inner = {v for v in vertices_of(x, 0.75, 0.2) if 0 <= v <= 159}
    assert len(inner) == 7
    gaps = [abs(a["fitted"] - b["fitted"]) for a, b in zip(*both)]
    at_vertices = [g for g, row in zip(gaps, both[0]) if row["x"] in inner]
    assert len(at_vertices) == 7 and max(at_vertices) < 1e-9
    assert 0 < max(gaps) < 0.03 * (y.max() - y.min())


def test_counts_stand_for_points(spark):
    """Repeated x values are counted once, whatever their number: tenfold points, the same passes."""
    draw = np.random.default_rng(4)
    x = draw.integers(0, 40, 3000)
    y = (draw.uniform(size=3000) < 0.2 + 0.01 * x).astype(float)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, y)], "x int, y double")
    found = op.loess(df, "x", "y", grid=5).orderBy("grid_id").collect()
    expected = np.column_stack(band_by_force(x.astype(float), y, 5, 0.75, 0.2, False))
    assert np.allclose([list(r)[1:] for r in found], expected, rtol=1e-6)


def test_time_does_not_follow_the_grid_times_the_points(spark):
    def seconds(rows):
        values = spark.range(rows).select((F.col("id") % 997 / 997.0).alias("x"), F.cos("id").alias("y"))
        started = time.time()
        op.loess(values, "x", "y").collect()
        return time.time() - started

    seconds(1000)
    few, many = seconds(300_000), seconds(3_000_000)
    assert many < 2 * few + 1


def test_ranks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(smooth, "FEW", 10)
    draw = np.random.default_rng(5)
    values = np.concatenate([draw.normal(size=2000), np.full(1500, 0.25), draw.lognormal(0, 5, 500), [1e12, -1e12]])
    data = [(float(v), float(n)) for v, n in zip(values, draw.integers(1, 4, len(values)))]
    points = spark.createDataFrame(data, "x double, n double").repartition(6)
    spread = np.repeat([v for v, _ in data], [int(n) for _, n in data])
    for centre in (None, 0.25, 3.0):
        ordered = np.sort(spread if centre is None else np.abs(spread - centre))
        ranks = [1, 17, len(ordered) // 2, len(ordered) - 1, len(ordered)]
        assert smooth._ranked(points, [centre] * 5, ranks) == [ordered[r - 1] for r in ranks]


def test_too_few_points(spark):
    def values(rows, **options):
        return [list(r)[2:] for r in op.loess(spark.createDataFrame(rows, "x double, y double"), "x", "y", grid=4, **options).collect()]

    assert values([]) == []
    for rows in ([(1.0, 2.0)], [(1.0, 2.0)] * 9, [(1.0, 2.0), (2.0, 3.0)] * 5):
        assert values(rows) == [[None] * 4] * 4
        assert values(rows, surface="direct") == [[None] * 4] * 4
    with pytest.raises(ValueError, match="surface"):
        values([(1.0, 2.0)], surface="other")
