"""Fingerprints, whitening and hard negatives against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import fingerprint, negatives, whitening
from cohortloom.llm.frames import read
from cohortloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


# Fingerprints


def shingles(text, width=fingerprint.WIDTH):
    if not text:
        return set()
    return {text[i : i + width] for i in range(max(1, len(text) - width + 1))}


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def check_next(found, rows):
    """``rows``: (doc_id, text) in the order of the contract."""
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for (doc_id, text), (_, following) in zip(rows, [*rows[1:], rows[0]]):
        r, other = by_id[doc_id], edited(text, following)
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.packed(fingerprint.sketch(text))
        assert r["edited_fingerprint"] == fingerprint.packed(fingerprint.sketch(other))
        for column, against in (("near_edited", other), ("near_next", following)):
            assert 0 <= r[column] <= 1
            if text == against:
                assert r[column] == 1
    return by_id


def test_fingerprints_of_the_table(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    rows = sorted(docs, reverse=True)
    by_id = check_next(QUERIES["op12_fingerprints"](spark, SF).collect(), rows)
    errors = []
    for (doc_id, text), (_, following) in zip(rows, [*rows[1:], rows[0]]):
        for column, against in (("near_edited", edited(text, following)), ("near_next", following)):
            a, b = shingles(text), shingles(against)
            if min(len(a), len(b)) >= 400:
                errors.append(by_id[doc_id][column] - len(a & b) / min(len(a), len(b)))
    assert len(errors) > 500
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.08


def test_fingerprint_of_odd_rows(spark, odd, odd_rows, empty):
    found = fingerprint.with_next(odd).collect()
    texts = sorted(t or "" for _, t, _, _ in odd_rows)
    assert sorted(r["n_chars"] for r in found) == sorted(map(len, texts))
    same = {r["fingerprint"] for r in found if r["doc_id"] == 6}
    assert same <= {r["fingerprint"] for r in found if r["doc_id"] == 7} and len(same) == 1
    assert {r["fingerprint"] for r in found if r["n_chars"] == 0} == {""}
    assert fingerprint.with_next(empty).count() == 0
    one = fingerprint.with_next(spark.createDataFrame([(4, "only text here")], "doc_id long, text string")).first()
    assert (one["near_edited"], one["near_next"]) != (None, None) and one["near_next"] == 1


def test_neighbours_across_parts(spark):
    ids = [2**62 + i for i in range(300)] + [-(2**62) + 3 * i for i in range(300)]
    rows = [(i, f"text number {i} " * (1 + i % 5)) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check_next(fingerprint.with_next(df).collect(), sorted(rows, reverse=True))


def test_long_text_hashed_in_pieces(monkeypatch):
    draw = np.random.default_rng(5)
    text = "".join(map(chr, draw.integers(97, 123, 5000)))
    whole = fingerprint.sketch(text)
    monkeypatch.setattr(fingerprint, "_PIECE", 700)
    assert (fingerprint.sketch(text) == whole).all()
    kept = set(whole.tolist())
    each = {int(fingerprint._window_hashes(np.array([ord(c) + 1 for c in s], dtype=np.uint64), 12)[0]) for s in shingles(text)}
    assert kept == {h >> 32 for h in each if h < 2**64 // fingerprint.SCALE}


def test_merged_sketches(spark):
    draw = np.random.default_rng(6)
    texts = [(i, "ab"[i % 2], "".join(map(chr, draw.integers(97, 123, 400)))) for i in range(12)]
    known = fingerprint.sketches(spark.createDataFrame(texts, "doc_id long, source string, text string"))
    sources = fingerprint.merged(known, "source")
    for side in "ab":
        expected = set()
        for _, s, t in texts:
            if s == side:
                expected |= set(fingerprint.sketch(t).tolist())
        assert {r["hash"] for r in sources.filter(F.col("source") == side).collect()} == expected
    covered = {(r["doc_id"], r["source"]): r["contained"] for r in fingerprint.coverage(known, "doc_id", sources, "source").collect()}
    assert all(covered[i, s] == 1 for i, s, _ in texts)


# Hard negatives


def negatives_by_force(rows, is_anchor, positives=5, count=10):
    """rows: (id, label, whole vector)."""
    out = set()
    for a, label, q in rows:
        if not is_anchor(a):
            continue
        scores = sorted((-sum(map(int.__mul__, q, v)), i, other) for i, other, v in rows if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            window = [x for x in scores if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out |= {(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(window[:count], 1)}
    return out


def results(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("rows, anchors", [(1000, 500), (90, 7)])
def test_negatives_on_cells(spark, monkeypatch, rows, anchors):
    monkeypatch.setattr(negatives, "ROWS", rows)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(4, 12))
    data = []
    for i in range(400):
        label = 0 if i % 3 else int(draw.integers(1, 4))  # a hot label
        data.append((i, label, (centres[label] + draw.normal(size=12)).round(1).tolist()))
    data += [(400 + i, data[i][1], data[i][2]) for i in range(20)]  # ties
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")
    floors = [(i, k, [int(x) for x in np.floor(256 * np.array(v))]) for i, k, v in data]
    expected = negatives_by_force(floors, lambda i: i % 10 == 0)
    assert len(expected) > 500
    assert results(negatives.mine(df, F.col("vec_id") % 10 == 0)) == expected


def test_negatives_of_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 2.0], "x"), (0, 1, [1.0, 2.0], "y"), (0, 2, [0.5, 0.5], "x"), (1, 1, None, "x"), (2, None, [1.0, 1.0], "x"),
        (3, 1, [1.0, None], "x"), (4, 1, [float("nan"), 1.0], "x"), (5, 2, [float("inf"), 0.0], "x"), (6, 1, [], "x"),
        (7, 1, [3.0], "x"), (8, 2, [-1.0, 1.0, 9.0], "x"), (9, 1, [-5.0, 0.0], "x"), (None, 1, [1.0, 1.0], "x"),
        (100, 3, [1.0, 0.0], "x"), (200, 1, [0.0, 0.0], "x"), (10, 2, [1e6, -1e6], "x"), (11, 2, [1.0, 0.3], "x"), (11, 2, [1.0, 0.3], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, positive_score string")
    floors = {
        (i, k, tuple(int(np.floor(256 * x)) for x in v) + (0,) * (3 - len(v)))
        for i, k, v, _ in rows
        if None not in (i, k, v) and all(x is not None and np.isfinite(x) for x in v)
    }
    expected = negatives_by_force(sorted(floors), lambda i: i % 100 == 0)
    assert expected and results(negatives.mine(df, F.col("vec_id") % 100 == 0)) == expected
    assert negatives.mine(df.limit(0), F.lit(True)).count() == 0
    assert negatives.mine(df.limit(1), F.lit(True)).count() == 0


def test_large_scores_stay_exact(spark):
    big = float(2**40 + 2**9)
    rows = [(0, 1, [big, 1.0]), (1, 1, [3.0, -7.0]), (2, 1, [3.0, 5.0]), (3, 2, [2.0, 3.0]), (4, 2, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    floors = [(i, k, [int(256 * x) for x in v]) for i, k, v in rows]
    expected = negatives_by_force(floors, lambda i: i == 0)
    assert len(expected) == 4 and results(negatives.mine(df, F.col("vec_id") == 0)) == expected
    huge = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1e30])], df.schema)
    with pytest.raises(Exception, match="Overflow|too large|too big"):
        negatives.mine(huge, F.lit(True)).collect()


def test_index_and_thresholds_spare_work():
    draw = np.random.default_rng(8)
    scales = 2.0 ** -np.arange(32)  # skewed dimensions
    vectors = np.floor(1000 * draw.normal(size=(3000, 32)) * scales)
    block = negatives.Block(vectors)
    top = np.sort(vectors @ vectors[0])[-20]
    rows, scores = block.search(vectors[:1], np.array([top]))[0]
    assert set(rows[scores >= top]) == set(np.flatnonzero(vectors @ vectors[0] >= top))
    assert block.scored < 0.1 * block.asked and block.listed < 0.9 * block.held


# Whitening


def whitened_by_force(rows, components=32, factor=64, offset=1_000_000):
    """rows: (id, vector). n, deviations, eigenvalues, eigenvectors, centred vectors, trace."""
    x = np.array([[int(np.floor(factor * c)) + offset for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    gaps = x * n - sums
    y = gaps.astype(float) / n
    covariance = y.T @ y / n
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    return n, (gaps**2).sum(axis=1), values[order], directions[:, order], y, np.trace(covariance)


def check_whitening(found, rows, components):
    n, far, values, directions, y, trace = whitened_by_force(rows, components)
    values, directions = values[values > 1e-9 * values[0]], directions[:, values > 1e-9 * values[0]]
    count = len(values)
    assert len(found) == len(rows) * count
    ids = [i for i, _ in rows]
    assert len(set(ids)) == len(ids)
    z = np.full((len(rows), count), np.nan)
    at = {i: k for k, i in enumerate(ids)}
    for r in found:
        k = at[r["vec_id"]]
        z[k, r["component"] - 1] = r["whitened"]
        assert (r["n"], r["deviation"]) == (n, far[k])
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-10)
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-9
    expected = y @ directions / np.sqrt(values)
    signs = np.sign((z * expected).sum(axis=0))
    gap = np.min(np.abs(np.diff(values)), initial=np.inf) / values[0]
    assert np.abs(z * signs - expected).max() < 1e-9 + 1e-11 / gap
    assert np.abs(z.T @ z / n - np.eye(count)).max() < 1e-9


def test_whitening_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in read(spark, SF, "embeddings").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    check_whitening(QUERIES["op11_whitening"](spark, SF).collect(), rows, 32)


def test_whitening_of_correlated_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "_ROWS", 50)
    draw = np.random.default_rng(9)
    turn = draw.normal(size=(12, 12)) * 2.0 ** -np.arange(12)
    rows = [(i, (100 * draw.normal(size=12) @ turn.T).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    check_whitening(whitening.whiten(df, 5).collect(), rows, 5)


@pytest.mark.parametrize("wide, count, spectrum", [
    (300, 12, lambda i: 1.0 / (1 + i)), (200, 10, lambda i: np.exp(-i / 3.0)), (150, 8, lambda i: 1.0 + (i < 20)),
    (60, 20, lambda i: (i < 5) * 1.0), (40, 40, lambda i: 2.0**-i), (120, 6, lambda i: 1 + 1e-6 * (i == 0)), (1, 3, lambda i: i + 1.0),
])
def test_jacobi_davidson(wide, count, spectrum):
    draw = np.random.default_rng(10)
    basis = np.linalg.qr(draw.normal(size=(wide, wide)))[0]
    true = np.array([float(spectrum(i)) for i in range(wide)])
    matrix = (basis * true) @ basis.T
    values, vectors, spent = whitening.leading(lambda p: matrix @ p, wide, count)
    count = min(count, wide)
    assert np.abs(values - np.sort(true)[::-1][:count]).max() < 1e-12 * true.max()
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() <= 2 * whitening.PRECISION * true.max()
    assert np.abs(vectors.T @ vectors - np.eye(count)).max() < 1e-13
    assert spent["products"] < 400


def test_minres_solves():
    draw = np.random.default_rng(11)
    a = draw.normal(size=(20, 20))
    a = a + a.T
    right = draw.normal(size=(20, 3))
    shifts = np.array([0.3, -0.2, 1.1])
    found = whitening.minres(lambda p: a @ p, right, shifts, lambda t: t, 40)
    for i, s in enumerate(shifts):
        assert np.allclose((a - s * np.eye(20)) @ found[:, i], right[:, i], atol=1e-6)


def test_whitening_of_odd_rows(spark):
    rows = [
        (1, [1.0, 2.0], "x"), (1, [1.0, 2.0], "x"), (2, None, "x"), (3, [None, 1.0], "x"), (4, [float("nan"), 0.0], "x"),
        (5, [float("inf"), 0.0], "x"), (6, [], "x"), (None, [3.0, -1.0], "x"), (7, [2.0], "x"), (8, [-4.0, 0.5], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")
    found = whitening.whiten(df).collect()
    assert sorted(r["vec_id"] or 0 for r in found if r["component"] == 1) == [0, 1, 1, 6, 7, 8]
    assert {r["n"] for r in found} == {6} and {r["component"] for r in found} == {1, 2}
    filled = [[1, 2], [1, 2], [0, 0], [3, -1], [2, 0], [-4, 0.5]]
    _, far, *_ = whitened_by_force(list(enumerate(filled)), 2)
    assert sorted(r["deviation"] for r in found if r["component"] == 1) == sorted(far)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.limit(1)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 6")).count() == 0
    assert whitening.whiten(df.filter("vec_id = 1")).count() == 0
    large = spark.createDataFrame([(i, [2.0**40 * i, 1.0 * i]) for i in range(4)], df.schema.fieldNames()[:2])
    with pytest.raises(Exception, match="too large|Overflow|overflow|out of range|too big"):
        whitening.whiten(large).collect()
