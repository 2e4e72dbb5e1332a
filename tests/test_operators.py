import importlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom import operators as op
from cohortloom.operators.stats import t_quantile, t_two_sided


@pytest.fixture
def events(spark):
    return spark.createDataFrame(
        [
            (1, 20, "b", 1), (1, 20, "a", 2), (1, None, "z", 3), (1, 30, None, 4),
            (2, None, "q", 5), (None, 10, "n", 6), (None, 5, "m", 7),
        ],
        "sid int, term int, college string, id int",
    )


def test_first_and_last_event(events, rows):
    assert rows(op.first_event(events, "sid", "term", ["college"])) == [
        (1, 20, "a", 2), (2, None, "q", 5), (None, 5, "m", 7),
    ]
    assert rows(op.last_event(events, "sid", "term", ["college"], ["term", "id"])) == [
        (1, 30, 4), (2, None, 5), (None, 10, 6),
    ]


def test_first_row_forms(events, rows):
    assert rows(op.first_row(events.select("sid"), ["sid"], ["sid"])) == [(1,), (2,), (None,)]
    by_text = op.first_row(events, ["sid"], ["-college", "id"], ["college", "id"])
    assert rows(by_text) == [(1, "z", 3), (2, "q", 5), (None, "n", 6)]


def test_first_row_does_not_depend_on_partitioning(events, rows):
    expected = rows(op.first_row(events, ["sid"], ["term", "college"]))
    for seed in range(3):
        shuffled = events.orderBy(F.rand(seed)).repartition(3)
        assert rows(op.first_row(shuffled, ["sid"], ["term", "college"])) == expected


def test_ties_at_the_cut_go_by_key(spark, rows):
    df = spark.createDataFrame([("c", 4), ("a", 5), ("b", 4)], "k string, n int")
    assert rows(op.top_k(df, 2, ["-n", "k"])) == [("a", 5), ("b", 4)]
    grouped = df.withColumn("g", F.lit(None).cast("int"))
    assert rows(op.top_k(grouped, 2, ["-n", "k"], within=["g"]), "k") == [("a",), ("b",)]


def test_slice_and_rank(spark, rows):
    df = spark.createDataFrame([(i,) for i in (None, 5, 3, 9, 1)], "k int")
    assert rows(op.slice_range(df, ["k"], 2, 3)) == [(3,), (5,)]
    assert rows(op.with_sort_rank(df, ["-k"])) == [(1, 4), (3, 3), (5, 2), (9, 1), (None, 5)]
    many = op.with_sort_rank(spark.range(25_000).withColumn("k", -F.col("id")), ["k"])
    assert many.filter(F.col("sort_rank") != 25_000 - F.col("id")).count() == 0
    assert many.count() == 25_000
    assert op.with_sort_rank(df.limit(0), ["k"]).count() == 0


def test_duplicates_over_the_whole_frame(events, rows):
    flagged = op.is_duplicate(events, ["sid"], ["id"])
    assert rows(flagged.filter(~F.col("is_duplicate")), "id") == [(1,), (5,), (6,)]


def test_group_max_keeps_every_row(events, rows):
    out = op.with_group_max(events, ["sid"], "term", "top")
    assert rows(out, "id", "top") == [(1, 30), (2, 30), (3, 30), (4, 30), (5, None), (6, 10), (7, 10)]


def test_missing_keys_match(spark, rows):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    assert rows(op.left_join(left, right, ["k"])) == [(1, "a", "x"), (3, "c", None), (None, "b", "y")]
    assert op.left_join(left, right, ["k"]).columns == ["k", "v", "v_y"]
    assert rows(op.anti_join(left, right, ["k"])) == [(3, "c")]
    assert rows(op.left_join(left, right, ["k"], null_safe=False), "v_y") == [("x",), (None,), (None,)]
    assert rows(op.anti_join(left, right, ["k"], null_safe=False)) == [(3, "c"), (None, "b")]


def test_partly_null_safe_keys(spark, rows):
    left = spark.createDataFrame([(1, None, 1), (1, 5, 2), (None, None, 3)], "a int, b int, id int")
    right = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert rows(op.anti_join(left, right, ["a", "b"]), "id") == [(2,)]
    assert rows(op.anti_join(left, right, ["a", "b"], null_safe=["b"]), "id") == [(2,), (3,)]


def test_anti_join_complements_matches(spark):
    random.seed(3)
    def pairs(n):
        return [(random.choice([1, 2, 3, None]), random.choice([7, 8, None])) for _ in range(n)]
    left = spark.createDataFrame(pairs(60), "a int, b int")
    right = spark.createDataFrame(pairs(4), "a int, b int")
    unmatched = op.anti_join(left, right, ["a", "b"]).count()
    matched = op.left_join(left, right.distinct().withColumn("hit", F.lit(1)), ["a", "b"])
    assert unmatched + matched.filter("hit = 1").count() == 60
    assert matched.count() == 60


def test_stack_fills_absent_columns(spark, rows):
    a = spark.createDataFrame([(1, "x")], "k int, u string")
    b = spark.createDataFrame([(2, 3.0)], "k int, w double")
    assert rows(op.stack_sources("source", one=a, two=b)) == [
        (1, "x", "one", None), (2, None, "two", 3.0),
    ]


def test_counts_and_freq(spark, rows):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    assert rows(op.counts(df, "k")) == [("a", 2), (None, 1)]
    assert rows(op.freq(df, "k")) == [("a", 2)]


def test_shares(spark, rows):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), (None, "x", 4)], "g string, k string, n int")
    assert rows(op.share(df), "k", "share") == [("x", 0.125), ("x", 0.5), ("y", 0.375)]
    inner = op.share(df, within=["g"])
    assert rows(inner, "g", "k", "share") == [("a", "x", 0.25), ("a", "y", 0.75), (None, "x", 1.0)]
    rounded = op.share(df, scale=100, digits=0)
    assert rows(rounded, "share") == [(12.0,), (38.0,), (50.0,)]  # 12.5 and 37.5 go to even
    assert df.columns == ["g", "k", "n"]


def test_share_has_no_limit(spark):
    df = spark.range(1_000_001).select(F.col("id").alias("k"), F.lit(1).alias("n"), F.lit("g").alias("g"))
    total = F.round(F.sum("share"), 6)
    assert op.share(df).agg(total, F.count("*")).first() == (1.0, 1_000_001)
    assert op.share(df, within=["g"]).agg(total).first()[0] == 1.0
    assert op.with_overall_mean(df, "n").filter("overall_mean <> 1").count() == 0


def test_box_outliers_leave_nan_out(spark, rows):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 99, "nan")] + [(None,)], "x double")
    assert rows(op.box_outliers(df, [], "x")) == [(99.0,)]
    assert rows(op.box_stats(df, [], "x"), "n", "n_outliers") == [(5, 1)]


def test_many_small_groups(spark):
    df = spark.range(6000).select((F.col("id") % 1500).alias("g"), F.col("id").cast("double").alias("x"))
    wrong = op.quantiles(df, ["g"], "x", {"m": 0.5}).filter(F.col("m") != F.col("g") + 2250)
    assert wrong.count() == 0


def test_exclude_drops_missing(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert rows(op.exclude(df, "k", ["a"])) == [("b",)]
    assert rows(op.exclude(df, "k", [])) == [("a",), ("b",)]


def test_fill_where_and_overall_mean(spark, rows):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert rows(op.fill_where(df, "x", F.col("x").isNull(), 0)) == [(0,), (1,), (3,)]
    assert rows(op.with_overall_mean(df, "x"), "overall_mean") == [(2.0,)] * 3


def type7(values, p):
    values = sorted(values)
    h = (len(values) - 1) * p
    lo, hi = values[math.floor(h)], values[math.ceil(h)]
    return lo + (h - math.floor(h)) * (hi - lo)


@pytest.mark.parametrize("accuracy", [10, 50, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    """A coarse sketch forces real brackets; the answers stay exact."""
    rng = np.random.default_rng(7)
    groups = {
        "normal": rng.normal(size=3000).tolist(),
        "ties": rng.integers(0, 4, 2500).astype(float).tolist(),
        "skewed": (rng.pareto(1.0, 1200) * 1e3).tolist(),
        "one": [4.5],
        None: rng.uniform(size=257).tolist(),
    }
    data = [(g, float(v)) for g, values in groups.items() for v in values]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame([*data, ("normal", None)], "g string, x double").repartition(5)
    probs = {"p0": 0.0, "p1": 0.01, "q1": 0.25, "q2": 0.5, "q3": 0.75, "p99": 0.99, "p100": 1.0}
    for row in op.quantiles(df, ["g"], "x", probs, accuracy).collect():
        values = groups[row["g"]]
        assert row["n"] == len(values)
        for name, p in probs.items():
            assert row[name] == pytest.approx(type7(values, p), rel=1e-12), (row["g"], name)


@pytest.mark.parametrize("astray", [False, True])
def test_wide_brackets_are_narrowed(spark, monkeypatch, astray):
    """Brackets of more values than one task may add up, of a hot group, ties and a far tail."""
    quantiles = importlib.import_module("cohortloom.operators.quantiles")

    monkeypatch.setattr(quantiles, "ONE_TASK", 200)
    taken = []

    def watched(base, group, names, ranked, found=quantiles._found):
        if astray and not taken:  # brackets beside their ranks
            off = F.transform("_ranks", lambda r: r.withField("lo", r["hi"] + 1000).withField("hi", r["hi"] + 2000))
            ranked = ranked.withColumn("_ranks", off)
        taken.append(ranked)
        return found(base, group, names, ranked)

    monkeypatch.setattr(quantiles, "_found", watched)
    rng = np.random.default_rng(8)
    groups = {
        "hot": rng.normal(size=30_000), "ties": np.repeat([1.0, 2.0, 3.0], 4000),
        "tail": rng.lognormal(0, 20, 5000), None: rng.normal(size=40),
        "ends": np.concatenate([np.zeros(3000), rng.uniform(0, 1, 2000), np.ones(3000)]),
    }
    df = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values], "g string, x double")
    probs = {"min": 0.0, "q1": 0.25, "median": 0.5, "q99": 0.99, "max": 1.0}
    for row in op.quantiles(df.repartition(6), ["g"], "x", probs, accuracy=100).collect():
        expected = np.quantile(groups[row["g"]], list(probs.values()))
        assert [row[name] for name in probs] == pytest.approx(list(expected), rel=1e-12)
    assert len(taken) == 1 + astray
    inside = df.join(taken[-1].select(F.col("g").alias("h"), F.explode("_ranks").alias("r")), F.col("g").eqNullSafe(F.col("h")))
    inside = inside.filter((F.col("x") > F.col("r.lo")) & (F.col("x") < F.col("r.hi")))
    assert inside.groupBy("g", "r.name").count().agg(F.max("count")).first()[0] <= 2 * 200
    whole = op.quantiles(df.filter("g = 'hot'"), [], "x", {"median": 0.5}, accuracy=100).first()
    assert whole["median"] == pytest.approx(np.median(groups["hot"]), rel=1e-12)


def test_quantiles_without_groups(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "x double")
    assert tuple(op.quantiles(df, [], "x", {"q1": 0.25, "q3": 0.75}).first()) == (4, 1.75, 3.25)


def test_box_summary(spark, rows):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in values], "g string, x double")
    assert rows(op.box_stats(df, ["g"], "x")) == [("a", 6, 2.25, 3.5, 4.75, 1.0, 5.0, 1)]
    assert rows(op.box_stats(df, ["g"], "x", method="hinges")) == [("a", 6, 2.0, 3.5, 5.0, 1.0, 5.0, 1)]
    assert rows(op.box_outliers(df, ["g"], "x")) == [("a", 100.0)]


def test_t_tail_against_published_table():
    # Two-sided 5 % and 1 % points of Student's t.
    for dof, five, one in ((1, 12.706, 63.657), (5, 2.571, 4.032), (30, 2.042, 2.750), (120, 1.980, 2.617)):
        assert t_quantile(0.05, dof) == pytest.approx(five, abs=6e-4)
        assert t_quantile(0.01, dof) == pytest.approx(one, abs=6e-4)
        assert t_two_sided(t_quantile(0.05, dof), dof) == pytest.approx(0.05, rel=1e-9)
    assert t_two_sided(0.0, 7) == pytest.approx(1.0)


@pytest.mark.parametrize(
    "mean_a, mean_b, t, dof, low, high",
    [
        (2.74425, 3.01437, -11.224, 3407.2, -0.3173058, -0.2229344),
        (2.026146, 3.396425, -39.64, 5683.5, -1.438046, -1.302512),
    ],
)
def test_recorded_intervals(mean_a, mean_b, t, dof, low, high):
    difference = mean_a - mean_b
    half = t_quantile(0.05, dof) * abs(difference / t)
    assert difference - half == pytest.approx(low, abs=5e-4)
    assert difference + half == pytest.approx(high, abs=5e-4)


@pytest.mark.parametrize("equal_var", [False, True])
def test_two_sample_test(spark, equal_var):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 40), rng.normal(0.8, 3, 25)
    data = [("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("c", 99.0), ("a", None)]
    got = op.t_test(spark.createDataFrame(data, "g string, x double"), "x", "g", "a", "b", equal_var).first()
    va, vb = a.var(ddof=1), b.var(ddof=1)
    if equal_var:
        dof = 63
        se = math.sqrt((39 * va + 24 * vb) / 63 * (1 / 40 + 1 / 25))
    else:
        se = math.sqrt(va / 40 + vb / 25)
        dof = se**4 / ((va / 40) ** 2 / 39 + (vb / 25) ** 2 / 24)
    t = (a.mean() - b.mean()) / se
    assert (got["n_a"], got["n_b"]) == (40, 25)
    assert got["t"] == pytest.approx(t) and got["df"] == pytest.approx(dof)
    assert got["p_value"] == pytest.approx(t_two_sided(t, dof), rel=1e-9)
    assert got["ci_high"] - got["ci_low"] == pytest.approx(2 * t_quantile(0.05, dof) * se)


def test_two_sample_test_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, x double")
    row = op.t_test(df, "x", "g", "a", "b").first()
    assert row["t"] is None and row["p_value"] is None


def test_logit_against_newton(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(1, 9, 800).astype(float)
    y = (rng.uniform(size=800) < 1 / (1 + np.exp(1.2 - 0.3 * x))).astype(float)
    df = spark.createDataFrame([(float(i), float(j)) for i, j in zip(x, y)] + [(None, 1.0)], "x double, y double")
    design, beta = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        information = design.T @ (design * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(information, design.T @ (y - p))
    errors = np.sqrt(np.diag(np.linalg.inv(information)))
    deviance = -2 * np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))
    got = op.logit_summary(df, "y", ["x"]).collect()
    assert [r["term"] for r in got] == ["(Intercept)", "x"]
    for r, b, e in zip(got, beta, errors):
        assert r["estimate"] == pytest.approx(b, rel=1e-6) and r["std_error"] == pytest.approx(e, rel=1e-6)
        assert r["z"] == pytest.approx(b / e, rel=1e-6)
    assert got[0]["residual_deviance"] == pytest.approx(deviance)
    assert got[0]["aic"] == pytest.approx(deviance + 4)
    assert (got[0]["null_df"], got[0]["residual_df"]) == (799, 798)


def test_logit_counts_scoring_steps(spark):
    """Steps from probabilities 3/4 and 1/4 until the deviance is steady, by dense matrices."""
    rng = np.random.default_rng(12)
    x = np.column_stack([rng.integers(0, 4, 500), rng.integers(0, 3, 500)]).astype(float)
    y = (rng.uniform(size=500) < 1 / (1 + np.exp(2 - x @ [0.7, -0.4]))).astype(float)
    design = np.column_stack([np.ones(500), x])
    p, eta, before, expected = np.where(y == 1, 0.75, 0.25), None, None, 0
    eta = np.log(p / (1 - p))
    while True:
        deviance = -2 * np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))
        if before is not None and abs(deviance - before) < 1e-8 * (abs(deviance) + 0.1):
            break
        before, expected = deviance, expected + 1
        w = p * (1 - p)
        eta = design @ np.linalg.solve(design.T @ (design * w[:, None]), design.T @ (w * eta + y - p))
        p = 1 / (1 + np.exp(-eta))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    assert {r["iterations"] for r in op.logit_summary(df, "y", ["a", "b"]).collect()} == {expected}
