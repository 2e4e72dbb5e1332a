"""Two-sample tests and logistic regression."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import student
from ..session import cut_lineage
from .quantiles import quantiles


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 1000):
        for coefficient in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / ((1.0 + coefficient * d) or tiny)
            c = (1.0 + coefficient / c) or tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return math.exp(log_front) * total / a


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|), of single numbers; ``functions.student`` has it for Columns."""
    return _beta_tail(df / 2, 0.5, df / (df + t * t))


def t_quantile(tail: float, df: float) -> float:
    """The t that |T| exceeds with probability ``tail``."""
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > tail:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > tail else (lo, mid)
    return (lo + hi) / 2


def t_moments(x: Column, group: Column, a, b, equal_var: bool) -> tuple[list[Column], dict]:
    """Aggregates of both samples, and statistic, degrees of freedom and error made from them."""
    aggregates = []
    for side, value in (("a", a), ("b", b)):
        v = F.when(group == F.lit(value), x)
        aggregates += [
            F.count(v).alias(f"n_{side}"),
            F.avg(v).alias(f"mean_{side}"),
            F.var_samp(v).alias(f"var_{side}"),
        ]
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    va, vb = F.col("var_a"), F.col("var_b")
    if equal_var:
        dof = na + nb - 2
        pooled = F.try_divide((na - 1) * va + (nb - 1) * vb, dof)
        se2 = pooled * (1 / na + 1 / nb)
    else:
        ea, eb = F.try_divide(va, na), F.try_divide(vb, nb)
        se2 = ea + eb
        dof = F.try_divide(
            se2 * se2, F.try_divide(ea * ea, na - 1) + F.try_divide(eb * eb, nb - 1)
        )
    se = F.sqrt(se2)
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), se)
    return aggregates, {"std_error": se, "df": dof, "t": t}


def t_test(
    df: DataFrame,
    x: str,
    group: str,
    a,
    b,
    equal_var: bool = False,
    level: float = 0.95,
) -> DataFrame:
    """Two-sided two-sample t test of the means of groups a and b: one row.

    One aggregate over the data; the tail of the t distribution is evaluated on its single result row.
    Missing values are left out. Without spread the statistic is NULL, and so are p and the interval.
    """
    aggregates, derived = t_moments(F.col(x), F.col(group), a, b, equal_var)
    row = (
        df.filter(F.col(group).isin(a, b))
        .agg(*aggregates)
        .withColumns(derived)
    )
    known = F.col("t").isNotNull()
    difference = F.col("mean_a") - F.col("mean_b")
    half_width = F.when(known, student.quantile(1 - level, F.col("df"))) * F.col("std_error")
    return row.select(
        "n_a", "n_b", "mean_a", "mean_b", "std_error", "df", "t",
        F.when(known, student.two_sided_tail(F.col("t"), F.col("df"))).alias("p_value"),
        half_width.alias("_half"), difference.alias("_difference"),
    ).select(
        "n_a", "n_b", "mean_a", "mean_b", "std_error", "df", "t", "p_value",
        (F.col("_difference") - F.col("_half")).alias("ci_low"),
        (F.col("_difference") + F.col("_half")).alias("ci_high"),
    )


def _logit_fit(df: DataFrame, outcome: str, predictors: list[str], max_iter: int, tol: float):
    """Fitted model and the points it was fitted to: rows and share of successes per predictor values."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    columns = [outcome, *predictors]
    counted = (
        df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        .na.drop("any")
        .groupBy(*predictors)
        .agg(F.count(F.lit(1)).cast("double").alias("_weight"), F.avg(outcome).alias("_share"))
    )
    points = cut_lineage(VectorAssembler(inputCols=predictors, outputCol="_x").transform(counted))
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="_x", labelCol="_share", weightCol="_weight",
        maxIter=max_iter, tol=tol,
    ).fit(points)
    return model, points


def _linear(model, predictors: list[Column]) -> Column:
    value = F.lit(float(model.intercept))
    for weight, x in zip(model.coefficients, predictors, strict=True):
        value = value + F.lit(float(weight)) * x
    return value


def _scoring_steps(points: DataFrame, predictors: list[str], max_iter: int, tol: float) -> int:
    """Steps of Fisher scoring until the deviance changes by less than ``tol`` of itself.

    The search starts where every success has probability 3/4 and every failure 1/4. A step is one
    aggregate over the value combinations.
    """
    hits = F.col("_weight") * F.col("_share")
    sides = F.array(
        F.struct(F.lit(1.0).alias("y"), hits.alias("w")),
        F.struct(F.lit(0.0).alias("y"), (F.col("_weight") - hits).alias("w")),
    )
    rows = points.select(*predictors, F.explode(sides).alias("_s")).filter(F.col("_s.w") > 0)
    y, w = F.col("_s.y"), F.col("_s.w")
    design = [F.lit(1.0), *[F.col(c) for c in predictors]]
    size = len(design)

    def step(p: Column, eta: Column) -> tuple[np.ndarray, float]:
        """Coefficients after a step from probabilities p, and the deviance before it."""
        weight = w * p * (1 - p)
        target = eta * weight + w * (y - p)
        likely = F.when(y == 1, F.log(p)).otherwise(F.log1p(-p))
        sums = rows.agg(
            F.sum(-2 * w * likely),
            *[F.sum(weight * design[i] * design[j]) for i in range(size) for j in range(i + 1)],
            *[F.sum(target * d) for d in design],
        ).first()
        inner, at = np.zeros((size, size)), 1
        for i in range(size):
            for j in range(i + 1):
                inner[i, j] = inner[j, i] = sums[at]
                at += 1
        return np.linalg.lstsq(inner, np.array(sums[at:], dtype=float), rcond=None)[0], float(sums[0])

    p = F.when(y == 1, 0.75).otherwise(0.25)
    beta, before = step(p, F.log(p / (1 - p)))
    for count in range(1, max_iter + 1):
        eta = sum((F.lit(float(b)) * d for b, d in zip(beta[1:], design[1:])), F.lit(float(beta[0])))
        beta, after = step(1 / (1 + F.exp(-eta)), eta)
        if abs(after - before) < tol * (abs(after) + 0.1):
            return count
        before = after
    return max_iter


def logit_summary(
    df: DataFrame, outcome: str, predictors: list[str], max_iter: int = 25, tol: float = 1e-10
) -> DataFrame:
    """Binomial-logit fit: one row per coefficient, the intercept first.

    Rows are first counted by their distinct predictor values and the fit weights those counts: the
    iterations then run over the value combinations, not over the entities. The counts are
    checkpointed, since every iteration reads them again. Rows with a missing value are left out.
    Deviances are those of the single rows; ``iterations`` are the steps that Fisher scoring takes until
    the deviance changes by less than 1e-8 of itself.
    """
    model, points = _logit_fit(df, outcome, predictors, max_iter, tol)
    fit = model.summary
    linear = _linear(model, [F.col(c) for c in predictors])
    hits = F.col("_weight") * F.col("_share")
    lost = hits * F.log1p(F.exp(-linear)) + (F.col("_weight") - hits) * F.log1p(F.exp(linear))
    total, successes, deviance = points.agg(F.sum("_weight"), F.sum(hits), 2 * F.sum(lost)).first()
    share = successes / total
    likely = sum(q * math.log(q) for q in (share, 1 - share) if q > 0)
    steps = _scoring_steps(points, predictors, max_iter, 1e-8)
    order = [len(predictors), *range(len(predictors))]  # the summary lists the intercept last
    estimates = [*model.coefficients, model.intercept]
    rows = [
        (
            ["(Intercept)", *predictors][position],
            float(estimates[i]),
            float(fit.coefficientStandardErrors[i]),
            float(fit.tValues[i]),
            float(fit.pValues[i]),
            -2 * total * likely,
            int(total) - 1,
            float(deviance),
            int(total) - 1 - len(predictors),
            float(deviance) + 2 * (1 + len(predictors)),
            steps,
        )
        for position, i in enumerate(order)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "term string, estimate double, std_error double, z double, p_value double, "
        "null_deviance double, null_df long, residual_deviance double, residual_df long, "
        "aic double, iterations int",
    )


def logit_residuals(
    df: DataFrame, outcome: str, predictors: list[str], max_iter: int = 25, tol: float = 1e-10
) -> DataFrame:
    """Five-number summary of the deviance residuals of the same fit: one row."""
    model, _ = _logit_fit(df, outcome, predictors, max_iter, tol)
    columns = [F.col(c).cast("double") for c in (outcome, *predictors)]
    y, linear = columns[0], _linear(model, columns[1:])
    p = 1 / (1 + F.exp(-linear))
    size = F.sqrt(-2 * F.log(F.when(y == 1, p).otherwise(1 - p)))
    residual = F.when(y == 1, size).otherwise(-size)
    known = df.na.drop("any", subset=[outcome, *predictors])
    probs = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return quantiles(cut_lineage(known.select(residual.alias("residual"))), [], "residual", probs)
