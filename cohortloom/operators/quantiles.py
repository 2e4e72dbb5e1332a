"""Exact order statistics, quantiles and box-plot summaries without gathering a group in one task.

A quantile sketch (one small buffer per group) brackets each wanted rank. One pass then counts the
values below each bracket and keeps, as value frequencies, only those inside it; the wanted value is
found by a running count over the bracket. A bracket reaches max(3 / accuracy, 2 / n) of its group to
either side of the rank, rounded up to the next step of a ladder; the sketch errs by at most a third
of that, so the rank lies inside for a group of any size.

Brackets that may hold more values than one task should add up are narrowed first: a round counts
exactly what lies below, at the ends of and inside each bracket, sketches the inside, and keeps the
hundredth or so of it around the rank. A rank that turns out to lie beside its bracket goes on in the
part of the group on that side. So a bracket of any size, and any sketch, ends in the exact value.

The sketch and the values found are checkpointed when the function is called. How brackets are joined is
left to Spark, which broadcasts them while they are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import left_join

ACCURACY = 10_000
LADDER = 10.0
ONE_TASK = 1_000_000  # values of a bracket that one task adds up
PIECES = 200  # parts that a round cuts a wide bracket into


def order_statistics(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    ranks: dict[str, tuple[Column, float]],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Values at given ranks per group.

    ``ranks`` maps an output name to (1-based rank as an expression of the group size ``n``, the
    probability it lies at). Missing values are left out. Returns group, n and one column per rank.
    """
    group = list(group)
    names = list(ranks)
    margins = [3.0 / accuracy]
    while margins[-1] < 1.0:
        margins.append(margins[-1] * LADDER)
    base = df.select(*group, F.col(value).cast("double").alias("_x")).filter(
        F.col("_x").isNotNull() & ~F.isnan("_x")
    )

    # Sketch: group size and, per rank, an interval of values around its probability.
    sides = [d * m for m in margins for d in (-1, 1)]
    probabilities = sorted({min(max(p + d, 0.0), 1.0) for _, p in ranks.values() for d in sides})
    at = {p: i for i, p in enumerate(probabilities)}
    sketch = cut_lineage(
        base.groupBy(*group).agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx("_x", probabilities, accuracy).alias("_cuts"),
        )
    )

    def cut(p: float, side: int) -> Column:
        """End of a bracket; open where it would reach beyond the group."""
        bound = F.lit(side * float("inf"))
        for m in reversed(margins):
            q = p + side * m
            if 0.0 < q < 1.0:
                bound = F.when(m * F.col("n") >= 4, F.col("_cuts")[at[q]]).otherwise(bound)
            else:
                bound = F.when(m * F.col("n") >= 4, F.lit(side * float("inf"))).otherwise(bound)
        return bound

    inside = F.lit(0.0)
    for m in margins:
        inside = F.when(inside == 0, F.when(m * F.col("n") >= 4, 2 * m * F.col("n")).otherwise(0.0)).otherwise(inside)
    ranked = sketch.select(
        *group,
        "n",
        F.when(inside == 0, F.col("n").cast("double")).otherwise(inside).alias("_inside"),
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("name"),
                    rank.cast("long").alias("rank"),
                    cut(p, -1).alias("lo"),
                    cut(p, 1).alias("hi"),
                )
                for name, (rank, p) in ranks.items()
            ]
        ).alias("_ranks"),
    )
    sizes = sketch.select(*group, "n")
    found = _found(base, group, names, _narrowed(base, group, ranked, accuracy))
    missed = [F.col(name).isNull() for name in names]
    lost = _joined(sizes, found, group).filter((F.col("n") > 0) & F.greatest(*missed))
    if not lost.isEmpty():
        # A rank lies beside its bracket: the whole group is its bracket now.
        ends = [F.lit(side * float("inf")).alias(end) for side, end in ((-1, "lo"), (1, "hi"))]
        whole = ranked.join(lost.select(*[F.col(g).alias(f"_of_{g}") for g in group]), _same(group), "left_semi")
        whole = whole.select(
            *group, "n", F.col("n").cast("double").alias("_inside"),
            F.transform("_ranks", lambda r: F.struct(r["name"], r["rank"], *ends)).alias("_ranks"),
        )
        again = _found(base, group, names, _narrowed(base, group, whole, accuracy, certain=True))
        kept = found.join(again.select(*[F.col(g).alias(f"_of_{g}") for g in group]), _same(group), "left_anti")
        found = kept.unionByName(again)
    return _joined(sizes, found, group).select(*group, "n", *names)


def _same(group: list[str]) -> Column:
    """Equal groups, the other side's columns being named ``_of_``."""
    equal = F.lit(True)
    for g in group:
        equal = equal & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return equal


def _joined(sizes: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    return left_join(sizes, found, group) if group else found.withColumn("n", sizes.scalar())


def _probes(base: DataFrame, group: list[str], brackets: DataFrame) -> DataFrame:
    """Every value with each bracket (lo, hi) of its group."""
    joined = left_join(base, brackets, group) if group else base.withColumn("_brackets", brackets.scalar())
    return joined.select(*group, "_x", F.explode("_brackets").alias("_b"))


def _brackets(ranked: DataFrame, group: list[str]) -> DataFrame:
    """Ranks with the same interval share it."""
    intervals = F.array_distinct(F.transform("_ranks", lambda r: F.struct(r["lo"], r["hi"])))
    return ranked.select(*group, intervals.alias("_brackets"))


def _narrowed(
    base: DataFrame, group: list[str], ranked: DataFrame, accuracy: int, certain: bool = False
) -> DataFrame:
    """``ranked`` with brackets that one task can add up.

    The size of a new bracket is estimated; with ``certain`` it is counted, as is whether the rank lies
    in it, before the bracket is taken.
    """
    if certain:
        ranked = ranked.withColumn("_inside", F.lit(ONE_TASK + 1.0))
    while (ranked.agg(F.max("_inside")).first()[0] or 0) > ONE_TASK:
        wide = ranked.filter(F.col("_inside") > ONE_TASK)
        x, lo, hi = F.col("_x"), F.col("_b.lo"), F.col("_b.hi")
        within = F.when((x > lo) & (x < hi), x)
        steps = [i / PIECES for i in range(1, PIECES)]
        rows = base
        if group:
            rows = base.join(wide.select(*[F.col(g).alias(f"_of_{g}") for g in group]), _same(group), "left_semi")
        counted = (
            _probes(rows, group, _brackets(wide, group))
            .groupBy(*group, lo.alias("_lo"), hi.alias("_hi"))
            .agg(
                F.count_if(x < lo).alias("below"),
                F.count_if(x == lo).alias("at_lo"),
                F.count(within).alias("between"),
                F.count_if((x == hi) & (hi > lo)).alias("at_hi"),
                F.min(within).alias("least"),
                F.max(within).alias("most"),
                F.percentile_approx(within, steps, max(accuracy, 50 * PIECES)).alias("cuts"),
            )
        )
        targets = wide.select(
            *[F.col(g).alias(f"_of_{g}") for g in group], F.col("n").alias("_n"), F.explode("_ranks").alias("_r")
        )
        matched = counted.join(targets, _same(group) & (F.col("_lo") == F.col("_r.lo")) & (F.col("_hi") == F.col("_r.hi")))
        place = F.col("_r.rank") - F.col("below") - F.col("at_lo")  # among those between the ends
        piece = F.floor((place - 1) * PIECES / F.col("between")).cast("int")  # 0 to PIECES - 1
        cuts = F.col("cuts")
        from_cut = F.when(piece >= 2, F.greatest(F.get(cuts, piece - 2), F.col("least"))).otherwise(F.col("least"))
        to_cut = F.when(piece <= PIECES - 3, F.least(F.get(cuts, piece + 1), F.col("most"))).otherwise(F.col("most"))
        beyond = F.col("below") + F.col("at_lo") + F.col("between")
        infinity = float("inf")

        def bracket(low: Column, high: Column, size: Column) -> Column:
            size = F.greatest(size, F.lit(ONE_TASK + 1)) if certain else size
            return F.struct(low.alias("lo"), high.alias("hi"), size.cast("double").alias("inside"))

        rank = F.col("_r.rank")
        fits = (rank > F.col("below")) & (rank <= beyond + F.col("at_hi")) & (F.col("between") <= ONE_TASK)
        chosen = (
            F.when(fits, F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.lit(1.0).alias("inside")))
            .when(rank <= F.col("below"), bracket(F.lit(-infinity), F.col("_lo"), F.col("below") + F.col("at_lo")))
            .when(rank <= F.col("below") + F.col("at_lo"), bracket(F.col("_lo"), F.col("_lo"), F.lit(1)))
            .when(rank <= beyond, bracket(from_cut, to_cut, F.col("between") * 4 / PIECES))
            .when(rank <= beyond + F.col("at_hi"), bracket(F.col("_hi"), F.col("_hi"), F.lit(1)))
            .otherwise(bracket(F.col("_hi"), F.lit(infinity), F.col("_n") - beyond))
        )
        narrowed = (
            matched.select(*group, "_n", "_r", chosen.alias("_c"))
            .groupBy(*group)
            .agg(
                F.max("_n").alias("n"),
                F.max("_c.inside").alias("_inside"),
                F.collect_list(F.struct("_r.name", "_r.rank", "_c.lo", "_c.hi")).alias("_ranks"),
            )
        )
        rest = ranked.filter(F.coalesce(F.col("_inside") <= ONE_TASK, F.lit(True)))
        ranked = cut_lineage(rest.unionByName(narrowed))
    return ranked


def _found(base: DataFrame, group: list[str], names: list[str], ranked: DataFrame) -> DataFrame:
    """The values at the ranks that lie in their brackets: one row per group."""
    # One pass: values below a bracket collapse into one NULL-valued count, values above it drop.
    probes = (
        _probes(base, group, _brackets(ranked, group))
        .filter(F.col("_x") <= F.col("_b.hi"))
        .select(
            *group,
            F.col("_b.lo").alias("_lo"),
            F.col("_b.hi").alias("_hi"),
            F.when(F.col("_x") >= F.col("_b.lo"), F.col("_x")).alias("_x"),
        )
    )
    frequencies = probes.groupBy(*group, "_lo", "_hi", "_x").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group, "_lo", "_hi").orderBy(F.col("_x").asc_nulls_first())
    upto = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    running = frequencies.withColumn("_upto", upto)

    # Each rank picks the value whose running count reaches it.
    wanted = ranked.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.explode("_ranks").alias("_r"))
    reached = (
        (F.col("_lo") == F.col("_r.lo"))
        & (F.col("_hi") == F.col("_r.hi"))
        & (F.col("_upto") >= F.col("_r.rank"))
        & (F.col("_upto") - F.col("_c") < F.col("_r.rank"))
    )
    found = (
        running.join(wanted, reached & _same(group))
        .groupBy(*group)
        .agg(*[F.max(F.when(F.col("_r.name") == n, F.col("_x"))).alias(n) for n in names])
    )
    return cut_lineage(found)


def quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Exact quantiles, interpolated linearly between the two neighbouring order statistics."""
    n = F.col("n")
    ranks: dict[str, tuple[Column, float]] = {}
    for name, p in probs.items():
        ranks[f"_lo_{name}"] = (F.floor((n - 1) * p) + 1, p)
        ranks[f"_hi_{name}"] = (F.ceil((n - 1) * p) + 1, p)
    stats = order_statistics(df, group, value, ranks, accuracy)
    out = []
    for name, p in probs.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        fraction = (n - 1) * p - F.floor((n - 1) * p)
        out.append((lo + fraction * (hi - lo)).alias(name))
    return stats.select(*group, "n", *out)


def _hinges(df, group, value, accuracy) -> DataFrame:
    """Tukey's lower hinge, median and upper hinge (the edges of a base box plot)."""
    n = F.col("n")
    depth = F.floor((n + 3) / 2) / 2
    places = {"q1": (depth, 0.25), "median": ((n + 1) / 2, 0.5), "q3": (n + 1 - depth, 0.75)}
    ranks = {}
    for name, (place, p) in places.items():
        ranks[f"_lo_{name}"] = (F.floor(place), p)
        ranks[f"_hi_{name}"] = (F.ceil(place), p)
    stats = order_statistics(df, group, value, ranks, accuracy)
    middles = [((F.col(f"_lo_{x}") + F.col(f"_hi_{x}")) / 2).alias(x) for x in places]
    return stats.select(*group, "n", *middles)


def _boxes(df, group, value, method, accuracy, reach) -> DataFrame:
    """Box edges and fences per group."""
    if method == "hinges":
        boxes = _hinges(df, group, value, accuracy)
    else:
        probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
        boxes = quantiles(df, group, value, probs, accuracy)
    spread = F.col("q3") - F.col("q1")
    return boxes.select(
        *group, "q1", "median", "q3",
        (F.col("q1") - spread * reach).alias("_lo"),
        (F.col("q3") + spread * reach).alias("_hi"),
    )


def box_stats(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    method: str = "quantiles",
    reach: float = 1.5,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Box summary per group: n, quartiles (or hinges), whisker ends and the number of outliers.

    A whisker ends at the furthest value within ``reach`` box heights of the box.
    """
    group = list(group)
    limits = _boxes(df, group, value, method, accuracy, reach)
    x = F.col(value).cast("double")
    rows = left_join(df.select(*group, x.alias("_x")).na.drop("any", subset=["_x"]), limits, group)
    inside = F.col("_x").between(F.col("_lo"), F.col("_hi"))
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def box_outliers(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    method: str = "quantiles",
    reach: float = 1.5,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """The rows beyond the whiskers, drawn as single points."""
    group = list(group)
    limits = _boxes(df, group, value, method, accuracy, reach).select(*group, "_lo", "_hi")
    x = F.col(value).cast("double")
    return (
        left_join(df.filter(x.isNotNull() & ~F.isnan(x)), limits, group)
        .filter((x < F.col("_lo")) | (x > F.col("_hi")))
        .drop("_lo", "_hi")
    )
