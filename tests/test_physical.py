"""Plans: what is read, what is shuffled, what happens to a hot key."""

import re

import pytest
from plans_of import plan_of
from pyspark.sql import functions as F

from bindings.views import Views
from __spark_entry__ import queries
from cohortloom import operators as op
from cohortloom.plans import cohorts, enrolment, linkage
from cohortloom.session import SQL_SETTINGS, cut_lineage, tune
from cohortloom.sources import save_by_entity

SF = "/root/testdata/sf0.01"


@pytest.fixture
def conf(spark):
    """Set SQL settings for one test."""
    before = {}

    def set_all(**settings):
        for key, value in settings.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_all
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_schemas(plan: str) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


@pytest.mark.parametrize(
    "name",
    [
        "first_college_top", "cohort_yield", "college_profile", "course_mix", "gpa_welch", "load_ttest",
        "load_welch",
    ],
)
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


@pytest.mark.parametrize(
    "name",
    [
        "first_college_top", "cohort_yield", "college_ever_top", "college_profile", "first_or_none_top",
        "load_welch", "boundary_check",
    ],
)
def test_facts_are_read_once(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    assert len([s for s in read_schemas(plan) if "l_shipdate" in s]) == 1


def test_filter_and_columns_reach_the_scan(spark):
    early = Views(spark, SF).ce("sid", before="1998-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderdate" in early
    plan = queries()["term_headcount"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert set(read_schemas(plan)[0].split(",")) == {"o_custkey:bigint", "o_orderdate:timestamp_ntz"}


def test_counts_combine_before_the_shuffle(spark):
    plan = queries()["course_count_dist"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange")  # printed top-down: below the exchange


def test_crosswalk_is_broadcast_only_while_small(spark, conf):
    v = Views(spark, SF)
    def attached():
        return op.attach_crosswalk(v.ce_full("high_school"), v.school_districts(), "high_school")
    assert "BroadcastHashJoin" in plan_of(attached())
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    assert "Broadcast" not in plan_of(attached())


def test_group_limit_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("n"))
    plan = plan_of(op.top_k(df, 3, ["-n"], within=["g"]))
    assert plan.count("WindowGroupLimit") == 2


def test_global_top_k_is_not_a_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(op.top_k(spark.range(100), 3, ["-id"]))


def test_first_row_reuses_the_join_partitioning(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    rollup = spark.range(500).groupBy((F.col("id") % 50).alias("sid")).count()
    spells = spark.range(5000).select(
        (F.col("id") % 50).alias("sid"), F.col("id").alias("term"), F.lit("A").alias("college")
    )
    plan = plan_of(linkage.latest_spell(rollup, spells))
    assert plan.count("Exchange") == 2  # one per input, none for the join


def hot_spells(spark, n=60_000):
    """A third of all rows belongs to student 0."""
    sid = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997 + 1)
    return spark.range(0, n, 1, 8).select(
        sid.cast("long").alias("sid"),
        (F.col("id") % 40 * 20 + 201200).cast("int").alias("term"),
        F.concat(F.lit("C"), (F.col("id") % 11).cast("string")).alias("college"),
        F.col("id"),
    )


@pytest.fixture
def small_skew(conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        **{k.replace(".", "__"): v for k, v in SQL_SETTINGS.items()},
    )


def test_hot_student_is_split_in_joins(spark, small_skew, rows):
    spells = hot_spells(spark)
    marked = op.with_group_max(spells, ["sid"], "term", "top")
    assert "skewed" in plan_of(marked)
    assert marked.count() == 60_000
    top = {r[0]: r[1] for r in spells.groupBy("sid").agg(F.max("term")).collect()}
    assert all(top[r.sid] == r.top for r in marked.select("sid", "top").distinct().collect())


def test_hot_student_is_split_below_the_first_row(spark, small_skew, rows):
    spells = hot_spells(spark)
    rollup = spells.groupBy("sid").agg((F.min("term") + 100).alias("max_ce_term"))
    first = linkage.first_college(linkage.linked_spells(spells, rollup), ["term", "college"])
    assert "skewed" in plan_of(first)
    expected = {}
    for r in spells.collect():
        expected.setdefault(r.sid, []).append((r.term, r.college))
    got = {r.sid: (r.term, r.college) for r in first.collect()}
    for sid, events in expected.items():
        floor = min(t for t, _ in events) + 100
        later = [e for e in events if e[0] > floor]
        assert got.get(sid) == (min(later) if later else None)


def test_hot_group_quantiles(spark, small_skew):
    df = hot_spells(spark).withColumn("x", F.col("id").cast("double"))
    got = {r.sid: r.m for r in op.quantiles(df, ["sid"], "x", {"m": 0.5}, accuracy=100).collect()}
    assert got[0] == 29998.5  # 0, 3, ..., 59997


def test_rollup_needs_no_sort(spark):
    plan = plan_of(queries()["student_rollup"](spark, SF))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_spells_shrink_before_the_join(spark, small_skew):
    """No shuffle of joined spells: a hot student's spells are distinct visits by then."""
    spells = hot_spells(spark)
    rollup = spells.groupBy("sid").agg((F.min("term") + 100).alias("max_ce_term"))
    linked = linkage.linked_spells(linkage.visits(spells), rollup, null_safe=False)
    first = linkage.first_college(linked, ["term", "college", "max_ce_term"])
    plan = plan_of(first)
    joined = plan.index("Join")
    assert "Exchange" not in plan[:joined]
    assert first.count() == plan_rows(linkage.first_college(linkage.linked_spells(spells, rollup)))


def plan_rows(df) -> int:
    return df.select("sid").distinct().count()


def test_shares_read_no_group_whole(spark):
    df = op.counts(hot_spells(spark), "college", "sid")
    plan = plan_of(op.share(df, within=["college"]))
    assert "Window" not in plan and "ReusedExchange" in plan
    assert "Window" not in plan_of(op.share(df))
    assert "Window" not in plan_of(op.with_overall_mean(df, "n"))


def test_partitions_follow_the_input(spark, conf):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    conf(**{key.replace(".", "__"): "4"})
    tune(spark, input_bytes=100 * 10**12)
    assert int(spark.conf.get(key)) == 745_059


def test_queries_leave_the_session_alone(spark, conf):
    conf(spark__sql__adaptive__forceOptimizeSkewedJoin="false")
    queries()["term_headcount"](spark, SF)
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "false"


def test_checkpoint_cuts_lineage(spark):
    df = cut_lineage(spark.range(10).groupBy((F.col("id") % 2).alias("k")).count())
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert spark.sparkContext.getCheckpointDir() is not None


def test_row_order_and_partitions_do_not_matter(spark, rows):
    ce = Views(spark, "/root/testdata/sf0.001").ce()
    expected = rows(enrolment.grad_year_funnel(ce, 1994, 1998, ["enroll_id"]))
    for seed in (1, 2):
        mixed = ce.orderBy(F.rand(seed)).repartition(5)
        assert rows(enrolment.grad_year_funnel(mixed, 1994, 1998, ["enroll_id"])) == expected


def test_shares_sum_to_one(spark):
    v = Views(spark, SF)
    table = cohorts.destination_top_by_cohort(cohorts.cohort_gap(v.people()), k=1000, by_share=True)
    for row in table.groupBy("max_ce_term").agg(F.sum("pc").alias("s")).collect():
        assert row.s == pytest.approx(1.0)


def test_link_counts_without_joined_rows(spark, small_skew, rows):
    """A hot key with 1000 rows on either side has a million joined rows, and one pair of counts."""
    side = spark.range(3000).select(
        F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("sid"), (F.col("id") % 3).alias("kind")
    )
    right = side.select("sid", F.col("kind").alias("college")).filter("sid < 2000")
    link = op.Link(side, right, ["sid"])
    assert rows(link.size()) == [(1_000_000 + 1000 + 1000, 1000, 2001)]
    counted = link.counts("kind", "college")
    assert rows(counted) == rows(op.counts(link.expand(None), "kind", "college"))
    assert rows(link.counts("college")) == rows(op.counts(link.expand(None), "college"))
    # Rows into the join are distinct ones with their number.
    joined = plan_of(counted)
    assert joined.index("Join") < joined.index("HashAggregate", joined.index("Join"))
    with pytest.raises(ValueError, match="nothing"):
        link.counts("nothing")


def test_hot_pairs_are_dealt_out(spark, small_skew, conf, rows):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    left = spark.range(600).select(F.when(F.col("id") % 2 == 0, None).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(400).select(F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 70).alias("k"), F.col("id").alias("other"))
    link = op.Link(left, right, ["k"])
    plain = rows(link.expand(None), "k", "id", "other")
    assert len(plain) > 30_000 and rows(link.expand(1000), "k", "id", "other") == plain
    assert rows(link.expand(), "k", "id", "other") == plain
    split = link.expand(1000)
    sizes = [r["n"] for r in split.filter("k is null").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1


def test_tables_by_entity_join_without_a_shuffle(spark, conf, tmp_path):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    spells = hot_spells(spark, 9000)
    rollup = spells.groupBy("sid").agg(F.min("term").alias("max_ce_term"))
    try:
        stored = save_by_entity(spells, "t_spells", "sid", 8, "term", str(tmp_path / "spells"))
        rolled = save_by_entity(rollup, "t_rollup", "sid", 8, path=str(tmp_path / "rollup"))
        linked = linkage.linked_spells(stored, rolled, null_safe=False)
        first = linkage.first_college(linked, ["term", "college"])
        plan = plan_of(first)
        assert "Exchange" not in plan and "Join" in plan
        expected = linkage.first_college(linkage.linked_spells(spells, rollup), ["term", "college"])
        assert sorted(map(tuple, first.collect())) == sorted(map(tuple, expected.collect()))
        few = stored.filter(F.col("term") == 201220)
        assert {p.split("/")[-2] for p in few.inputFiles()} == {"term=201220"}
        again = save_by_entity(rollup.limit(5), "t_rollup", "sid", 8, path=str(tmp_path / "rollup"))
        assert again.count() == 5
    finally:
        spark.sql("DROP TABLE IF EXISTS t_spells")
        spark.sql("DROP TABLE IF EXISTS t_rollup")
