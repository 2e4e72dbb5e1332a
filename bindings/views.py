"""Driver tables in the roles of enrolments, courses and college spells.

Students are customers, enrolments are orders, courses are the line items of orders, and college
spells are returned line items, whose college is the supplier's nation. One supplier nation plays "no
record": its spells have a blank college and no date.

Analyses that look for spells after a student's last enrolment take as enrolments only the orders
before ``ENROLLED_BEFORE``, so that later spells exist; all others read all orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import age_years, grade_points, term_of_date, zip5
from cohortloom.plans import enrolment, linkage
from cohortloom.sources import crosswalk

AS_OF = "1998-06-15"
ENROLLED_BEFORE = "1998-01-01"
LEVELS = {
    "gender": ("Female", "Male", "Unknown"),
    "ethnicity": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
}
GRADES = {
    "1-URGENT": "A", "2-HIGH": "B+", "3-MEDIUM": "C", "4-NOT SPECIFIED": "P", "5-LOW": "E",
}


def _letter():
    letter = F.when(F.lit(False), "")
    for value, grade in GRADES.items():
        letter = letter.when(F.col("o_orderpriority") == value, grade)
    return letter


def _birth():
    sid = F.col("o_custkey")
    return F.make_date(
        (1978 + sid % 5).cast("int"), (1 + sid % 12).cast("int"), (1 + sid * 7 % 28).cast("int")
    )


def _address():
    code = (F.lit(84000) + F.col("c_nationkey")).cast("string")
    return F.when(F.col("n_name") == "NATION_11", "unknown").otherwise(F.concat(code, F.lit("-1234")))


def _day():
    return F.to_date("o_orderdate")


# Roles of order columns in an enrolment, built when asked for.
ENROLMENT = {
    "sid": lambda: F.col("o_custkey"),
    "enroll_id": lambda: F.col("o_orderkey"),
    "term": lambda: term_of_date(_day()),
    "hs_grad_year": lambda: F.nullif(F.year(_day()), F.lit(1996)),
    "enrolled_after": lambda: F.translate("o_orderstatus", "FOP", "NUY"),
    "ever_nonconcurrent": lambda: F.when(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Y"
    ).when(F.col("o_orderpriority") != "5-LOW", "N"),
    "within_one_year": lambda: F.when(F.col("o_totalprice") > 250000, "Y").otherwise("N"),
    "final_grade": _letter,
    "grade_num": lambda: grade_points(_letter()),
    # Any other letter counts as no points.
    "grade_or_zero": lambda: grade_points(_letter(), other=0),
    "gender": lambda: F.when(F.col("o_orderstatus") == "F", "Female")
    .when(F.col("o_orderstatus") == "O", "Male")
    .otherwise("Unknown"),
    "birth_date": _birth,
    "age_first_day": lambda: age_years(_birth(), _day()),
    "inst_id": lambda: F.concat(F.lit("B"), F.col("o_custkey").cast("string")),
}
# Roles of customer, nation and region columns.
STUDENT = {
    "ethnicity": lambda: F.col("c_mktsegment"),
    "last_name": lambda: F.col("c_name"),
    "pell_eligible": lambda: F.when(F.col("c_acctbal") > 5000, "Y").otherwise("N"),
    "first_generation": lambda: F.when(F.col("c_acctbal") < 0, None)
    .when(F.col("c_acctbal") < 2000, "Y")
    .otherwise("N"),
    "high_school": lambda: F.nullif(F.col("n_name"), F.lit("NATION_7")),
    "campus": lambda: F.col("n_name"),
    "address_zip": _address,
    "zip5": lambda: zip5(_address()),
    "region": lambda: F.col("r_name"),
    "city": lambda: F.col("n_name"),
}
PLACES = ("high_school", "campus", "address_zip", "zip5", "region", "city")
# What a rollup column is made from.
ROLLED = {
    "num_ce": (), "max_ce_term": ("term",), "ce_gpa": ("grade_num",),
    "enrolled_after": ("enrolled_after",), "gender": ("gender",), "ethnicity": ("ethnicity",),
    "birth_date": ("birth_date",),
}


class Views:
    """The roles over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        self._schemas: dict[str, T.StructType] = {}  # read once per table

    def table(self, name: str) -> DataFrame:
        path = f"{self.dir}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def as_of(self):
        return F.lit(AS_OF).cast("date")

    def _orders(self, before: str | None) -> DataFrame:
        orders = self.table("orders")
        if before is None:
            return orders
        return orders.filter(F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz"))

    def ce(self, *columns: str, before: str | None = None) -> DataFrame:
        """Enrolments from orders alone, all or those before a date."""
        return self._orders(before).select(
            *[ENROLMENT[name]().alias(name) for name in columns or ENROLMENT]
        )

    def ce_full(self, *columns: str, before: str | None = None) -> DataFrame:
        """Enrolments with student attributes, school, campus, zip, indicators."""
        wanted = columns or (*ENROLMENT, *STUDENT)
        roles = {**ENROLMENT, **STUDENT}
        joined = self._orders(before).join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey")
        )
        if any(name in PLACES for name in wanted):
            joined = joined.join(
                self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
            ).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(*[roles[name]().alias(name) for name in wanted])

    def school_districts(self) -> DataFrame:
        """Checked crosswalk school -> district; two schools are not in it."""
        return self._nation_region("high_school").filter(~F.col("high_school").isin("NATION_3", "NATION_7"))

    def campus_districts(self) -> DataFrame:
        return self._nation_region("campus")

    def zip_places(self) -> DataFrame:
        """Checked crosswalk zip -> city, region; some zips are not in it."""
        places = (
            self.table("nation")
            .filter(F.col("n_nationkey") < 20)
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                (F.lit(84000) + F.col("n_nationkey")).cast("double").alias("zip5"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("region"),
            )
        )
        return crosswalk(places, "zip5", "city", "region")

    def _nation_region(self, key: str) -> DataFrame:
        pairs = (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_name").alias(key), F.col("r_name").alias("district"))
        )
        return crosswalk(pairs, key, "district")

    def courses(self) -> DataFrame:
        """Course enrolments: line items of the orders."""
        part = self.table("part").select("p_partkey", "p_type", "p_brand")
        line = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        ce = self.ce(
            "sid", "enroll_id", "term", "enrolled_after", "birth_date", "final_grade", "grade_num",
            "grade_or_zero",
        )
        return (
            line.join(ce, F.col("l_orderkey") == F.col("enroll_id"))
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                *ce.columns,
                F.col("l_linenumber").alias("section"),
                F.col("p_type").alias("subject"),
                F.col("p_brand").alias("course_no"),
                F.concat_ws(" ", "p_type", "p_brand").alias("class"),
            )
        )

    def all_spells(self) -> DataFrame:
        """Spells and completions."""
        line = self.table("lineitem").filter(F.col("l_returnflag") == "R")
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("sid"))
        none = F.col("n_name") == "NATION_5"
        day = F.to_date("l_shipdate")
        ymd = F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)
        done = F.col("l_linestatus") == "O"
        # The college comes before the student: filters on it then shrink the join with orders.
        return (
            line.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                "sid",
                F.when(none, "").otherwise(F.col("n_name")).alias("college"),
                F.when(~none, ymd).alias("begin_ymd"),
                F.when(~none, term_of_date(day, (1995, 2000))).alias("term"),
                F.when(none, "N").otherwise("Y").alias("record_found"),
                F.when(done, "Y").otherwise("N").alias("graduated"),
                F.when(done, F.concat(F.lit("AWARD "), F.col("l_linenumber").cast("string"))).alias(
                    "degree_title"
                ),
            )
        )

    def spells(self) -> DataFrame:
        return linkage.completions(self.all_spells(), keep=False)

    def rollup(self, *columns: str, before: str | None = None) -> DataFrame:
        needed = ["sid", *(c for name in columns or ROLLED for c in ROLLED[name])]
        source = self.ce_full if "ethnicity" in needed else self.ce
        return enrolment.student_rollup(source(*needed, before=before), *columns, levels=LEVELS)

    def students(self, *columns: str, before: str | None = None) -> DataFrame:
        """Rollup with ages."""
        ages = {"age_last_term", "age_current"}
        wanted = dict.fromkeys([*(c for c in columns if c not in ages), "max_ce_term", "birth_date"])
        return enrolment.age_at_event(self.rollup(*wanted, before=before), self.as_of())

    def linked(self, *columns: str) -> DataFrame:
        """All spells, with rollup and current age."""
        return linkage.linked_spells(self.all_spells(), self.students(*columns, before=ENROLLED_BEFORE))

    def linked_visits(self) -> DataFrame:
        """Distinct visits of all spells, with the last enrolment term."""
        rollup = self.rollup("max_ce_term", before=ENROLLED_BEFORE)
        return linkage.linked_spells(linkage.visits(self.all_spells()), rollup, null_safe=False)

    def first(self) -> DataFrame:
        return linkage.first_college(self.linked_visits(), ["term", "college", "max_ce_term"])

    def people(self, *columns: str) -> DataFrame:
        """Spells of adults that are not completions."""
        rollup = self.students(*columns, before=ENROLLED_BEFORE)
        return linkage.adult_spells(linkage.linked_spells(self.spells(), rollup))

    def visitors(self) -> DataFrame:
        """The distinct visits among these spells."""
        rollup = self.students(before=ENROLLED_BEFORE)
        linked = linkage.linked_spells(linkage.visits(self.spells()), rollup, null_safe=False)
        return linkage.adult_spells(linked)

    def bindall(self, *columns: str) -> DataFrame:
        """First later college of each adult, or none."""
        return linkage.first_college_or_none(
            self.people(*columns), ["term", "college", "max_ce_term", *columns]
        )

    def zips(self) -> DataFrame:
        return linkage.student_zip(self.ce_full("sid", "enroll_id", "address_zip"), ["enroll_id"])
