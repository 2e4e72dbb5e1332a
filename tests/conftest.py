import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cohortloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collected rows as sorted plain tuples."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        found = [tuple(r) for r in picked.collect()]
        return sorted(found, key=lambda r: [(v is None, str(type(v)), v) for v in r])

    return collect


@pytest.fixture
def column(spark):
    """Evaluate a column expression over the values of one input column ``x``."""

    def evaluate(values, kind, build):
        df = spark.createDataFrame(
            [(i, v) for i, v in enumerate(values)], f"i int, x {kind}"
        )
        return [r[0] for r in df.orderBy("i").select(build("x").alias("y")).collect()]

    return evaluate
