import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string,"
    " n_words string, kept string, shard string, key string, copies string, _key string, group_id string,"
    " text_key string, bands string, length string, bucket string, n_removed string, evidence string"
)
EXTRA = len(SCHEMA.split(",")) - 5
LONG = " ".join(f"word{i % 977} other{i % 1009}" for i in range(20_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, long, tied and repeated rows."""
    same = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 6
    return [
        (1, None, None, None), (None, None, "en", "s"), (2, "", "en", "s"), (3, " \n\t ", None, "s"),
        (4, "one", "en", None), (5, "One", "en", "s"), (5, "One", "en", "s"), (5, "another text", "de", "t"),
        (None, same, "en", "s"), (6, same, "en", "s"), (7, same, "en", "s"), (7, same, "en", "s"),
        (8, LONG, "en", "s"), (9, LONG + " end", "en", "t"), (10, "日本語 テキスト", "ja", "t"),
        (11, "12 34 !!", "en", "s"), (12, "x" * 150_000, "en", "s"), (13, "é" * 3, "fr", "t"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    rows = [(i, t, g, s, None if t is None else len(t), *["own"] * EXTRA) for i, t, g, s in odd_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
