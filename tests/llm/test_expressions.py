"""Word models of toxicity: by hand on small texts, held-out accuracy, odd rows."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from cohortloom.llm import expressions
from cohortloom.llm.frames import read
from cohortloom.llm.queries import QUERIES
from cohortloom.llm.words import NO_LETTER, hashed_texts

SF = "/root/testdata/sf0.1"
COLUMNS = "doc_id long, text string"


def _words(text):
    return set(re.findall("[a-z0-9]+", (text or "").lower()))


def _texts():
    """Toxic texts hold one of two expressions among common words; some rows are copies."""
    common = [f"word{i}" for i in range(30)]
    rows = []
    for i in range(120):
        mine = common[i % 7 : i % 7 + 12] + [f"rare{i // 2}"]
        if i % 3 == 0:
            mine += [("vile", "Nasty!")[i % 2]] * (1 + i % 4)
        rows.append((i, " ".join(mine)))
    return rows + [(200 + i, rows[0][1]) for i in range(40)] + [(300, None), (301, "")]


def _by_hand(texts, toxic, tune, asked):
    """Evidence of texts, recomputed in plain Python."""
    counts, totals, backed = [{}, {}], [0, 0], [0, 0]
    for c in (0, 1):
        for text in {texts[i] for i in texts if toxic.get(i) == c and not tune[i]}:
            for word in _words(text):
                counts[c][word] = counts[c].get(word, 0) + 1
        totals[c] = sum(counts[c].values())
        backed[c] = sum(min(n, expressions.DISCOUNT) for n in counts[c].values())
    held = {}
    for text in texts.values():
        for word in _words(text):
            held[word] = held.get(word, 0) + 1
    whole = sum(held.values())

    def gain(word):
        out = []
        for c in (0, 1):
            left = backed[c] / totals[c] * held[word] / whole
            seen = max(counts[c].get(word, 0) - expressions.DISCOUNT, 0) / totals[c]
            out.append(math.log(seen + left) - math.log(left))
        return max(out[1] - out[0], 0)

    return {
        i: sum(sorted(map(gain, _words(texts[i])), reverse=True)[: expressions.TELLING]) / expressions.TELLING
        for i in asked
    }


def test_evidence_by_hand(spark):
    texts = dict(_texts())
    toxic = {i: int(i % 3 == 0 or 200 <= i < 300) for i in texts}
    docs = spark.createDataFrame(_texts(), COLUMNS).repartition(5)
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    model = expressions.fit(docs, labels, F.lit(True))
    tune = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(5)) == 0).collect()}
    found = {r["doc_id"]: r["evidence"] for r in expressions.evidence(docs, model).collect()}
    right = _by_hand(texts, toxic, tune, texts)
    assert found.keys() == right.keys()
    assert all(abs(found[i] - right[i]) < 1e-9 for i in texts)
    assert found[300] == found[301] == 0 and sum(v > 0.3 for v in found.values()) >= 40
    judged = {r["doc_id"]: r["predicted"] for r in expressions.score(docs, model).collect()}
    assert judged == {i: int(right[i] >= model.cut) for i in texts}


def test_different_words_count_once_per_text(spark):
    texts = ["A a b", None, "", "b, b; c " * 40_000, "a"]
    words = np.sort(np.concatenate([h for _, _, h, _ in hashed_texts(_array("a b c"), True, NO_LETTER)]))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    held, total = expressions.shared_counts(docs, words)
    assert sorted(held.tolist()) == [1, 2, 2] and total == 5


def _array(*texts):
    import pyarrow as pa

    return pa.array(list(texts))


def test_held_out(spark):
    found = QUERIES["op3_toxicity"](spark, SF).join(read(spark, SF, "labels"), "doc_id")
    rows = found.filter("held_out and toxic is not null").select("toxic", "predicted", "score").collect()
    hits = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hits / sum(r["predicted"] for r in rows) > 0.95
    assert hits / sum(r["toxic"] for r in rows) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (5, 1), (5, 0), (6, 0), (8, 0), (9, 0), (10, 1), (None, 1), (13, None), (99, 1)],
        "doc_id long, toxic int",
    )
    model = expressions.fit(odd, labels, F.lit(True))
    found = expressions.score(odd, model).select("doc_id", "score", "predicted").collect()
    assert len(found) == len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert {r["predicted"] for r in found if r["doc_id"] in (1, 2, 3)} == {0}
    assert expressions.score(empty, model).count() == 0


def test_without_one_class(spark, odd, empty):
    labels = spark.createDataFrame([(4, 0), (6, 0)], "doc_id long, toxic int")
    for docs in (odd, empty):
        scored = expressions.score(docs, expressions.fit(docs, labels, F.lit(True)))
        assert {tuple(r) for r in scored.select("score", "predicted").collect()} <= {(0.0, 0)}


def test_partitions_do_not_matter(spark):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    docs = spark.createDataFrame(_texts(), COLUMNS)
    one, many = (expressions.fit(docs.repartition(n), labels, F.lit(True)) for n in (1, 6))
    assert one.cut == many.cut and (one.words == many.words).all() and (one.gains == many.gains).all()
