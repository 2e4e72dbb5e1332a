"""Language and toxicity: held-out accuracy and odd rows."""

from pyspark.sql import functions as F

from cohortloom.llm import langid, toxicity
from cohortloom.llm.frames import held_out, read
from cohortloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_languages_held_out(spark):
    docs = read(spark, SF, "documents").select("doc_id", "lang")
    found = QUERIES["op8_language_id"](spark, SF)
    right = (
        found.join(docs, "doc_id")
        .filter("held_out")
        .agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"))
        .first()
    )
    assert found.count() == docs.count()
    assert right[0] > 0.99 and right[1] > 1000


def test_toxicity_held_out(spark):
    found = QUERIES["op3_toxicity"](spark, SF).join(read(spark, SF, "labels"), "doc_id")
    rows = found.filter("held_out and toxic is not null").select("toxic", "predicted", "score").collect()
    hits = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hits / sum(r["predicted"] for r in rows) > 0.9
    assert hits / sum(r["toxic"] for r in rows) > 0.5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_language_of_odd_rows(odd, odd_rows, rows):
    known = langid.profiles(odd, ~held_out())
    found = rows(langid.identify(odd, known), "doc_id", "lang_pred", "lang_score")
    assert len(found) == len(odd_rows)
    blank = {i for i, t, *_ in odd_rows if i is not None and not any(c.isalpha() for c in t or "")}
    assert {i for i, lang, score in found if i is not None and lang == "und"} == blank
    assert all(0 <= s <= 1 and (s == 0) == (lang == "und") for _, lang, s in found)


def test_no_language_known(empty, odd):
    assert langid.profiles(empty, ~held_out()) == {}
    assert langid.identify(empty, {}).count() == 0
    assert {r[0] for r in langid.identify(odd, {}).select("lang_pred").collect()} == {"und"}


def test_profiles_do_not_depend_on_partitions(odd):
    one, many = (langid.profiles(odd.repartition(n), ~held_out()) for n in (1, 4))
    assert set(one) == set(many)
    for name in one:
        assert abs(one[name] - many[name]).max() <= 64  # rounded once per task, in units of 2**-20


def test_trigrams_match_a_plain_count():
    binder = langid._Binder(64)
    texts = ["Abc ab", "", "zürich 12 x"]
    import numpy as np

    found = binder.bundles(texts, np.arange(3), 3, even=False)
    for text, vector in zip(texts, found):
        codes = [0]
        for c in text.lower():
            code = ord(c) if c.isalpha() else 0
            if code or codes[-1]:
                codes.append(code)
        if codes[-1]:
            codes.append(0)
        total = np.zeros(64)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            if b:
                parts = [np.ones(64) if x is None else np.asarray(binder._letter(x)) for x in (a, b, c)]
                total += np.roll(parts[0], 2) * np.roll(parts[1], 1) * parts[2]
        assert np.allclose(vector, total)


def test_toxicity_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (5, 1), (5, 0), (6, 0), (8, 0), (9, 0), (10, 1), (None, 1), (13, None), (99, 1)],
        "doc_id long, toxic int",
    )
    model = toxicity.fit(odd, labels, F.lit(True))
    found = toxicity.score(odd, model).select("doc_id", "score", "predicted").collect()
    assert len(found) == len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert {r["predicted"] for r in found if r["doc_id"] in (1, 2, 3)} == {0}
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_without_one_class(spark, odd, empty):
    labels = spark.createDataFrame([(4, 0), (6, 0)], "doc_id long, toxic int")
    for docs in (odd, empty):
        scored = toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True)))
        assert {tuple(r) for r in scored.select("score", "predicted").collect()} <= {(0.0, 0)}


def test_class_model_is_a_distribution():
    import numpy as np

    data = np.frombuffer(b"abcabdxyz", dtype=np.uint8)
    keys, _ = toxicity._grams(data, np.array([0, 3, 6]), np.array([3, 6, 9]))
    keys, counts = np.unique(keys, return_counts=True)
    shared = np.zeros(1 << 16)
    shared[keys.astype(np.int64) & 0xFFFF] = 1
    model = toxicity._ClassModel(keys, counts.astype(float), shared)
    for context in (b"\1\1\1\1", b"\1\1ab", b"qqqq"):
        head = int.from_bytes(context, "big") << 8
        grams = np.array([head | b for b in range(256)], dtype=np.uint64)
        assert abs(np.exp(model.log_probability(grams)).sum() - 1) < 1e-9


def test_class_cap_does_not_move_the_cut(spark, monkeypatch):
    import numpy as np

    seen = []
    plain = toxicity._cut
    monkeypatch.setattr(toxicity, "_cut", lambda *args: seen.append(args) or plain(*args))
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    capped = toxicity.fit(docs, labels, ~held_out(), per_class=400)
    (evidence, toxic, *_), = seen
    marked = {r[0]: r[1] for r in labels.filter(~held_out()).groupBy("toxic").count().collect()}
    # As if every sampled ordinary row stood in the table as often as rows were left out for it.
    times = np.where(toxic == 1, 1, round(marked[0] / 400))
    assert marked[1] <= 400 < marked[0] / 4
    assert abs(capped.cut - plain(np.repeat(evidence, times), np.repeat(toxic, times), np.ones(times.sum()))[0]) < 2e-3


def test_cut_of_a_sampled_class():
    import numpy as np

    draw = np.random.default_rng(3)
    evidence = np.concatenate([draw.normal(0, 1, 80_000), draw.normal(2.5, 1, 10_000)])
    toxic = np.repeat([0, 1], [80_000, 10_000])
    whole, _ = toxicity._cut(evidence, toxic, np.ones(90_000))
    part = np.r_[0:10_000, 80_000:90_000]
    cut, _ = toxicity._cut(evidence[part], toxic[part], np.where(toxic[part] == 1, 1.0, 8.0))
    assert abs(cut - whole) < 0.1
    assert toxicity._cut(evidence[part], toxic[part], np.ones(20_000))[0] < whole - 0.3


def _plain_counts(words):
    """The shared counts by hand: {order: {gram: n}}."""
    tables = {5: {}}
    for word in set(words):
        padded = b"\1\1\1\1" + word + b"\2"
        for gram in {padded[i : i + 5] for i in range(len(word) + 1)}:
            tables[5][gram] = tables[5].get(gram, 0) + 1
    for order in (4, 3, 2):
        tables[order] = {}
        for gram in tables[order + 1]:
            tables[order][gram[1:]] = tables[order].get(gram[1:], 0) + 1
    return {n: {int.from_bytes(g, "big"): c for g, c in t.items()} for n, t in tables.items()}


def test_shared_counts_of_all_orders(spark):
    import numpy as np

    texts = ["banana bandana Band", "banana, aaaaaaaa ananas", None, "", "cabana"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    tables = toxicity.shared_counts(docs)
    plain = _plain_counts([b"banana", b"bandana", b"band", b"aaaaaaaa", b"ananas", b"cabana"])
    assert {n: dict(map(tuple, t.collect())) for n, t in tables.items()} == plain
    # Of the rows, those a class can back off to; any byte after its contexts has the exact probability.
    keys, _ = toxicity._grams(np.frombuffer(b"bandits", np.uint8), np.array([0]), np.array([7]))
    keys = np.unique(keys)
    held = toxicity.backed_counts(tables, keys)
    whole = {n: tuple(np.array(x) for x in zip(*sorted(t.items()))) for n, t in plain.items()}
    whole = {n: (g.astype(np.uint64), c.astype(float)) for n, (g, c) in whole.items()}
    assert 0 < len(held[5][0]) < len(whole[5][0])
    every = ((keys >> np.uint64(8) << np.uint64(8))[:, None] + np.arange(256, dtype=np.uint64)).ravel()
    found, right = (toxicity._SharedModel(x).probabilities(every) for x in (held, whole))
    assert all(np.allclose(a, b, atol=0) for a, b in zip(found, right)) and len(found) == 4
    assert all(np.allclose(p.reshape(-1, 256).sum(axis=1), 1) for p in found)
    model = toxicity._ClassModel(keys, np.ones(len(keys)), np.zeros(1 << 16))
    assert np.allclose(np.exp(model.log_probability(every, found)).reshape(-1, 256).sum(axis=1), 1)


def test_unlabelled_documents_smooth_the_classes(spark):
    rows = [(i, "vile grudge here" if i % 2 else "kind garden here") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    gain = []
    for words in ("other words", "grudger grudged grudging grudges grudgy grudgeon"):
        more = [(100 + i, w) for i, w in enumerate(words.split())]
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        model = toxicity.fit(docs, labels, F.lit(True))
        asked = spark.createDataFrame([(1, "grudgeful"), (2, "zzzz")], "doc_id long, text string")
        gain.append({r["doc_id"]: r["evidence"] for r in toxicity.evidence(asked, model).collect()})
    # The same labelled rows: what a class has not shown is judged by how the whole corpus goes on.
    assert abs(gain[0][1] - gain[1][1]) > 0.01
    assert all(g[1] > 0 for g in gain), gain
