"""The pipeline's stages, their effects and odd rows."""

import corpus_pipeline
from pyspark.sql import functions as F

from cohortloom.llm import stages
from cohortloom.llm.frames import read

SF = "/root/testdata/sf0.01"


def test_stages_in_order():
    names = ["language", "toxicity", "near_duplicates", "repeated_passages", "packing"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names


def test_every_stage_on_odd_rows(spark, odd, odd_rows, empty):
    sf_dir = SF
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, empty):
            out = stage(spark, docs, sf_dir)
            if name != "packing":
                assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            found = out.collect()
            assert len(found) <= docs.count()
            if name != "packing" and found:
                assert {r["group_id"] for r in found} == {"own"}
    kept = stages.near_duplicates(spark, odd, sf_dir).collect()
    same = [r for r in kept if r["text"] and r["text"].startswith("alpha")]
    assert [r["doc_id"] for r in same] == [6]
    assert sum(not (r["text"] or "").strip() for r in kept) == 4  # wordless rows stay


def test_decisions_take_effect(spark):
    docs = read(spark, SF, "documents")
    clean = stages.language(spark, docs, SF)
    assert clean.count() >= 0.99 * docs.filter(F.col("text").rlike(r"\p{L}")).count()
    mild = stages.toxicity(spark, clean, SF)
    gone = clean.join(mild, "doc_id", "left_anti").join(read(spark, SF, "labels"), "doc_id")
    assert gone.filter("toxic = 0").count() <= 2
    single = stages.near_duplicates(spark, mild, SF)
    again = stages.near_duplicates(spark, single, SF)
    assert again.count() == single.count() < mild.count()
    stripped = stages.repeated_passages(spark, single, SF)
    assert stripped.count() == single.count()
    assert stripped.filter("n_chars <> length(text)").count() == single.filter("n_chars <> length(text)").count()
    assert stripped.agg(F.sum("n_chars")).first()[0] < single.agg(F.sum("n_chars")).first()[0]


def test_the_whole_pipeline(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    assert 0 < found.count() <= docs.count()
    assert found.join(docs, "doc_id", "left_anti").count() == 0


def test_gibberish_and_unlearned_languages_go(spark):
    import random

    draw = random.Random(5)
    kinds = {
        "latin": ("abcdefghijklmnopqrstuvwxyz", 9),
        "base64": ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 40),
        "cyrillic": ([chr(c) for c in range(0x430, 0x450)], 9),
        "han": ([chr(c) for c in range(0x4E00, 0x9FFF)], 9),
    }

    def text(letters, most):
        return " ".join("".join(draw.choices(letters, k=draw.randint(2, most))) for _ in range(200))

    docs = read(spark, "/root/testdata/sf0.1", "documents")
    names = [kind for kind in kinds for _ in range(60)]
    rows = [(-1 - i, text(*kinds[kind]), None, kind, 0) for i, kind in enumerate(names)]
    # Longer than nearly all learning rows.
    rows.append((-1000, " ".join(text(*kinds["latin"]) for _ in range(20)), None, "long", 0))
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(more.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    kept = stages.language(spark, both, SF).select("doc_id", "source").collect()
    assert [r["source"] for r in kept if r["doc_id"] is not None and r["doc_id"] < 0] == []
    held = docs.filter(F.col("text").rlike(r"\p{L}")).filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    clean = {r[0] for r in held.select("doc_id").collect()}
    stay = len(clean & {r["doc_id"] for r in kept}) / len(clean)
    assert stay >= 0.995, stay
