"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return the
columns of ``docs`` and a part of its rows, or changed texts. A stage first has Spark remove the shuffle
files of those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, neardup, packing, substring, toxicity as toxic
from .frames import cut_lineage, held_out, read, settle


def _set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its own columns of these names renamed, and the columns that bring them back."""
    mapping = {c: f"_aside_{i}" for i, c in enumerate(docs.columns) if c.lower() in names}
    back = [F.col(f"`{mapping.get(c, c)}`").alias(c) for c in docs.columns]
    return docs.withColumnsRenamed(mapping), back


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter or like no profile go.

    A text is like a profile if its cosine is not below what the learning rows of that language and
    about that length have, but for the lowest few (``langid.least_cosines``). Profiles are learned from
    the documents' own ``lang`` where given, except held-out rows. Where no row names a language, nothing
    can be judged and every document with a letter stays.
    """
    settle(spark)
    known = langid.profiles(docs, ~held_out())
    if not known:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    cuts = langid.least_cosines(docs, known, ~held_out())
    docs, columns = _set_aside(docs, "lang_pred", "lang_score", "_lang", "_size", "_least")
    table = [(name, size, cut) for name, row in cuts.items() for size, cut in enumerate(row)]
    least = F.broadcast(spark.createDataFrame(table, "_lang string, _size int, _least double"))
    like = (
        (F.col("lang_pred") == F.col("_lang"))
        & (langid.length_class() == F.col("_size"))
        & (F.col("lang_score") >= F.col("_least"))
    )
    sure = langid.identify(docs, known).filter(F.col("lang_pred") != langid.UNKNOWN)
    return sure.join(least, like).select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not judged toxic by models of the labelled documents left."""
    settle(spark)
    model = toxic.fit(docs, read(spark, sf_dir, "labels"), ~held_out())
    docs, columns = _set_aside(docs, "score", "predicted", "evidence")
    return toxic.score(docs, model).filter("predicted = 0").select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group on shingles of five words: the one with the smallest id.

    A group without ids keeps the smallest digest. Documents without words stay.
    """
    settle(spark)
    found = cut_lineage(neardup.near_duplicates(docs))
    grouped = found.filter("group_id is not null")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    keepers = grouped.groupBy("group_id").agg(F.min(first).alias("first"))
    keepers = keepers.select(
        F.col("group_id").alias("_group"),
        F.col("first.doc_id").alias("_id"),
        F.col("first.text_key").alias("_key"),
    )
    docs, columns = _set_aside(docs, "_group", "_id", "_key", "_md5")
    keyed = docs.withColumn("_md5", F.unhex(F.md5("text")))
    kept = keyed.join(
        keepers, (F.col("_md5") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    )
    repeats = grouped.groupBy("doc_id", "text_key").count().filter("count > 1")
    if not repeats.isEmpty():  # equal rows: one of them stays
        kept = kept.dropDuplicates(["_group"])
    wordless = docs.filter(F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return kept.select(*columns).unionByName(wordless.select(*columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that a repeated window of 35 words covers; ``n_chars`` follows."""
    settle(spark)
    docs, columns = _set_aside(docs, "n_removed", "_key", "_kept")
    found = substring.remove_repeated(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return found.select(*columns)


def packing_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document."""
    settle(spark)
    return packing.pack(docs)


def run(spark: SparkSession, sf_dir: str, stages) -> DataFrame:
    """The stages over documents, cut from each other by a checkpoint."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(stages):
            docs = cut_lineage(docs)
    return docs
