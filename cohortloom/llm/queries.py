"""The operators applied to whole tables, one query each, with the columns their contracts name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, expressions, fingerprint, langid, neardup, negatives, packing, quality, search, sharding, substring, urls, whitening
from .frames import held_out, read


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by given rules, else by rules mined from labels."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, labels).select("page_id", "host", "path", "rule", "verdict")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one by integer inner product."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.top_k(vectors, F.col("vec_id") % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are learned from rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = expressions.fit(docs, read(spark, sf_dir, "labels"), ~held_out())
    scored = expressions.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of all documents with near equal bytes."""
    found = sharding.assign(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str, definition: str | None = None) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded with a public vocabulary."""
    if definition is None:
        import public_tokenizers

        definition = public_tokenizers.path("byte_bpe_50k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.encode(docs, definition, ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents on shingles of two words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = neardup.near_duplicates(docs, width=2)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; profiles are learned from rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = langid.profiles(docs, ~held_out() & F.col("doc_id").isNotNull())
    found = langid.identify(docs.select("doc_id", "text"), known)
    return found.select(
        "doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length buckets of least padding and batches of 32,768 words over all documents."""
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, with its host's verdict."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words that a repeated window of 35 words covers."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring.repeated(docs).withColumn("changed_sha256", F.sha2("kept_text", 256))
    rows = substring.word_digest(docs.withColumn("text_key", F.unhex(F.md5("text")))).drop("text")
    return rows.join(found.drop("kept_text"), "text_key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("changed_sha256", "words_sha256").alias("kept_sha256"),
    )


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    return fingerprint.with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 leading components of all vectors, with unit variance."""
    return whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives of every anchor and positive; every seventh label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_sharding": op5_sharding,
    "op6_bpe": op6_bpe,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_whitening": op11_whitening,
    "op12_fingerprints": op12_fingerprints,
    "op13_hard_negatives": op13_hard_negatives,
}

# The others learn models, hash or encode: SQL cannot express them.
ORACLE: dict[str, str] = {
    "op2_exact_top_k": search.ORACLE,
    "op9_quality_rules": quality.ORACLE,
    "op10_repeated_passages": substring.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
