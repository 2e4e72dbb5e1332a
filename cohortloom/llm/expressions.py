"""Toxicity by two Kneser-Ney models of words, one per class, over shared backoff counts.

Words are lower-cased (A-Z) runs between ASCII characters that are no letters or digits. A word's count is
the number of different texts that hold it, so that neither a repeated line nor copies of a text say more
than once what they say. A class gives a word ``max(n - DISCOUNT, 0) / total``; what the discount takes goes
to the word's share of the counts of the whole corpus, which all documents are read for. A word that
neither class has more than DISCOUNT times backs off in both to the same share: it says the same about
every text, and is the zero of a word's evidence, the difference of the log-likelihoods.

A text's evidence is the mean over its ``TELLING`` different words of the greatest evidence (a missing one
counts as zero). The mean over all words is not used: class models of a few hundred texts say something by
chance about every ordinary word, and in a long text these sums hide an expression that stands there once.

Counts are fitted on at most ``per_class`` labelled documents of each class (least hash of their id). Only
words that the toxic class has more than DISCOUNT times can have evidence; these, at most some hundred per
document, are sent to the tasks that count and score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import added, cut_lineage, emitted
from .toxicity import PER_CLASS, _cut
from .words import NO_LETTER, hashed_texts, mix

DISCOUNT = 2
TELLING = 3
SCALE = 0.25  # of the evidence, around the cut-off


def _different(column: pa.Array):
    """(row, word hash) of the different words of each text, for runs of whole texts."""
    for first, stop, hashes, offsets in hashed_texts(column, True, NO_LETTER):
        rows = first + np.repeat(np.arange(stop - first), np.diff(offsets))
        pairs = mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        once = np.unique(pairs, return_index=True)[1]
        yield rows[once], hashes[once]


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted values stand among sorted keys, and which of them do."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)


def _words_of_classes(batches):
    """(toxic, word, n): texts of a batch that hold a word."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for rows, words in _different(batch.column("text")):
            for label in (0, 1):
                found, n = np.unique(words[toxic[rows] == label], return_counts=True)
                arrays = [np.full(len(found), label, np.int32), found.view(np.int64), n]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["toxic", "word", "n"])


def shared_counts(docs: DataFrame, words: np.ndarray, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many rows of ``docs`` each of the sorted words stands, and the sum of this over all words."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        keys = shipped.value
        held, total = np.zeros(len(keys), dtype=np.int64), 0
        for batch in batches:
            for _, found in _different(batch.column("text")):
                at, known = _places(keys, found)
                held += np.bincount(at[known], minlength=len(keys))
                total += len(found)
        seen = np.flatnonzero(held)
        arrays = [pa.array(np.append(seen, -1)), pa.array(np.append(held[seen], total))]
        yield pa.RecordBatch.from_arrays(arrays, ["place", "n"])

    rows = emitted(docs.select(F.col(text).alias("text")), "place long, n long", count)
    found = rows.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    shipped.unpersist()
    place, n = found["place"].to_numpy(), found["n"].to_numpy()
    out = np.zeros(len(words), dtype=np.int64)
    out[place[place >= 0]] = n[place >= 0]
    return out, int(n[place < 0].sum())


@dataclass
class Expressions:
    """Words with evidence for the toxic class, sorted by hash, and the fitted cut-off."""

    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    gains: np.ndarray = field(default_factory=lambda: np.empty(0))
    cut: float = 1.0
    fitted: bool = False


def _gains(n, totals, backed, share) -> np.ndarray:
    """Evidence of words: per class (0, 1) their counts, the class's total and what its discount takes."""
    seen = [np.maximum(n[c] - DISCOUNT, 0) / totals[c] for c in (0, 1)]
    left = [backed[c] / totals[c] for c in (0, 1)]
    by_class = [np.log(seen[c] + left[c] * share) - np.log(left[c] * share) for c in (0, 1)]
    return by_class[1] - by_class[0]


def evidence(docs: DataFrame, model: Expressions, text: str = "text") -> DataFrame:
    """``docs`` with ``evidence``; 0 for texts without telling words."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.words, model.gains))

    def compute():
        keys, gains = shipped.value

        def work(batch):
            out = np.zeros(batch.num_rows)
            for rows, words in _different(batch.column(text)):
                at, known = _places(keys, words)
                rows, values = rows[known], gains[at[known]]
                order = np.lexsort((-values, rows))
                rows, values = rows[order], values[order]
                rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
                first = rank < TELLING
                out += np.bincount(rows[first], weights=values[first], minlength=len(out))
            return [pa.array(out / TELLING)]

        return work

    return added(docs, [T.StructField("evidence", T.DoubleType())], compute)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    per_class: int = PER_CLASS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> Expressions:
    """Fit on labelled documents for which ``learn`` (an expression of ``doc_id``) holds.

    About a fifth of their texts sets the cut-off (the best F1, each class weighted by how many documents
    its sample stands for), the others give the counts; equal texts are on the same side. A document with
    several labels is toxic if one says so; labels that are neither 0 nor 1 are left out. Without texts of
    both classes nothing is fitted and no document is toxic.
    """
    marked = (
        labels.select(F.col("doc_id").alias("doc_id"), "toxic")
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learn)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    order = [F.xxhash64("doc_id", F.lit(1)), F.col("doc_id")]
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    # At most per_class rows of each class: bounded, so they may be broadcast.
    sample = marked.filter("toxic = 1").orderBy(*order).limit(per_class).unionByName(
        marked.filter("toxic = 0").orderBy(*order).limit(per_class)
    )
    chosen = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .withColumns({"tune": F.pmod(F.xxhash64("text"), F.lit(5)) == 0, "_md5": F.md5("text")})
    )
    texts = chosen.filter(~F.col("tune")).dropDuplicates(["toxic", "_md5"])
    found = emitted(texts.select("toxic", "text"), "toxic int, word long, n long", _words_of_classes)
    ordinary, toxic = [F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)) for c in (0, 1)]
    counts = cut_lineage(found.groupBy("word").agg(ordinary.alias("n0"), toxic.alias("n1")))
    sums = counts.agg(*[F.sum(n) for n in ("n0", "n1")], *[F.sum(F.least(n, F.lit(DISCOUNT))) for n in ("n0", "n1")])
    n0, n1, backed0, backed1 = (x or 0 for x in sums.first())
    if not n0 or not n1:
        return Expressions()
    # Whatever a word's share, it speaks for the toxic class just if its discounted count is greater there, in
    # units of what the class backs off; no other word needs a share.
    over = [F.greatest(F.col(c) - DISCOUNT, F.lit(0)) / left for c, left in (("n0", backed0), ("n1", backed1))]
    rows = counts.filter(over[1] > over[0]).toArrow()
    words = rows["word"].to_numpy().astype(np.int64).view(np.uint64)
    place = np.argsort(words)
    words, n = words[place], [rows[c].to_numpy()[place].astype(np.float64) for c in ("n0", "n1")]
    held, total = shared_counts(docs, words, text)
    gains = _gains(n, (n0, n1), (backed0, backed1), held / max(total, 1)) if len(words) else np.empty(0)
    model = Expressions(words[gains > 0], gains[gains > 0], fitted=True)
    tuned = evidence(chosen.filter("tune"), model).select("toxic", "evidence").toArrow()
    marks = tuned["toxic"].to_numpy()
    if marks.any() and not marks.all():
        weights = np.array([max(1.0, totals.get(label, 0) / per_class) for label in (0, 1)])
        model.cut, _ = _cut(tuned["evidence"].to_numpy(), marks, weights[marks])
    model.cut = max(model.cut, 0.01)  # a text without telling words is not toxic
    return model


def score(docs: DataFrame, model: Expressions, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least 0.5).

    A null or empty text has evidence 0. Rows stay as they are, repeated ones too; columns named
    ``score``, ``predicted`` or ``evidence`` are replaced.
    """
    z = (F.col("evidence") - model.cut) / SCALE
    scored = evidence(docs, model, text).withColumn("score", 1 / (1 + F.exp(-z)))
    if not model.fitted:
        scored = scored.withColumn("score", F.lit(0.0))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
