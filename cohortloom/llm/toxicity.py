"""Toxicity by two Kneser-Ney models over the bytes of words, one per class.

A word is lower-cased (A-Z) and read as byte n-grams with a start and an end mark. Each class has
interpolated Kneser-Ney counts: token counts at the highest order, continuation counts below. What
the discount takes from a context of a class goes to the class's next shorter order and, a quarter of
it, to one shared model of all documents: interpolated Kneser-Ney over the different words of the corpus,
of orders 5 to 2, so that an n-gram which is rare or missing in a class is also judged by how the whole
corpus goes on.
A text's evidence is the difference of the two log-likelihoods divided by its length; the cut-off is
the best one on labelled documents that the counts did not see, each weighted by how many labelled
documents of its class it stands for, so that it does not move when a class is sampled.

The class counts are fitted on at most ``per_class`` labelled documents of each class (those with the
smallest hash of their id); the shared counts and the scores cover every document. The shared counts
are a distributed table, which grows with the words of the corpus. Only its rows that a class can back
off to are joined out and sent to the tasks: all n-grams whose context ends a context of a class. With
them the probability of any byte after such a context is exact, whether the corpus shows it or not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import added, cut_lineage, emitted
from .words import NO_LETTER, word_slices

ORDER = 5
DISCOUNT = 0.75
PER_CLASS = 20_000
SHARE = 0.25  # of what a class backs off, to the shared counts
_START, _END = 1, 2  # marks; neither byte is part of a word
_CACHE = 1 << 18


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest-order n-grams of words, packed into integers, and the word of each."""
    lengths = ends - starts + ORDER  # start marks, bytes, end mark
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    padded = np.full(offsets[-1], _START, dtype=np.uint64)
    sizes = ends - starts
    word = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded[offsets[word] + ORDER - 1 + inside] = data[starts[word] + inside]
    padded[offsets[1:] - 1] = _END
    keys = np.zeros(len(padded), dtype=np.uint64)
    for j in range(ORDER):
        shift = np.uint64(8 * (ORDER - 1 - j))
        keys[ORDER - 1 :] |= padded[j : len(padded) - ORDER + 1 + j] << shift
    per_word = sizes + 1
    word = np.repeat(np.arange(len(starts)), per_word)
    inside = np.arange(per_word.sum()) - np.repeat(np.cumsum(per_word) - per_word, per_word)
    return keys[offsets[word] + ORDER - 1 + inside], word


class _Seen:
    """A direct-mapped cache from word hashes to values: bounded, and vectorised."""

    def __init__(self):
        self.tags = np.zeros(_CACHE, dtype=np.uint64)
        self.values = np.zeros(_CACHE, dtype=np.float64)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of one occurrence of each value that is not held."""
        out = np.flatnonzero(self.tags[hashes & np.uint64(_CACHE - 1)] != hashes)
        return out[np.unique(hashes[out], return_index=True)[1]] if len(out) else out

    def put(self, hashes: np.ndarray, values) -> None:
        slots = hashes & np.uint64(_CACHE - 1)
        self.tags[slots] = hashes
        self.values[slots] = values


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, place = np.unique(keys, return_inverse=True)
    return unique, np.bincount(place, weights=counts, minlength=len(unique)).astype(np.int64)


def _class_counts(batches):
    """(toxic, gram, n) of the labelled documents of a partition."""
    held = {0: [], 1: []}
    size = {0: 0, 1: 0}

    def flush(label):
        keys, counts = _merged(*(np.concatenate(x) for x in zip(*held[label])))
        held[label], size[label] = [], 0
        arrays = [np.full(len(keys), label, np.int32), keys.astype(np.int64), counts]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["toxic", "gram", "n"])

    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for label in (0, 1):
            texts = batch.column("text").filter(pa.array(toxic == label))
            for words in word_slices(texts, True, NO_LETTER, cut_words=True):
                if not len(words.hashes):
                    continue
                _, first, counts = np.unique(words.hashes, return_index=True, return_counts=True)
                keys, word = _grams(words.data, words.starts[first], words.ends[first])
                held[label].append(_merged(keys, counts[word].astype(np.float64)))
                size[label] += len(held[label][-1][0])
                if size[label] > 1_000_000:
                    yield flush(label)
    for label in (0, 1):
        if held[label]:
            yield flush(label)


def _new_words(batches):
    """Words of a partition; a word seen again and still in the cache is left out."""
    seen = _Seen()
    for batch in batches:
        for words in word_slices(batch.column("text"), True, NO_LETTER, cut_words=True):
            new = seen.missing(words.hashes)
            if len(new):
                seen.put(words.hashes[new], 0.0)
                body = words.data.tobytes()
                found = [body[a:b] for a, b in zip(words.starts[new].tolist(), words.ends[new].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["word"])


def _grams_of_words(batches):
    """(gram, n): how many of a partition's words hold each n-gram of the highest order."""
    held, size = [], 0

    def flush():
        keys, counts = _merged(*(np.concatenate(x) for x in zip(*held)))
        arrays = [pa.array(keys.astype(np.int64)), pa.array(counts)]
        return pa.RecordBatch.from_arrays(arrays, ["gram", "n"])

    for batch in batches:
        body = batch.column("word").to_pylist()
        data = np.frombuffer(b"".join(body), dtype=np.uint8)
        ends = np.cumsum(np.array([len(x) for x in body], dtype=np.int64))
        keys, word = _grams(data, np.concatenate([[0], ends[:-1]]), ends)
        place = np.lexsort((keys, word))
        keys, word = keys[place], word[place]
        once = np.append(True, (keys[1:] != keys[:-1]) | (word[1:] != word[:-1]))
        keys, counts = np.unique(keys[once], return_counts=True)
        held.append((keys, counts.astype(np.float64)))
        size += len(keys)
        if size > 1_000_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def shared_counts(docs: DataFrame, text: str = "text") -> dict[int, DataFrame]:
    """By order, (gram, n) over the corpus: in how many different words an n-gram of the highest order
    stands, and how many different bytes come before a shorter one."""
    words = emitted(docs.select(F.col(text).alias("text")), "word binary", _new_words).distinct()
    grams = emitted(words, "gram long, n long", _grams_of_words).groupBy("gram").agg(F.sum("n").alias("n"))
    tables = {ORDER: cut_lineage(grams)}
    for order in range(ORDER - 1, 1, -1):
        tail = F.col("gram").bitwiseAND((1 << (8 * order)) - 1)
        shorter = tables[order + 1].groupBy(tail.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        tables[order] = cut_lineage(shorter)
    return tables


def _contexts(keys: np.ndarray, order: int) -> np.ndarray:
    """The contexts of this order that end a context of n-grams of the highest order."""
    return np.unique((keys >> np.uint64(8)) & np.uint64((1 << (8 * (order - 1))) - 1))


def backed_counts(tables: dict[int, DataFrame], keys: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows of the shared counts that models of these n-grams can back off to, sorted."""
    out = {}
    for order, table in tables.items():
        if order > 2:
            wanted = pa.table({"context": pa.array(_contexts(keys, order).astype(np.int64))})
            wanted = F.broadcast(table.sparkSession.createDataFrame(wanted))  # bounded by the class sample
            table = table.withColumn("context", F.shiftright("gram", 8)).join(wanted, "context", "left_semi")
        rows = table.select("gram", "n").toArrow()
        grams = rows["gram"].to_numpy().astype(np.uint64)
        place = np.argsort(grams)
        out[order] = grams[place], rows["n"].to_numpy()[place].astype(np.float64)
    return out


def _level(order: int, keys: np.ndarray, counts: np.ndarray):
    """Discounted shares of n-grams, and what each of their contexts leaves to shorter ones."""
    contexts, place = np.unique(keys >> np.uint64(8), return_inverse=True)
    totals = np.bincount(place, weights=counts, minlength=len(contexts))
    kinds = np.bincount(place, minlength=len(contexts))
    seen = np.maximum(counts - DISCOUNT, 0) / totals[place]
    return order, keys, seen, contexts, DISCOUNT * kinds / totals


def _interpolated(levels, grams: np.ndarray, p: np.ndarray, shared: list[np.ndarray] | None = None):
    """Probabilities by the highest order of each level, from the lowest on; ``shared`` has those of the
    shared model. A context that was not seen leaves the probability as it is."""
    out = []
    for i, (order, keys, seen, contexts, backoff) in enumerate(levels):
        tail = grams & np.uint64((1 << (8 * order)) - 1)
        weight = _find(contexts, backoff, tail >> np.uint64(8), -1.0)
        lower = p if shared is None else (1 - SHARE) * p + SHARE * shared[i]
        p = np.where(weight < 0, p, _find(keys, seen, tail, 0.0) + weight * lower)
        out.append(p)
    return out


class _SharedModel:
    """Interpolated Kneser-Ney probabilities of the corpus, right for the contexts of its counts."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        # How many different bytes come before each byte, never zero.
        follows = np.bincount((counts[2][0] & np.uint64(0xFF)).astype(np.int64), minlength=256) + 0.5
        self.base = follows / follows.sum()
        self.levels = [_level(order, *counts[order]) for order in sorted(counts)]

    def probabilities(self, grams: np.ndarray) -> list[np.ndarray]:
        """By order, from 2 on."""
        return _interpolated(self.levels, grams, self.base[(grams & np.uint64(0xFF)).astype(np.int64)])


class _ClassModel:
    """Interpolated Kneser-Ney probabilities of one class."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shared: np.ndarray):
        # Lowest order: the share of word types that a byte follows anything in, never zero.
        follows = shared.reshape(256, 256).sum(axis=0) + 0.5
        self.base = follows / follows.sum()
        self.levels = []
        for order in range(ORDER, 1, -1):
            self.levels.append(_level(order, keys, counts))
            keys, counts = np.unique(keys & np.uint64((1 << (8 * (order - 1))) - 1), return_counts=True)
        self.levels.reverse()

    def log_probability(self, grams: np.ndarray, shared: list[np.ndarray] | None = None) -> np.ndarray:
        """``shared``: the shared model's probabilities by order; without them the class stands alone."""
        p = self.base[(grams & np.uint64(0xFF)).astype(np.int64)]
        return np.log(_interpolated(self.levels, grams, p, shared)[-1])


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


@dataclass
class ToxicityModel:
    """Class counts, shared counts and the fitted cut-off; ``counts`` is empty without both classes."""

    counts: dict[int, tuple[np.ndarray, np.ndarray]]
    shared: dict[int, tuple[np.ndarray, np.ndarray]]
    cut: float = 0.0
    scale: float = 0.01


def _word_scores(counts, shared):
    """A function from words in bytes to their log-likelihood differences."""
    backing = _SharedModel(shared)
    pairs = np.zeros(1 << 16)
    pairs[shared[2][0].astype(np.int64)] = shared[2][1]
    toxic, ordinary = (_ClassModel(*counts[c], pairs) for c in (1, 0))

    def score(data, starts, ends):
        grams, word = _grams(data, starts, ends)
        behind = backing.probabilities(grams)
        gain = toxic.log_probability(grams, behind) - ordinary.log_probability(grams, behind)
        return np.bincount(word, weights=gain, minlength=len(starts))

    return score


def evidence(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``evidence``: difference of the log-likelihoods per byte; 0 without words."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.counts, model.shared))

    def compute():
        score = _word_scores(*shipped.value) if shipped.value[0] else None
        seen = _Seen()

        def work(batch):
            gain, length = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if score is None:
                return [pa.array(gain)]
            for words in word_slices(batch.column(text), True, NO_LETTER, cut_words=True):
                if not len(words.hashes):
                    continue
                new = seen.missing(words.hashes)
                fresh = score(words.data, words.starts[new], words.ends[new]) if len(new) else []
                seen.put(words.hashes[new], fresh)
                slots = words.hashes & np.uint64(_CACHE - 1)
                values = seen.values[slots]
                lost = np.flatnonzero(seen.tags[slots] != words.hashes)  # two new words, one slot
                if len(lost):
                    values[lost] = score(words.data, words.starts[lost], words.ends[lost])
                row = words.row + np.repeat(np.arange(words.stop - words.row), np.diff(words.offsets))
                gain += np.bincount(row, weights=values, minlength=len(gain))
                size = words.ends - words.starts + 1
                length += np.bincount(row, weights=size, minlength=len(gain))
            return [pa.array(gain / np.maximum(length, 1))]

        return work

    return added(docs, [T.StructField("evidence", T.DoubleType())], compute)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    per_class: int = PER_CLASS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> ToxicityModel:
    """Fit on labelled documents for which ``learn`` (an expression of ``doc_id``) holds.

    A fifth of them sets the cut-off, the others give the counts. A document with several labels is
    toxic if one says so; labels that are neither 0 nor 1 are left out. Without documents of both
    classes every evidence is 0 and no document is toxic.
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
        .withColumn("tune", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0)
    )
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    grams = emitted(chosen.filter(~F.col("tune")), "toxic int, gram long, n long", _class_counts)
    found = grams.groupBy("toxic", "gram").agg(F.sum("n").alias("n")).toArrow()
    for label in (0, 1):
        rows = found.filter(pa.compute.equal(found["toxic"], label))
        if rows.num_rows:
            keys = rows["gram"].to_numpy().astype(np.uint64)
            place = np.argsort(keys)
            tables[label] = keys[place], rows["n"].to_numpy()[place].astype(np.float64)
    if len(tables) < 2:
        return ToxicityModel({}, {})
    keys = np.union1d(tables[0][0], tables[1][0])
    model = ToxicityModel(tables, backed_counts(shared_counts(docs, text), keys))
    tuned = evidence(chosen.filter("tune"), model).select("toxic", "evidence").toArrow()
    weights = [max(1.0, totals.get(label, 0) / per_class) for label in (0, 1)]
    toxic = tuned["toxic"].to_numpy()
    model.cut, model.scale = _cut(tuned["evidence"].to_numpy(), toxic, np.array(weights)[toxic])
    return model


def _cut(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The cut-off of the best F1, midway to the next value below, and the spread around it.

    ``weight`` is how many labelled documents each row stands for.
    """
    if not toxic.any() or toxic.all():
        return 0.03, 0.01
    place = np.argsort(-evidence, kind="stable")
    values, hits = evidence[place], np.cumsum((toxic * weight)[place])
    f1 = 2 * hits / (np.cumsum(weight[place]) + hits[-1])
    f1[:-1][values[:-1] == values[1:]] = 0
    best = int(f1.argmax())
    below = values[best + 1] if best + 1 < len(values) else values[best] - 0.02
    return float((values[best] + below) / 2), 0.01


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least 0.5).

    A null or empty text has evidence 0. Rows stay as they are, repeated ones too; columns named
    ``score``, ``predicted`` or ``evidence`` are replaced.
    """
    z = (F.col("evidence") - model.cut) / model.scale
    scored = evidence(docs, model, text)
    scored = scored.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z)))))
    if not model.counts:
        scored = scored.withColumn("score", F.lit(0.0))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
