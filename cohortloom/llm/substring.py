"""Repeated passages: every word covered by a window of words that starts twice or more in the corpus.

The corpus cannot be one automaton, nor can every text be held against every shard of it. So the
reference is cut down to what repeats, and each text meets only the passages it may contain:

1. Of the eight-word runs in a window, the one with the smallest hash is its anchor. Equal windows
   have equal anchors, so a window whose anchor stands only once in the corpus does not repeat. A bit
   array of fixed size holds the anchors that stand twice or more.
2. Windows with such an anchor are counted by their hash (partial sums first, so a frequent passage
   is no hot key). Those that start twice or more are the reference; each is read from one text.
3. Consecutive windows of that text form passages of bounded length. They go to the texts that hold
   one of their windows.
4. A task builds a suffix automaton over the passages of a few texts (a reference shard of bounded
   size), streams these texts through it and removes every stretch of at least a window's length
   that it accepts. Words are compared as they are, so a chance equality of hashes removes nothing
   that the reference does not hold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .among import bit_array, bit_set, maybe_among
from .automaton import SuffixAutomaton
from .frames import added, cut_lineage, emitted, without
from .words import hashed_texts, rolling

WINDOW = 35
ANCHOR = 8
_PASSAGE = 256  # windows of a passage
_SHARD = 40_000  # words of the passages of a shard
_KEYS_HELD = 500_000
_PLACE = (1 << 24) - 1


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of every ``width`` consecutive values."""
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's anchor runs, and the place of every window's anchor."""
    width = min(ANCHOR, window)
    runs = rolling(hashes, width)
    if len(hashes) < window:
        return runs, np.empty(0, dtype=np.int64)
    mask = np.uint64(_PLACE)
    packed = (runs & ~mask) | (np.arange(len(runs), dtype=np.uint64) & mask)
    best = (_sliding_min(packed, window - width + 1) & mask).astype(np.int64)
    # A place is kept in 24 bits: put back what a longer text has above them.
    start = np.arange(len(best))
    return runs, best + ((start - best + _PLACE) >> 24 << 24)


def _counted(values: list[np.ndarray], names: list[str]):
    unique, counts = np.unique(np.concatenate(values), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(counts)], names)


def _anchor_counts(window: int):
    def work(batches):
        for batch in batches:
            found: list[np.ndarray] = []
            for row, stop, hashes, offsets in hashed_texts(batch.column("text")):
                for a, b in zip(offsets[:-1], offsets[1:]):
                    if b - a >= window:
                        runs, place = _anchors(hashes[a:b], window)
                        found.append(runs[np.unique(place)])
            if found:
                yield _counted(found, ["anchor", "n"])

    return work


def _windows(window: int, table):
    """(window, text, n) for windows whose anchor may repeat."""

    def work(batches):
        bits = table.value
        for batch in batches:
            texts = batch.column("doc").to_numpy()
            for row, stop, hashes, offsets in hashed_texts(batch.column("text")):
                parts = []
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    if b - a < window:
                        continue
                    runs, place = _anchors(hashes[a:b], window)
                    open_ = bit_set(bits, runs)[place]
                    if open_.any():
                        unique, counts = np.unique(rolling(hashes[a:b], window)[open_], return_counts=True)
                        parts.append((unique.view(np.int64), np.full(len(unique), texts[row + i]), counts))
                if parts:
                    arrays = [pa.array(np.concatenate(x)) for x in zip(*parts)]
                    yield pa.RecordBatch.from_arrays(arrays, ["window", "doc", "n"])

    return work


def _passages(window: int):
    """Passages of texts around given windows, with the windows each passage holds."""

    def work(batches):
        for batch in batches:
            found: list[bytes] = []
            held: list[list[int]] = []
            for row, stop, hashes, offsets in hashed_texts(batch.column("text")):
                for i in range(stop - row):
                    words = batch.column("text")[row + i].as_py().encode().split()
                    here = rolling(hashes[offsets[i] : offsets[i + 1]], window).view(np.int64)
                    wanted = np.array(batch.column("windows")[row + i].as_py(), dtype=np.int64)
                    first = np.unique(here, return_index=True)[1]
                    first = np.sort(first[np.isin(here[first], wanted)])
                    # A passage ends where the next window is no neighbour, or where it is full.
                    for run in np.split(first, np.flatnonzero(np.diff(first) > 1) + 1):
                        for at in range(0, len(run), _PASSAGE):
                            part = run[at : at + _PASSAGE]
                            found.append(b" ".join(words[part[0] : part[-1] + window]))
                            held.append(here[part].tolist())
            if found:
                arrays = [pa.array(found, pa.binary()), pa.array(held, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["passage", "windows"])

    return work


def _covered(words: list[bytes], automaton: SuffixAutomaton, window: int) -> np.ndarray:
    """Which words lie in a run of at least ``window`` words that the automaton accepts."""
    matched = np.fromiter(automaton.matching(words), dtype=np.int64, count=len(words))
    ends = np.flatnonzero(matched >= window)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, ends - matched[ends] + 1, 1)
    np.add.at(change, ends + 1, -1)
    return np.cumsum(change[:-1]) > 0


def _stripped(window: int):
    """Texts without what the passages sent to them cover."""

    def work(batches):
        shard: list[tuple[bytes, str, list[bytes]]] = []
        passages: set[bytes] = set()
        size = 0

        def out():
            automaton = SuffixAutomaton()
            for passage in sorted(passages):
                automaton.add(passage.split())
            keys, removed, kept = [], [], []
            for key, text, _ in shard:
                words = text.encode().split()
                gone = _covered(words, automaton, window)
                keys.append(key)
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
            arrays = [pa.array(keys, pa.binary()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, ["text_key", "n_removed", "kept_text"])

        for batch in batches:
            for key, text, found in zip(*(batch.column(c) for c in ("text_key", "text", "passages"))):
                found = found.as_py()
                shard.append((key.as_py(), text.as_py(), found))
                size += sum(p.count(b" ") + 1 for p in found if p not in passages) + len(text.as_py()) // 64
                passages.update(found)
                if size >= _SHARD:
                    yield out()
                    shard, passages, size = [], set(), 0
        if shard:
            yield out()

    return work


def _once_per_task(batches):
    """Rows of texts that a task has not met before: copies are sent once by a task, not once each."""
    seen: set[bytes] = set()
    for batch in batches:
        if len(seen) > _KEYS_HELD:
            seen.clear()
        keys = batch.column("text_key").to_pylist()
        new = []
        for key in keys:
            new.append(key not in seen)
            seen.add(key)
        rows = batch.filter(pa.array(new))
        if rows.num_rows:
            yield rows


def repeated(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(text_key, n_removed, kept_text) of the distinct texts that hold a repeated window.

    ``text_key`` is the MD5 of the text. Equal texts are separate occurrences: all their words go if
    they have at least ``window``.
    """
    keyed = docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull())
    anchors = emitted(keyed, "anchor long, n long", _anchor_counts(window))
    anchors = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
    table = docs.sparkSession.sparkContext.broadcast(bit_array(anchors, "anchor"))

    keyed = keyed.withColumn("doc", F.xxhash64("text"))
    windows = emitted(keyed.select("text", "doc"), "window long, doc long, n long", _windows(window, table))
    reference = cut_lineage(
        windows.groupBy("window")
        .agg(F.sum("n").alias("n"), F.min("doc").alias("doc"))
        .filter("n > 1")
        .select("window", "doc")
    )
    distinct = keyed.withColumn("text_key", F.unhex(F.md5("text")))

    def texts_of(keys: DataFrame) -> DataFrame:
        """Distinct texts, reduced before their one shuffle to those that may be wanted."""
        found = maybe_among(distinct, F.col("doc"), keys, F.col("doc")).select("doc", "text_key", "text")
        once = emitted(found, "doc long, text_key binary, text string", _once_per_task)
        # Partitioned by doc, as the aggregate and the join with the keys need it.
        return once.repartition("doc").groupBy("doc", "text_key").agg(F.first("text").alias("text"))

    by_text = reference.groupBy("doc").agg(F.collect_list("window").alias("windows"))
    passages = cut_lineage(
        emitted(
            texts_of(reference).join(by_text, "doc").select("text", "windows"),
            "passage binary, windows array<long>",
            _passages(window),
        ).withColumn("id", F.monotonically_increasing_id())
    )
    routes = cut_lineage(
        windows.select("window", "doc")
        .join(passages.select("id", F.explode("windows").alias("window")), "window")
        .select("doc", "id")
        .distinct()
    )
    sent = (
        routes.join(passages.select("id", "passage"), "id")
        .groupBy("doc")
        .agg(F.collect_list("passage").alias("passages"))
    )
    meeting = texts_of(routes).join(sent, "doc").select("text_key", "text", "passages")
    schema = "text_key binary, n_removed long, kept_text string"
    return emitted(meeting, schema, _stripped(window)).filter("n_removed > 0")


def word_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``words_sha256``, of all words joined by one space."""

    def compute():
        def work(batch):
            counts, digests = [], []
            for value in batch.column(text):
                words = (value.as_py() or "").encode().split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            return [pa.array(counts, pa.int64()), pa.array(digests, pa.string())]

        return work

    fields = [T.StructField("n_words", T.LongType()), T.StructField("words_sha256", T.StringType())]
    return added(docs, fields, compute)


def remove_repeated(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the text stripped of repeated passages, and ``n_removed``.

    A changed text is its kept words joined by one space, empty if none is left; all others stay as
    they are, null included. Rows stay, repeated ones too; a column ``n_removed`` is replaced.
    """
    found = cut_lineage(repeated(docs, text, window))
    base = without(docs, ["n_removed"])
    names = base.columns
    joined = base.withColumn("_key", F.unhex(F.md5(F.col(text)))).join(
        found.select(F.col("text_key").alias("_key"), "n_removed", F.col("kept_text").alias("_kept")),
        "_key",
        "left",
    )
    changed = F.col("n_removed").isNotNull()
    columns = [
        F.when(changed, F.col("_kept")).otherwise(F.col(c)).alias(c) if c == text else F.col(f"`{c}`")
        for c in names
    ]
    return joined.select(*columns, F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"))


# The query's rows in DuckDB's SQL.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), p AS (
  SELECT k, unnest(range(1, len(w) - 33)) AS i, w FROM d
), g AS (
  SELECT k, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM p
), r AS (
  SELECT k, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)
), c AS (
  SELECT DISTINCT k, unnest(range(i, i + 35)) AS i FROM r
), gone AS (
  SELECT k, list(i) AS x, count(*) AS n FROM c GROUP BY k
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN x IS NULL THEN w ELSE list_transform(
         list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(x, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON d.k = gone.k
"""
