"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram of letters is
bound into one vector: the product of its letters' vectors, the first rotated by two places, the
second by one. A document is the bundle (sum) of its trigrams' vectors; a language is the bundle of
its documents, each with the same weight whatever its length. A document gets the language whose profile has the largest
cosine with it.

Text is lower-cased; what is no letter (Unicode) counts as one gap, and a text begins and ends with
one. A text is taken in parts of 131,072 characters, each with gaps around it. Only the profiles leave
the tasks: one vector per language, of integers, so that sums do not depend on their order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import added, emitted

DIM = 512
MOST_COLUMNS = 8192
UNKNOWN = "und"
# A language label is one of a fixed set; ISO 639-3 has fewer than 8,192 codes.
MOST_LANGUAGES = 8192
_RUN = 1 << 17  # characters taken together
_BLOCK = 4096  # rare trigrams bound together
_FIXED = 1 << 20
# Of the learning rows of a language and length, so many have a smaller cosine than the least ...
QUANTILE = 0.005
# ... divided by this, which leaves room for rows that were not learned from.
MARGIN = 0.75
_ROWS = 50  # of a length, or it is taken together with the next
_HALF = 128  # letters at which the cosine of a text is about 0.7 of that of a long one
_LENGTHS = 48
_BINS = 1000


class _Binder:
    """Vectors of letters and trigrams, made when first met.

    The first 127 letters met have short codes, and the first MOST_COLUMNS trigrams of them have a
    column of their own; vectors of all others are made again for every run of texts.
    """

    def __init__(self, dim: int):
        self.dim = dim
        self.known = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        self.letters: dict[int, np.ndarray] = {}
        self.short = np.full(0x110000, -1, dtype=np.int32)
        self.short[0] = 0
        self.n_short = 1
        self.column = np.full(1 << 21, -1, dtype=np.int32)
        self.table = np.empty((0, dim), dtype=np.float32)
        self.of_column = np.empty(0, dtype=np.int64)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            drawn = np.random.default_rng([7, code]).integers(0, 2, self.dim, np.int8)
            self.letters[code] = (drawn * 2 - 1).astype(np.int8)
        return self.letters[code]

    def _place(self, codes: np.ndarray, rotate: int) -> np.ndarray:
        unique, place = np.unique(codes, return_inverse=True)
        return np.stack([np.roll(self._letter(c), rotate) for c in unique.tolist()])[place]

    def bound(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (self._place(a, 2) * self._place(b, 1) * self._place(c, 0)).astype(np.float32)

    def _shorten(self, codes: np.ndarray) -> np.ndarray:
        ids = self.short[codes]
        if (ids < 0).any() and self.n_short < 128:
            for code in np.unique(codes[ids < 0])[: 128 - self.n_short].tolist():
                self.short[code] = self.n_short
                self.n_short += 1
            ids = self.short[codes]
        return ids

    def bundles(self, texts: list[str], groups: np.ndarray, n_groups: int, even: bool) -> np.ndarray:
        """One vector per group of texts; ``even`` gives every text the same weight in its group."""
        out = np.zeros((n_groups, self.dim), dtype=np.float32)
        lowered = [t.lower() for t in texts]
        # A gap before every text and one after the last.
        joined = "\0" + "\0".join(lowered) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int32)
        sizes = np.array([len(t) + 1 for t in lowered])
        owner = np.append(np.repeat(np.arange(len(texts)), sizes), len(texts) - 1)
        codes = np.where(self.known[codes], codes, 0)
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0  # one gap after each word
        keep[0] = True
        codes, owner = codes[keep], owner[keep]
        if len(codes) < 3:
            return out
        ids = self._shorten(codes)
        middle = np.flatnonzero(codes[1:-1] != 0)  # trigrams with a letter in the middle
        owner = owner[middle + 1]
        weight = 1 / np.maximum(np.bincount(owner, minlength=len(texts)), 1) if even else np.ones(len(texts))
        weight, owner = weight[owner], groups[owner]
        a, b, c = ids[middle], ids[middle + 1], ids[middle + 2]
        usual = (a >= 0) & (b >= 0) & (c >= 0)
        index = np.where(usual, (a << 14) | (b << 7) | c, 0)
        column = np.where(usual, self.column[index], -1)
        if (column < 0).any() and len(self.of_column) < MOST_COLUMNS:
            first = np.unique(index[usual & (column < 0)], return_index=True)[0]
            first = first[: MOST_COLUMNS - len(self.of_column)]
            if len(first):
                self.column[first] = len(self.of_column) + np.arange(len(first))
                self.of_column = np.concatenate([self.of_column, first])
                back = np.zeros(128, dtype=np.int64)
                held = np.flatnonzero(self.short >= 0)
                back[self.short[held]] = held
                letters = [back[(first >> shift) & 127] for shift in (14, 7, 0)]
                self.table = np.concatenate([self.table, self.bound(*letters)])
                column = np.where(usual, self.column[index], -1)
        there = column >= 0
        width = len(self.of_column)
        if there.any():
            cells = owner[there] * width + column[there]
            counts = np.bincount(cells, weight[there] if even else None, minlength=n_groups * width)
            out += counts.reshape(n_groups, width).astype(np.float32) @ self.table
        rest = np.flatnonzero(~there)
        for at in range(0, len(rest), _BLOCK):
            part = rest[at : at + _BLOCK]
            spot = middle[part]
            vectors = self.bound(codes[spot], codes[spot + 1], codes[spot + 2])
            np.add.at(out, owner[part], vectors * weight[part, None].astype(np.float32))
        return out


def _runs(texts: list[str | None]):
    """Consecutive texts of about _RUN characters, long ones in parts: (rows, parts)."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(len(text), 1), _RUN):
            rows.append(i)
            parts.append(text[at : at + _RUN])
            size += len(parts[-1])
            if size >= _RUN:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _vectors(column: pa.Array, binder: _Binder) -> np.ndarray:
    """One vector per text of a column."""
    out = np.zeros((len(column), binder.dim), dtype=np.float32)
    for rows, parts in _runs(column.to_pylist()):
        own, place = np.unique(rows, return_inverse=True)
        out[own] += binder.bundles(parts, place, len(own), even=False)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


def profiles(
    docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", dim: int = DIM
) -> dict[str, np.ndarray]:
    """The profile of every language, from the rows for which ``learn`` holds and text and language
    are given."""

    def bundle(batches):
        binder = _Binder(dim)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, place = np.unique(batch.column(1).to_numpy(zero_copy_only=False), return_inverse=True)
            total = np.zeros((len(names), dim))
            for at in range(0, batch.num_rows, 512):
                for rows, parts in _runs(batch.column(0).slice(at, 512).to_pylist()):
                    total += binder.bundles(parts, place[at + np.array(rows)], len(names), even=True)
            for name, vector in zip(names.tolist(), np.rint(total * _FIXED).astype(np.int64)):
                sums[name] = sums.get(name, 0) + vector
        for name, total in sums.items():
            columns = [pa.array([name], pa.string()), pa.array([total.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "vector"])

    rows = docs.filter(learn & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    summed = (
        emitted(rows, "lang string, vector array<long>", bundle)
        .select("lang", F.posexplode("vector").alias("at", "value"))
        .groupBy("lang", "at")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("vector"))
        .limit(MOST_LANGUAGES + 1)
        .collect()
    )
    if len(summed) > MOST_LANGUAGES:
        raise ValueError(f"{lang} has more than {MOST_LANGUAGES} values: it names no languages")
    return {r["lang"]: np.array([x["value"] for x in r["vector"]], dtype=np.float64) for r in summed}


def _pieces(batch: pa.RecordBatch, rows: int = 512):
    """Few rows at a time, so that their vectors stay small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def identify(
    docs: DataFrame, known: dict[str, np.ndarray], text: str = "text", dim: int = DIM
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, the cosine with its profile (not below 0).

    A text that is null or has no letter is ``und`` with score 0, as is every text when no language
    is known. Of equal cosines the first language in the alphabet wins. Rows stay as they are;
    columns of these names are replaced.
    """
    names = sorted(known)
    matrix = _unit(np.stack([known[n] for n in names])).astype(np.float32).T if names else None
    shipped = docs.sparkSession.sparkContext.broadcast(matrix)

    def compute():
        binder = _Binder(dim)

        def work(batch):
            found: list[str] = []
            scores: list[float] = []
            for part in _pieces(batch):
                vectors = _vectors(part.column(text), binder)
                blank = ~vectors.any(axis=1)
                if matrix_of := shipped.value is not None:
                    cosines = _unit(vectors) @ shipped.value
                    best = cosines.argmax(axis=1)
                    top = np.clip(cosines[np.arange(len(best)), best], 0, 1)
                for i in range(part.num_rows):
                    unknown = blank[i] or not matrix_of
                    found.append(UNKNOWN if unknown else names[best[i]])
                    scores.append(0.0 if unknown else float(top[i]))
            return [pa.array(found, pa.string()), pa.array(scores, pa.float64())]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    return added(docs, fields, compute)


def length_class(text: str = "text") -> Column:
    """How often the number of a text's letters doubles from one."""
    letters = F.length(F.regexp_replace(F.col(text), r"\P{L}+", ""))
    return F.least(F.floor(F.log2(F.greatest(letters, F.lit(1)))), F.lit(_LENGTHS - 1)).cast("int")


def _least_by_length(counts: np.ndarray) -> list[float]:
    """The least cosine per length class, from counts by length class and cosine.

    Lengths are taken together from the shortest on until they have ``_ROWS`` rows. The cosine of n
    letters goes as the root of n / (n + ``_HALF``), so of such a group the shorter ones have less.
    """
    if not counts.any():  # nothing measured: beyond chance for vectors of this size
        return [4 / DIM**0.5] * _LENGTHS
    expected = np.sqrt(1 / (1 + _HALF / 2.0 ** np.arange(_LENGTHS)))
    groups, start = [], 0
    for end in range(1, _LENGTHS + 1):
        if counts[start:end].sum() >= _ROWS:
            groups.append((start, end))
            start = end
    # What is left of the longest goes with the group before it.
    first = groups.pop()[0] if groups else 0
    groups.append((first, _LENGTHS))
    out: list[float] = []
    for start, end in groups:
        below = np.cumsum(counts[start:end].sum(axis=0))
        cut = MARGIN * int(np.searchsorted(below, QUANTILE * below[-1], "right")) / _BINS
        top = start + int(np.flatnonzero(counts[start:end].any(axis=1))[-1])
        out += [float(cut * min(1, expected[size] / expected[top])) for size in range(start, end)]
    return out


def least_cosines(
    docs: DataFrame, known: dict[str, np.ndarray], learn: Column, text: str = "text", lang: str = "lang"
) -> dict[str, list[float]]:
    """By language and length class, the cosine below which a text is not in that language.

    Set from the learning rows that their own profile wins. Only counts by language, length and a
    thousandth of the cosine leave the tasks.
    """
    rows = docs.filter(learn & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    found = (
        identify(rows, known)
        .filter(F.col("lang_pred") == F.col("lang"))
        .groupBy("lang", length_class().alias("size"), F.floor(F.col("lang_score") * _BINS).alias("bin"))
        .count()
        .collect()
    )
    counts = {name: np.zeros((_LENGTHS, _BINS + 1), dtype=np.int64) for name in known}
    for row in found:
        counts[row["lang"]][row["size"], row["bin"]] = row["count"]
    return {name: _least_by_length(table) for name, table in counts.items()}
