"""Word hashes of whole texts, computed in numpy over the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes that are no separators: by default space and the control bytes 9 to
13. Its hash is a 64-bit polynomial over its bytes, finished by a mixer, so equal words have equal
hashes wherever they stand. Texts are taken in slices that fit the cache: beside the hashes, what is
needed is a small multiple of ``SLICE`` bytes, however long a text or a batch is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 17
_BASE = 0x9E3779B97F4A7C15
# Separators: white space, or every ASCII character that is no letter or digit.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NO_LETTER = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    """The words of rows ``row`` to ``stop`` (exclusive), or of a part of the one long text ``row``."""

    row: int
    stop: int
    hashes: np.ndarray  # one per word
    offsets: np.ndarray  # word offsets of the rows, one more than rows
    data: np.ndarray  # bytes of the rows, with separators between them
    starts: np.ndarray  # where each word starts in data
    ends: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64; made once per task."""
    if _powers:
        return _powers
    powers = np.full(SLICE + 1, _BASE, dtype=np.uint64)
    backwards = np.full(SLICE + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    powers[0] = backwards[0] = 1
    _powers.extend([np.cumprod(powers), np.cumprod(backwards)])
    return _powers


def _word_edges(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = separators[data]
    edge = np.empty(len(data) + 1, dtype=np.int8)
    edge[0] = 0 if space[0] else 1
    edge[-1] = 0 if space[-1] else -1
    edge[1:-1] = space[:-1].view(np.int8) - space[1:].view(np.int8)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _slice(row, stop, data, begins, lower, separators) -> Words:
    """The words of at most SLICE bytes; ``begins`` says where the rows begin."""
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return Words(row, stop, none.astype(np.uint64), np.zeros(len(begins), np.int64), data, none, none)
    if lower:
        data = _LOWER[data]
    starts, ends = _word_edges(data, separators)
    powers, backwards = _tables()
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=running[1:])
    hashes = mix((running[ends] - running[starts]) * backwards[starts])
    return Words(row, stop, hashes, np.searchsorted(starts, begins), data, starts, ends)


def _long_word(row: int, data: np.ndarray, lower: bool) -> Words:
    """One word longer than a slice: the same polynomial, slice by slice."""
    powers, _ = _tables()
    total, shift = 0, 1
    for i in range(0, len(data), SLICE):
        part = _LOWER[data[i : i + SLICE]] if lower else data[i : i + SLICE]
        terms = (part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)]
        total = (total + int(terms.sum(dtype=np.uint64)) * shift) % (1 << 64)
        shift = shift * int(powers[SLICE]) % (1 << 64)
    whole = _LOWER[data] if lower else data
    hashes = mix(np.array([total], dtype=np.uint64))
    return Words(row, row + 1, hashes, np.array([0, 1]), whole, np.array([0]), np.array([len(data)]))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and the n + 1 offsets of its values; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, dtype=np.int64)
    places = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    places = places[column.offset : column.offset + n + 1].astype(np.int64)
    has_bytes = data is not None and data.size
    return np.frombuffer(data, dtype=np.uint8) if has_bytes else np.empty(0, np.uint8), places


def word_slices(
    column: pa.Array, lower: bool = False, separators: np.ndarray = SPACE, cut_words: bool = False
) -> Iterator[Words]:
    """The words of a column, slice by slice.

    A slice holds several whole rows or a part of one long row, whose parts follow one another. Only a
    word longer than SLICE makes a longer slice; with ``cut_words`` it is cut into several words.
    """
    body, places = column_bytes(column)
    n = len(places) - 1
    apart = places + np.arange(n + 1)  # with one separator after each text
    row = 0
    while row < n:
        stop = int(np.searchsorted(apart, apart[row] + SLICE, "right")) - 1
        stop = min(max(stop, row + 1), n)
        first, last = int(places[row]), int(places[stop])
        if stop == row + 1:
            yield from _long_text(row, body[first:last], lower, separators, cut_words)
        else:
            count = stop - row
            data = np.full(last - first + count, 0x20, dtype=np.uint8)
            shift = np.repeat(np.arange(count), np.diff(places[row : stop + 1]))
            data[np.arange(last - first) + shift] = body[first:last]
            begins = places[row : stop + 1] - first + np.arange(count + 1)
            yield _slice(row, stop, data, begins, lower, separators)
        row = stop


def _long_text(row, data, lower, separators, cut_words) -> Iterator[Words]:
    at = 0
    while True:
        end = min(at + SLICE, len(data))
        if end < len(data) and not cut_words:
            spaces = np.flatnonzero(separators[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:  # one word fills the slice: find where it ends
                while end < len(data) and not separators[data[end : end + SLICE]].any():
                    end = min(end + SLICE, len(data))
                if end < len(data):
                    end += int(separators[data[end : end + SLICE]].argmax())
                yield _long_word(row, data[at:end], lower)
                at = end
                if at == len(data):
                    return
                continue
        yield _slice(row, row + 1, data[at:end], np.array([0, end - at]), lower, separators)
        at = end
        if at >= len(data):
            return


def hashed_texts(
    column: pa.Array, lower: bool = False, separators: np.ndarray = SPACE
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: first row, one past the last row, word hashes, word offsets of the rows."""
    pending: list[Words] = []
    for words in word_slices(column, lower, separators):
        if pending and words.row != pending[0].row:
            yield _joined(pending)
            pending = []
        if words.stop > words.row + 1:
            yield words.row, words.stop, words.hashes, words.offsets
        else:
            pending.append(words)
    if pending:
        yield _joined(pending)


def _joined(parts: list[Words]) -> tuple[int, int, np.ndarray, np.ndarray]:
    hashes = parts[0].hashes if len(parts) == 1 else np.concatenate([p.hashes for p in parts])
    return parts[0].row, parts[0].stop, hashes, np.array([0, len(hashes)])


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hashes of every ``width`` consecutive values."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    factor = 1
    for j in range(width):
        out += hashes[j : j + n] * np.uint64(factor)
        factor = factor * _BASE % (1 << 64)
    return mix(out)
