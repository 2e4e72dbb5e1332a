"""Word hashes against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.llm import words as w

LETTERS = st.text(alphabet="aB é\n\t\x0b\x1f日 .", max_size=40)


def hashes_of(texts, **options):
    out = [None] * len(texts)
    for row, stop, hashes, offsets in w.hashed_texts(pa.array(texts, pa.string()), **options):
        for i in range(stop - row):
            out[row + i] = hashes[offsets[i] : offsets[i + 1]].tolist()
    return out


def numbered(texts):
    """Equal words get equal numbers."""
    known = {}
    return [[known.setdefault(x, len(known)) for x in (t or "").encode().split()] for t in texts]


def same_pattern(found, expected):
    known = {}
    return [[known.setdefault(x, len(known)) for x in f] for f in found] == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), LETTERS), max_size=8))
def test_hashes_follow_words(texts):
    assert same_pattern(hashes_of(texts), numbered(texts))


def test_lower_case_is_ascii_only():
    assert hashes_of(["Ab É"], lower=True) == hashes_of(["ab É"])
    assert hashes_of(["É"], lower=True) != hashes_of(["é"], lower=True)


def test_long_texts_and_words_cross_slices(monkeypatch):
    texts = ["aa bb " * 50, "x" * 200 + " aa", "", "y" * 130, "aa", "z" * 64 + " " + "x" * 200]
    whole = hashes_of(texts)
    monkeypatch.setattr(w, "SLICE", 64)
    monkeypatch.setattr(w, "_powers", [])
    assert hashes_of(texts) == whole


def test_words_can_be_cut():
    column = pa.array(["x" * (w.SLICE + 5)])
    assert [len(s.hashes) for s in w.word_slices(column, cut_words=True)] == [1, 1]


def test_rolling_depends_on_order():
    a, b, c = (np.array(x, dtype=np.uint64) for x in ([1, 2, 3], [2, 1, 3], [1]))
    assert w.rolling(a, 2)[0] != w.rolling(b, 2)[0]
    assert len(w.rolling(a, 3)) == 1 and len(w.rolling(c, 2)) == 0
