"""Components, near-duplicates and repeated passages against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.llm import neardup, substring
from cohortloom.llm.among import bit_array, bit_set, maybe_among
from cohortloom.llm.automaton import SuffixAutomaton
from cohortloom.llm.components import components, union_find
from cohortloom.llm.frames import read
from cohortloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_by_force(rows, width, percent=80):
    """Rows (position, text) linked on their shingle sets: position -> smallest position reachable."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().translate(LOWER).split()
        runs = {tuple(words[j : j + width]) for j in range(len(words) - width + 1)}
        sets[i] = runs or ({tuple(words)} if words else set())
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = collections.Counter()
    for same in holders.values():
        for a, i in enumerate(same):
            for j in same[a + 1 :]:
                shared[i, j] += 1
    links = [
        (i, j) for (i, j), n in shared.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)
    ]
    return groups_of(links, sets), {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(200)]  # a long chain
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    expected = groups_of([e for e in edges if e[0] != e[1]], nodes)
    assert {r["node"]: r["root"] for r in components(df).collect()} == expected
    assert components(df.limit(0)).count() == 0


def test_union_find():
    nodes, roots = union_find(np.array([5, 7, 1]), np.array([6, 5, 2]))
    assert dict(zip(nodes.tolist(), roots.tolist())) == {1: 1, 2: 1, 5: 5, 6: 5, 7: 5}


def test_bit_tables_lose_nothing(spark):
    df = spark.range(2000)
    keys = spark.range(0, 2000, 7)
    found = {r[0] for r in maybe_among(df, F.col("id"), keys, F.col("id")).select("id").collect()}
    assert found >= set(range(0, 2000, 7)) and len(found) < 400
    table = bit_array(keys.select(F.xxhash64("id").alias("k")), "k")
    values = np.array([r[0] for r in keys.select(F.xxhash64("id")).collect()]).view(np.uint64)
    assert bit_set(table, values).all()


def test_near_duplicates_of_the_table(spark):
    rows = [(r[0], r[1]) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    expected, sizes = near_by_force(rows, 2)
    found = QUERIES["op7_near_duplicates"](spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in found} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_chains_and_crowded_buckets(spark, monkeypatch):
    """Links that do not pass through a bucket's first node, in blocks smaller than the bucket."""
    draw = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for family in range(6):
        words = [*base, *[f"f{family}_{i}" for i in range(9)]]
        for _ in range(12):
            copy = list(words)
            for _ in range(draw.randrange(3)):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(99)}"
            rows.append((len(rows), " ".join(copy)))
    expected, _ = near_by_force(rows, 2)
    monkeypatch.setattr(neardup, "_BLOCK", 7)
    monkeypatch.setattr(neardup, "_SKETCHES", 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, width=2).collect()}
    assert found == expected
    assert 1 < len(set(expected.values())) < len(rows)


def test_common_counts():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 300, n, dtype=np.uint64)) for n in (0, 5, 90, 200, 200, 31)]
    found = neardup.common_counts(sets[:4], sets[2:], columns=16)
    expected = [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:4]]
    assert found.tolist() == expected
    assert neardup.common_counts([], sets).shape == (0, 6)


def test_blocks_hold_every_pair_of_components(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_BLOCK", 3)
    rows = [(1, n, 0 if n < 11 else n // 4) for n in range(30)] + [(2, 40, 40), (2, 41, 41)]
    df = spark.createDataFrame([(*r, 700_000 if r[1] == 12 else 9) for r in rows], "cluster long, node long, root long, n long")
    groups = collections.defaultdict(list)
    for r in neardup._blocks_of_clusters(df).collect():
        groups[r["cluster"], r["i"], r["j"]].append((r["node"], r["root"], r["side"]))
    met = set()
    for members in groups.values():
        left = [(n, r) for n, r, side in members if side <= 1]
        right = [(n, r) for n, r, side in members if side != 1]
        met |= {tuple(sorted((a, b))) for a, ra in left for b, rb in right if ra != rb}
    assert met == {
        (a, b) for c, a, ra in rows for d, b, rb in rows if c == d and ra != rb and a < b
    }


def test_near_duplicates_of_odd_rows(odd, odd_rows, empty):
    found = neardup.near_duplicates(odd).collect()
    assert len(found) == len(odd_rows)
    same = [r for r in found if r["n_shingles"] == 10]
    assert {r["component_id"] for r in same} == {6} and len({r["group_id"] for r in same}) == 1
    blank = [r for r in found if r["n_shingles"] == 0]
    assert all(r["component_id"] == r["doc_id"] and r["group_id"] is None for r in blank)
    assert sorted(str(r["doc_id"]) for r in blank) == ["1", "2", "3", "None"]
    one = [r for r in found if r["doc_id"] in (4, 5) and r["n_shingles"] == 1]
    assert {r["component_id"] for r in one} == {4, 5}  # "another text" repeats the id 5
    assert {r["component_id"] for r in found if r["doc_id"] in (8, 9)} == {8}
    assert neardup.near_duplicates(empty).count() == 0


def test_signature_is_the_papers_minimum():
    """Each place holds the least value that any element's own sequence offers it."""
    draw = np.random.default_rng(5)
    for n in (1, 3, 40):
        elements = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        expected = np.full(16, np.iinfo(np.uint64).max, dtype=np.uint64)
        for e in elements:
            order = list(range(16))
            for step in range(16):
                x = int(neardup.mix(np.array([e + np.uint64((2 * step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))]))[0])
                pick = step + ((x & 0xFFFFFFFF) * (16 - step) >> 32)
                order[step], order[pick] = order[pick], order[step]
                expected[order[step]] = min(int(expected[order[step]]), (step << 32) | (x >> 32))
        found = neardup.super_minhash(elements, np.zeros(n, dtype=np.int64), 1, 16)
        assert found[0].tolist() == expected.tolist()


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(6)
    pool = draw.integers(0, 1 << 63, 1300, dtype=np.uint64)
    a, b = pool[:1000], pool[300:]
    signs = neardup.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], 1000), 2)
    assert abs((signs[0] == signs[1]).mean() - 700 / 1300) < 0.15


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=4), st.lists(st.sampled_from("abcd"), max_size=14))
def test_automaton_matching(passages, text):
    automaton = SuffixAutomaton()
    for p in passages:
        automaton.add(p)
    runs = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    expected = [
        max((n for n in range(1, e + 2) if tuple(text[e + 1 - n : e + 1]) in runs), default=0)
        for e in range(len(text))
    ]
    assert list(automaton.matching(text)) == expected


def stripped_by_force(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = collections.Counter(
        tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1)
    )
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("window", [1, 3, 9, 35])
def test_repeated_passages(spark, window):
    draw = random.Random(window)
    shared = [[f"s{p}_{i}" for i in range(draw.randrange(1, 80))] for p in range(6)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(draw.randrange(5)):
            words += draw.choice(shared) if draw.random() < 0.5 else [f"u{draw.randrange(10**6)}" for _ in range(30)]
            words += draw.choices("ab", k=draw.randrange(50))
        texts.append(draw.choice([" ", "\n"]).join(words))
    texts += [texts[0], texts[0], "", None, "a " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = substring.remove_repeated(df, window=window).orderBy("doc_id").collect()
    for r, text, (removed, kept) in zip(found, texts, stripped_by_force(texts, window)):
        assert (r["n_removed"], r["text"]) == (removed, kept if removed else text)


def test_passages_of_odd_rows(odd, odd_rows, empty):
    found = substring.remove_repeated(odd).collect()
    assert len(found) == len(odd_rows)
    assert set(found[0].asDict()) == set(odd.columns)
    by_force = stripped_by_force([t for _, t, *_ in odd_rows], substring.WINDOW)
    assert sum(r["n_removed"] for r in found) == sum(n for n, _ in by_force)
    assert {r["text"] for r in found if r["doc_id"] == 6} == {""}
    assert substring.remove_repeated(empty).count() == 0


def test_digest_of_words(odd):
    for r in substring.word_digest(odd).select("text", "n_words", "words_sha256").collect():
        words = (r["text"] or "").encode().split()
        assert r["n_words"] == len(words)
        assert r["words_sha256"] == hashlib.sha256(b" ".join(words)).hexdigest()


def test_anchors_are_equal_in_equal_windows():
    draw = np.random.default_rng(1)
    passage = draw.integers(0, 1 << 63, 60, dtype=np.uint64)
    one = np.concatenate([draw.integers(0, 1 << 63, 17, dtype=np.uint64), passage])
    two = np.concatenate([draw.integers(0, 1 << 63, 40, dtype=np.uint64), passage, passage])
    runs_a, place_a = substring._anchors(one, 35)
    runs_b, place_b = substring._anchors(two, 35)
    for i in range(26):
        assert place_a[17 + i] - 17 == place_b[40 + i] - 40 == place_b[100 + i] - 100
        assert runs_a[place_a[17 + i]] == runs_b[place_b[40 + i]]
