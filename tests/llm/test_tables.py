"""Packing, sharding, tokens, URLs, quality and search against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from cohortloom.llm import bpe, packing, quality, search, sharding, urls
from cohortloom.llm.frames import read
from cohortloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == []


# Packing


@pytest.mark.parametrize("seed", range(6))
def test_best_boundaries(seed):
    draw = random.Random(seed)
    tops = sorted(draw.sample(range(1, 60), 9))
    rows = [draw.randrange(1, 20) for _ in tops]

    def cost(chosen):
        return sum(r * min(b for b in chosen if b >= t) for t, r in zip(tops, rows))

    for k in (1, 3, 9, 12):
        found = packing.best_boundaries(np.array(tops), np.array(rows), k)
        options = (c for n in range(1, min(k, 9) + 1) for c in itertools.combinations(tops, n))
        assert cost(found) == min(cost(c) for c in options if c[-1] == tops[-1])
        assert len(found) <= k and found[-1] == tops[-1]


def test_best_boundaries_of_long_histograms():
    """Against the plain recursion, on lengths far apart and with heavy bins."""
    draw = np.random.default_rng(14)
    for size, k in ((400, 7), (300, 16), (50, 1), (2, 5)):
        tops = np.unique((draw.lognormal(6, 2, size)).astype(np.int64) + 1)
        rows = draw.integers(1, 5, len(tops)) * draw.choice([1, 1, 1, 10_000], len(tops))
        n, before = len(tops), np.concatenate([[0], np.cumsum(rows)])
        cost = np.concatenate([[0.0], np.full(n, np.inf)])
        for _ in range(min(k, n)):
            cost = np.array([np.inf] + [min(cost[i] + (before[j] - before[i]) * tops[j - 1] for i in range(j)) for j in range(1, n + 1)])
        found = packing.best_boundaries(tops, rows, k)
        bounds = np.array(found)[np.searchsorted(found, tops)]
        assert len(found) <= k and (bounds * rows).sum() == cost[n]


def check_packing(found, expected, budget):
    assert Counter((r["doc_id"], r["length"]) for r in found) == Counter(expected)
    batches = defaultdict(list)
    for r in found:
        assert r["length"] <= r["boundary"]
        batches[r["bucket"], r["batch"]].append(r)
    last = {}
    for bucket, batch in batches:
        last[bucket] = max(last.get(bucket, 0), batch)
    for (bucket, batch), rows in batches.items():
        most = max(1, budget // max(rows[0]["boundary"], 1))
        assert sorted(r["place"] for r in rows) == list(range(len(rows)))
        assert len(rows) == most or batch == last[bucket] and len(rows) < most
    for bucket in last:
        assert {batch for b, batch in batches if b == bucket} == set(range(last[bucket] + 1))


def words_in(text):
    return len((text or "").encode().split())


def test_packing_of_the_table(spark):
    docs = read(spark, SF, "documents").select("doc_id", "text").collect()
    found = QUERIES["op4_packing"](spark, SF).collect()
    check_packing(found, [(r[0], words_in(r[1])) for r in docs], packing.BUDGET)
    assert sum(r["boundary"] - r["length"] for r in found) < 0.15 * sum(r["length"] for r in found)


def test_packing_of_odd_rows(odd, odd_rows, empty, monkeypatch):
    monkeypatch.setattr(packing, "_PART", 3)
    found = packing.pack(odd, buckets=3, budget=100).collect()
    check_packing(found, [(i, words_in(t)) for i, t, *_ in odd_rows], 100)
    assert packing.pack(empty).count() == 0


# Sharding


def check_shards(found, docs, shards, whole):
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (i, size(t), crc(t)) for i, t in docs
    )
    total = sum(size(t) for _, t in docs)
    largest = max(size(t) for _, t in docs)
    for s in range(shards):
        rows = [r for r in found if r["shard"] == s]
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / shards) <= 2 * (whole * total / shards + largest)


def test_shards_of_the_table(spark):
    docs = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    found = QUERIES["op5_sharding"](spark, SF).collect()
    check_shards(found, docs, 8, sharding.WHOLE)
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)}


def test_shards_split_a_hot_text(spark):
    docs = [(i, "hot text " * 9) for i in range(900)] + [(i, f"text {i} " * (i % 30)) for i in range(1000)]
    docs += [(None, "x")] * 500
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = sharding.assign(df, shards=4).collect()
    check_shards(found, docs, 4, sharding.WHOLE)


def test_equal_texts_stay_together(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WHOLE", 0.1)
    docs = [(i, f"text {i // 4}") for i in range(2000)]
    found = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(len({r["shard"] for r in found if r["doc_id"] // 4 == g}) == 1 for g in range(0, 500, 7))


def test_shards_of_odd_rows(odd, odd_rows, empty):
    found = sharding.assign(odd, shards=3, carry=("lang",)).collect()
    assert len(found) == len(odd_rows) and "lang" in found[0].asDict()
    for s in {r["shard"] for r in found}:
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign(empty).count() == 0


# Tokens


@pytest.fixture(scope="module")
def definition():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(definition):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(definition)


ODD_TEXTS = [
    "", "a", " ", "  a  b ", "é é é", "foo <|endoftext|> bar", "<|endoftext|>x", "I'm you're  we'll",
    "日本語 テスト　全角 空白", "a" * 3000, " \n\n x\n y ", "tab\t x \u0085 y", "a\xa0 b  c 　d", "it 's 's",
    "ab " * 2000, "Ω ω \u0301 x", "\U0001f600 \U0001f600", "\0 \x01 x",
]


def test_tokens_match_the_library(definition, library, monkeypatch):
    encoder = bpe.Encoder(open(definition, encoding="utf-8").read())
    draw = random.Random(1)
    alphabet = [" ", " ", "a", "b", "é", "\xa0", "\n", "'s", "1", ".", "　", "<|endoftext|>", "日", "\t", "Z"]
    texts = ODD_TEXTS + ["".join(draw.choices(alphabet, k=draw.randrange(60))) for _ in range(800)]
    for bits in (1, 3, 9):  # the more edges, the more joins
        monkeypatch.setattr(bpe, "EDGE_BITS", bits)
        for text in texts:
            ids, decoded = encoder.encode(np.frombuffer(text.encode(), dtype=np.uint8))
            expected = library.encode(text, add_special_tokens=False).ids
            assert ids.decode() == ",".join(map(str, expected)), repr(text)
            assert decoded.decode() == library.decode(expected, skip_special_tokens=False)
    assert encoder.reused


def test_other_tokenizers_go_through_the_library():
    paths = pytest.importorskip("public_tokenizers")
    path = paths.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    encoder = bpe.Encoder(open(path, encoding="utf-8").read())
    for text in ["Hello World  again", "", "x" * 900 + " y"]:
        ids, _ = encoder.encode(np.frombuffer(text.encode(), dtype=np.uint8))
        assert ids.decode() == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_special_tokens_with_a_space_are_never_cut(definition):
    """A space inside a special token makes every place unsafe: a long text is one piece."""
    import json

    from tokenizers import Tokenizer

    parsed = json.loads(open(definition, encoding="utf-8").read())
    parsed["added_tokens"].append({
        "id": max(parsed["model"]["vocab"].values()) + 1000, "content": "<a b>", "single_word": False, "lstrip": False,
        "rstrip": False, "normalized": False, "special": True,
    })
    text = json.dumps(parsed)
    library, encoder = Tokenizer.from_str(text), bpe.Encoder(text)
    assert not encoder.cut
    draw = random.Random(9)
    for long in ("".join(draw.choice(["word ", "other", "<a b>", " <a", " b>", "é\n"]) for _ in range(4000)), "<a b> " * 2000):
        ids, decoded = encoder.encode(np.frombuffer(long.encode(), dtype=np.uint8))
        expected = library.encode(long, add_special_tokens=False).ids
        assert ids.decode() == ",".join(map(str, expected))
        assert decoded.decode() == library.decode(expected, skip_special_tokens=False)


def test_tokens_of_the_table(spark, library):
    texts = {r[0]: r[1] or "" for r in read(spark, SF, "documents").select("doc_id", "text").collect()}
    found = QUERIES["op6_bpe"](spark, SF).collect()
    assert len(found) == len(texts)
    for r in found[::7]:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_tokens_round_trip(odd, empty, definition):
    coded = bpe.decode(bpe.encode(odd, definition), definition).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in coded)
    assert {r["n_tokens"] for r in coded if not r["text"]} == {0}
    assert bpe.encode(empty, definition).count() == 0


# URLs


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def given_rule(host, path):
    fits = [
        (len(rule), verdict, rule)
        for verdict, rule in urls.RULES
        if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0]))
        and path.startswith(rule[rule.index("/") :])
    ]
    return max(fits)[1:] if fits else (None, None)


ODD_URLS = [
    None, "", "x", "http://", "http://NET/", "net://a.net", "http://a.net?x=/", "http://example.net/en/1",
    "http://example.net/en", "HTTP://WWW.Example.COM/de/7#a", "http://xexample.com/de/", "http://É.ORG/fr/?q",
    "http://a.org/fr", "a://b://c.net/", "http://u@a.net:80/x y\nz", "http://a.net/#", "://net/",
]


def test_urls_of_the_table(spark):
    pages = [tuple(r) for r in read(spark, SF, "pages").select("page_id", "url").collect()]
    found = {r["page_id"]: r for r in QUERIES["op1_url_filters"](spark, SF).collect()}
    assert len(found) == len(pages)
    for i, url in pages:
        host, path = url_parts(url)
        verdict, rule = given_rule(host, path)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule)
        assert found[i]["verdict"] in ("allow", "block") and verdict in (None, found[i]["verdict"])


def test_odd_urls(spark):
    pages = [(i, u, "x") for i, u in enumerate(ODD_URLS)] + [(0, ODD_URLS[4], "x"), (None, ODD_URLS[5], "y")]
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    found = urls.judge(df, labels).collect()
    assert len(found) == len(pages)
    for r in found:
        host, path = url_parts(r["url"])
        verdict, rule = given_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert urls.judge(df.limit(0), labels.limit(0)).count() == 0


def test_mined_rules(spark):
    """Bad labels follow a pair of tokens, not either of them alone."""
    draw = random.Random(4)
    pages, labels = [], []
    for i in range(600):
        site, part = draw.choice(["good", "evil"]), draw.choice(["shop", "news"])
        pages.append((i, f"http://{site}.test/{part}/{i}?q={draw.randrange(9)}"))
        labels.append((i, 0 if (site, part) == ("evil", "shop") else 1, 0))
    df = spark.createDataFrame(pages, "page_id long, url string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for r in urls.judge(df, marked).collect():
        assert (r["verdict"] == "block") == ("evil" in r["url"] and "shop" in r["url"])
    items = df.select(urls.tokens("url").alias("items"), F.col("url").rlike("evil.*shop").alias("bad"))
    rules, classes = urls.mine(items)
    mined = [tuple(r["antecedent"]) for r in rules.collect()]
    assert mined and all({"p:shop"} < set(a) for a in mined)
    assert not any(set(a) < set(b) for a in mined for b in mined)
    assert {r["token"] for r in classes.collect()} >= {"p:shop", "h:evil"}


@pytest.mark.parametrize("seed", range(3))
def test_rules_against_all_combinations(spark, seed):
    """Verdicts on unseen URLs are those of every combination of tokens with support and confidence."""
    draw = random.Random(seed)
    twins = {"a": "t", "b": "u"}  # stand in the same labelled URLs

    def basket(paired):
        chosen = {x for x in "abcdefg" if draw.random() < 0.4}
        return chosen | {twins[x] for x in chosen & set(twins)} if paired else chosen | {x for x in "tu" if draw.random() < 0.4}

    rows = []
    for _ in range(400):
        b = basket(True)
        odds = 0.9 if {"a", "c"} <= b or {"b", "d", "e"} <= b or "g" in b else 0.1
        rows.append((sorted(b), draw.random() < odds))
    combos = []
    for n in range(1, 10):
        for c in itertools.combinations("abcdefgtu", n):
            with_it = [bad for items, bad in rows if set(c) <= set(items)]
            if sum(with_it) >= 20 and sum(with_it) >= 0.6 * len(with_it):
                combos.append(set(c))
    assert combos and any(len(c) > 1 for c in combos)
    rules, classes = urls.mine(spark.createDataFrame(rows, "items array<string>, bad boolean"))
    of = {r["token"]: r["class"] for r in classes.collect()}
    mined = [set(r["antecedent"]) for r in rules.collect()]
    for unseen in [basket(False) for _ in range(500)]:
        held = {of[x] for x in unseen if x in of}
        fits = any(m <= held for m in mined)
        # A combination holds for the tokens that stood in the same URLs as its own.
        same = {x: {of.get(x, x)} for x in "abcdefgtu"}
        assert fits == any(all(any(same[y] == same[x] for y in unseen) for x in c) for c in combos)


def test_many_shared_tokens_are_few_classes(spark):
    """40 bad URLs that share 30 path tokens, alone or with 60 good ones."""
    import time

    shared = "/".join(f"part{i}" for i in range(30))
    for good in (shared, "other"):
        pages = [(i, f"http://s.test/{shared}/x{i}/{i}") for i in range(40)]
        pages += [(i, f"http://s.test/{good}/x{i}/{i}") for i in range(40, 100)]
        df = spark.createDataFrame(pages, "page_id long, url string")
        marks = spark.createDataFrame([(i, int(i >= 40), 0) for i in range(100)], "doc_id long, quality int, toxic int")
        started = time.time()
        blocked = {r["page_id"] for r in urls.judge(df, marks).collect() if r["verdict"] == "block"}
        assert time.time() - started < 40
        assert blocked == (set(range(40)) if good == "other" else set())


# Quality


def counts_of(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(covered),
    )


def test_quality_counts(spark, odd_rows):
    draw = random.Random(2)
    texts = [t for _, t, *_ in odd_rows] + ["a b c d e f a b c d e", "x\nx\n\ny\nx\n \n ", "#a |b| <é>"]
    texts += [" ".join(draw.choices("abc", k=draw.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.base_counts(df).collect():
        expected = counts_of(texts[r["doc_id"]])
        assert tuple(
            r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        ) == expected
        assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])


def test_hosts_decide(spark, empty, odd, odd_rows):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 else "bad", "fine") for i in range(100)]
    rows += [(i, "bad" if i % 10 else good, "foul") for i in range(100, 200)]
    rows += [(200, good, None), (201, "bad", "rare"), (202, good, "rare"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality.judge(df).collect() if r["kept"]}
    assert kept == {i for i in range(100) if i % 10} | {200, 202}
    assert quality.judge(odd).count() == len(odd_rows)
    assert quality.judge(empty).count() == 0


@pytest.mark.parametrize("usual, foul, rejected", [(15, 50, {"h0"}), (60, 60, set()), (3, 20, {"h0"}), (15, 20, set())])
def test_hosts_are_judged_against_the_corpus(spark, usual, foul, rejected):
    """Percent of failing documents: of all hosts but one, and of that one; a small host is given time."""
    rows = []
    for h in range(20):
        rate = foul if h == 0 else usual
        rows += [(f"h{h}", i * 37 % 100 < rate) for i in range(300)]
    rows += [("small", True), ("small", False)]
    judged = spark.createDataFrame(rows, "host string, failed boolean")
    found = quality.host_verdicts(judged, "host", F.col("failed")).collect()
    assert {r["host"] for r in found if not r["host_ok"]} == rejected
    # The rule by hand.
    n, f = {r["host"]: 300 for r in found} | {"small": 2}, {"small": 1}
    for h, bad in rows:
        f[h] = f.get(h, 0) + (bad and h != "small")
    mean = sum(f.values()) / sum(n.values())
    spread = np.mean([(f[h] / n[h] - mean) ** 2 for h in n])
    m = min(1000, max(1, mean * (1 - mean) / spread - 1))
    for r in found:
        h = r["host"]
        rate = (f[h] + mean * m) / (n[h] + m)
        assert r["host_rate"] == pytest.approx(rate)
        surely = rate - 1.959964 * np.sqrt(rate * (1 - rate) / (n[h] + m + 1)) > 2 * mean / (1 + mean)
        assert r["host_ok"] == (not surely)


def test_clean_documents_stay(spark):
    found = QUERIES["op9_quality_rules"](spark, SF).collect()
    assert all(r["kept"] for r in found if not r["base_failed"])


def test_no_python_in_native_plans(spark):
    for name in ("op1_url_filters", "op9_quality_rules"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# Search


def test_search_on_small_cells(spark, monkeypatch):
    monkeypatch.setattr(search, "CANDIDATES", 40)
    monkeypatch.setattr(search, "QUERIES", 7)
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=8).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(30)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in search.top_k(df, F.col("vec_id") % 10 == 0, k=4).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows}
    for q in [i for i in whole if i % 10 == 0]:
        scores = sorted((-int(whole[i] @ whole[q]), i) for i in whole if i != q)[:4]
        assert found[q] == [(i, -s) for s, i in scores]


def test_large_components_stay(spark):
    """Products beyond 2**53, and beyond a long where no result names them."""
    draw = np.random.default_rng(13)
    rows = [(i, (draw.normal(size=4) * 2.0 ** draw.integers(0, 20)).tolist()) for i in range(200)]
    rows += [(200, [2.0**45, 1.0, 0.0, 0.0]), (201, [-(2.0**60), 0.0, 0.0, 1.0]), (300, [1.0, 3.0, 5.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * x)) if abs(x) < 2**44 else int(x) * 256 for x in v] for i, v in rows}
    for r in range(1, 3):
        assert search.top_k(df, F.col("vec_id") == 300, k=5 * r).count() == 5 * r
    found = search.top_k(df, F.col("vec_id") == 300, k=5).orderBy("rank").collect()
    scores = sorted((-sum(a * b for a, b in zip(whole[i], whole[300])), i) for i in whole if i != 300)[:5]
    assert [(r["vec_id"], r["score"]) for r in found] == [(i, -s) for s, i in scores]
    assert found[0]["vec_id"] == 200 and found[0]["score"] > 2**53


def test_bounds_spare_work():
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(20, 16)) * 300
    vectors = np.floor(np.repeat(centres, 100, axis=0) + draw.normal(size=(2000, 16)) * 5).astype(np.int64)
    pivots = search.farthest_first(vectors, 32)
    far = search._distances(vectors, pivots)
    ids = np.arange(2000)
    _, computed = search.top_of_cell(ids, vectors, far, ids[:50], vectors[:50], far[:50], 5)
    assert computed < 0.6 * 50 * 2000


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 0.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]),
        (4, [float("inf"), 0.0]), (5, []), (6, [1.0]), (7, [-1.0, 0.5, 2.0]), (None, [1.0, 1.0]), (8, [1e12, 0.0]),
        (50, [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = search.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert {r["query_id"] for r in found} == {0, 50}
    assert {r["vec_id"] for r in found} <= {0, 5, 6, 7, 8, 50}
    at_0 = [(r["vec_id"], r["score"]) for r in found if r["query_id"] == 0 and r["rank"] == 1]
    assert at_0 == [(8, int(256e12) * 768)]
    assert all(r["vec_id"] != r["query_id"] for r in found)
    at_50 = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == 50)
    assert [x[1:] for x in at_50] == [(0, 0), (5, 0), (6, 0), (7, 0)]  # equal scores of one id are one row
    assert search.top_k(df.limit(0), F.lit(True)).count() == 0
    assert search.top_k(df.limit(1), F.lit(True)).count() == 0
