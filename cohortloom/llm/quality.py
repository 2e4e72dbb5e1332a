"""Quality rules with verdicts on whole hosts, in DataFrame functions only.

Every document gets its counts and fails or passes the rules. Failures are added up by host. A host's
rate is shrunk towards the rate of all hosts with a beta prior, whose strength comes from how far the
hosts' own rates lie apart; a host with few documents thus needs more evidence. A host is rejected,
with all its documents, where the odds of failure are with ``SURE`` probability above ``ODDS`` times
those of all documents: where the shrunk rate, less so many of its own deviations, is above that limit
(the posterior is taken as normal). So the limit follows the corpus, and a host that is like the others
stays whatever their rate.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut_lineage, without

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words
SPAN = 5
ODDS = 2.0
SURE = 0.975
DEVIATIONS = NormalDist().inv_cdf(SURE)
_STRENGTHS = (1.0, 1000.0)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Words of a text: runs of characters that are no white space; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def _covered(places: Column, span: int) -> Column:
    """Places covered by spans that start at the given places, in rising order."""
    gaps = F.transform(
        places,
        lambda p, i: F.least(F.lit(span), F.coalesce(F.get(places, i + 1) - p, F.lit(span))),
    )
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)


def repeated_words(words: Column, span: int = SPAN) -> Column:
    """How many words lie in windows of ``span`` words that stand twice or more in the text.

    Windows are compared by 64-bit hashes inside one text. They are sorted with their places only
    where some window repeats at all.
    """

    def of_hashes(h):
        n = F.size(h) - (span - 1)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(span)]))

    def of_windows(w):
        def of_sorted(s):
            twice = F.filter(
                s,
                lambda e, i: (F.get(s, i - 1)["w"] == e["w"]) | (F.get(s, i + 1)["w"] == e["w"]),
            )
            places = F.array_sort(F.transform(twice, lambda e: e["i"]))
            return _let(places, lambda p: _covered(p, span))

        placed = F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
        some = _let(F.sort_array(placed), of_sorted)
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(some)

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return _let(_let(hashes, of_hashes), of_windows)


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    )
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of its texts and ``base_failed``; a null text has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumn(
        "_counts",
        _let(
            words_of(F.col(text)),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        ),
    )
    counted = counted.select(
        "*",
        "_counts.*",
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _duplicate_lines(F.col(text)).cast("long").alias("n_dup_lines"),
    ).drop("_counts")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed)


def host_verdicts(
    judged: DataFrame, host: str, failed: Column, odds: float = ODDS, deviations: float = DEVIATIONS
) -> DataFrame:
    """(host, host_rate, host_ok): the hosts' shrunk failure rates and verdicts.

    The prior's mean is the rate of all documents; its strength m makes the spread of the hosts' rates
    the variance of a beta distribution, mean * (1 - mean) / (m + 1), held between 1 and 1000.
    """
    hosts = judged.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("f")
    )
    mean = hosts.agg((F.sum("f") / F.sum("n")).alias("mean")).scalar()
    spread = hosts.agg(F.avg(F.pow(F.col("f") / F.col("n") - mean, F.lit(2.0))).alias("v")).scalar()
    least, most = _STRENGTHS
    strength = F.greatest(
        F.lit(least), F.least(F.lit(most), F.coalesce(F.try_divide(mean * (1 - mean), spread) - 1, F.lit(most)))
    )
    rate = (F.col("f") + mean * strength) / (F.col("n") + strength)
    deviation = F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1))
    limit = odds * mean / (1 + (odds - 1) * mean)
    ok = rate - deviations * deviation <= limit
    return hosts.select("host", rate.alias("host_rate"), ok.alias("host_ok"))


def judge(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """One row per document: id, host, counts, ``base_failed``, ``failed``, ``host_rate``, ``kept``.

    ``failed`` adds two rules that count for hosts only: symbols above a tenth of the words'
    characters, and more repeated lines than words / 20. A document is kept if it passes the base
    rules and its host is not rejected. A document without a host is judged by itself. Rows
    stay, repeated ones too; a null text has no words and fails.
    """
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host")
    )
    counted = base_counts(narrow).drop("text")
    failed = (
        F.col("base_failed")
        | (10 * F.col("n_symbols") > F.col("word_chars"))
        | (20 * F.col("n_dup_lines") > F.col("n_words"))
    )
    judged = cut_lineage(counted.withColumn("failed", failed))
    verdicts = host_verdicts(judged, "host", F.col("failed"))
    joined = without(judged, ["host_rate", "host_ok"]).join(verdicts, "host", "left")
    kept = ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))
    return joined.withColumn("kept", kept).drop("host_ok")


# The query's rows in DuckDB's SQL. The prior and the verdict are those above.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), c AS (
  SELECT k, doc_id, host, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), p AS (
  SELECT k, unnest(range(1, len(w) - 3)) AS i, w FROM d
), g AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, list_slice(w, i, i + 4)) AS c FROM p
), s AS (
  SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS j FROM g WHERE c > 1
), r AS (
  SELECT k, sum(CASE WHEN j IS NULL THEN 5 ELSE least(5, j - i) END) AS n_repeat_words FROM s GROUP BY k
), b AS (
  SELECT c.doc_id, c.host, c.n_words, c.word_chars, c.n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         c.n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * c.n_words AS base_failed
  FROM c LEFT JOIN r ON c.k = r.k
), h AS (
  SELECT host, count(*)::DOUBLE AS n,
         count_if(base_failed OR 10 * n_symbols > word_chars OR 20 * n_dup_lines > n_words)::DOUBLE AS f
  FROM b WHERE host IS NOT NULL GROUP BY host
), m AS (SELECT sum(f) / sum(n) AS mean FROM h),
v AS (SELECT avg((f / n - mean) * (f / n - mean)) AS spread FROM h, m),
q AS (
  SELECT mean, greatest(1.0, least(1000.0,
         coalesce(CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 END, 1000.0))) AS strength
  FROM m, v
), o AS (
  SELECT host, rate - {DEVIATIONS!r}::DOUBLE * sqrt(rate * (1 - rate) / (n + strength + 1))
               <= {ODDS!r}::DOUBLE * mean / (1 + ({ODDS!r}::DOUBLE - 1) * mean) AS host_ok
  FROM (SELECT host, n, mean, strength, (f + mean * strength) / (n + strength) AS rate FROM h, q)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       (NOT base_failed) AND coalesce(host_ok, TRUE) AS kept
FROM b LEFT JOIN o ON b.host = o.host
"""
