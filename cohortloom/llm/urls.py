"""URL filters: given host rules, and association rules mined from labelled URLs.

FP-growth finds combinations of URL tokens that stand together with a bad label; those seen on enough bad
URLs, with enough confidence and without a shorter one inside them, become rules. Two steps keep the
growth small and lose no rule: a token that is a rule alone is taken out first, as every longer
combination with it is needless, and tokens that stand in the same labelled URLs are one class, of which
any token will do. A rule is indexed under its rarest class, so a URL meets only rules that hold one of
its classes there, and a rule fits if the URL has all its classes. Everything is DataFrame functions;
equal URLs are judged once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut_lineage

BAD = "\0bad"
LEAST_CONFIDENCE = 0.6
LEAST_ROWS = 20  # a rule seen on fewer bad URLs is chance, whatever the number of labelled ones
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (verdict, host and path): a rule fits its host and all subdomains where the path starts alike.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: str) -> Column:
    """What follows the first ``://``; empty for a null or without one."""
    return F.expr(f"if(locate('://', `{url}`) > 0, substring(`{url}`, locate('://', `{url}`) + 3), '')")


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(verdict, rule) of the longest given rule that fits; null if none does."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def tokens(url: str) -> Column:
    """Distinct tokens of a URL: host labels and their parts, path and query parts; no bare numbers.

    A token says where it stands (h: host, p: path, q: query or fragment).
    """
    rest = _after(url)
    host = F.split(host_of(url), r"[.]")
    parts = F.flatten(F.transform(host, lambda x: F.split(x, "-")))
    path = F.split(path_of(url), r"[^\p{L}\p{N}]+")
    query = F.split(F.regexp_extract(rest, r"^[^?#]*(.*)$", 1), r"[^\p{L}\p{N}]+")
    marked = F.flatten(
        F.array(
            F.transform(F.concat(host, parts), lambda x: F.concat(F.lit("h:"), x)),
            F.transform(path, lambda x: F.concat(F.lit("p:"), x)),
            F.transform(query, lambda x: F.concat(F.lit("q:"), x)),
        )
    )
    return F.array_distinct(F.filter(marked, lambda x: ~x.rlike(r"^.:[\p{N}]*$")))


def document_of(url: str) -> Column:
    """The number that the last segment of a path begins with: the document a page shows."""
    return F.expr("try_cast({} as bigint)".format(
        f"regexp_extract(`{url}`, '://[^?#]*/([0-9]+)[^/?#]*/?(?:[?#]|$)', 1)"
    ))


def mine(
    labelled: DataFrame, least: int = LEAST_ROWS, confidence: float = LEAST_CONFIDENCE
) -> tuple[DataFrame, DataFrame]:
    """Rules (antecedent, confidence, bad_urls) and classes (token, class) from rows (items, bad).

    An antecedent is an array of classes; a class goes by its first token. ``least`` is the number of bad
    rows that a rule needs.
    """
    rows = labelled.select("items", "bad").withColumn("row", F.monotonically_increasing_id())
    held = cut_lineage(rows).select("row", "bad", F.explode("items").alias("token"))
    # Two sums of hashes stand for the set of rows that hold a token.
    stands = [F.sum(F.xxhash64("row", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(2)]
    found = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("b"), *stands)
    found = cut_lineage(found.filter(F.col("b") >= least))
    alone = F.col("b") >= confidence * F.col("n")
    singles = found.filter(alone).select(
        F.array("token").alias("antecedent"), (F.col("b") / F.col("n")).alias("confidence"),
        F.col("b").alias("bad_urls"),
    )
    sets = ["n", "b", "s0", "s1"]
    named = found.filter(~alone).groupBy(*sets).agg(F.min("token").alias("class"))
    classes = cut_lineage(found.filter(~alone).join(named, sets).select("token", "class"))
    baskets = cut_lineage(
        held.join(classes, "token")
        .groupBy("row", "bad")
        .agg(F.collect_set("class").alias("items"))
        .select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    )
    size = baskets.count()
    rules = singles
    if size:
        # Rounded up by Spark, this share is ``least`` rows.
        grown = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / size), minConfidence=confidence)
        several = grown.fit(baskets).associationRules.filter(
            (F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD)
        )
        rules = singles.unionAll(
            several.select(
                F.array_sort("antecedent").alias("antecedent"), "confidence",
                F.round(F.col("support") * size).cast("long").alias("bad_urls"),
            )
        )
    own = singles.select(F.col("antecedent")[0].alias("token"), F.col("antecedent")[0].alias("class"))
    return without_longer(rules), classes.unionAll(own)


def without_longer(rules: DataFrame) -> DataFrame:
    """Rules that hold no other rule's tokens: the shorter one fits wherever the longer does."""
    rules = cut_lineage(rules)
    index = rules.select(F.col("antecedent").alias("small"), F.element_at("antecedent", 1).alias("token"))
    inside = (
        rules.select("antecedent", F.explode("antecedent").alias("token"))
        .join(index, "token")
        .filter((F.size("small") < F.size("antecedent")) & (F.size(F.array_except("small", "antecedent")) == 0))
        .select("antecedent")
        .distinct()
    )
    return rules.join(inside, "antecedent", "left_anti")


def fitting(urls: DataFrame, rules: DataFrame, classes: DataFrame, url: str = "url") -> DataFrame:
    """(url, rule_confidence) of the URLs that a mined rule fits, with the best confidence."""
    wanted = rules.select(F.explode("antecedent").alias("class")).distinct()
    known = classes.join(wanted, "class", "left_semi")
    met = urls.select(url, F.explode(tokens(url)).alias("token")).join(known, "token")
    held = cut_lineage(met.groupBy(url).agg(F.collect_set("class").alias("classes")))  # few per URL
    counts = held.select(F.explode("classes").alias("class")).groupBy("class").count()
    rarest = (
        rules.select("antecedent", "confidence", F.explode("antecedent").alias("class"))
        .join(counts, "class", "left")
        .groupBy("antecedent", "confidence")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "class")).alias("rare"))
        .select("antecedent", "confidence", F.col("rare.class").alias("class"))
    )
    return (
        held.select(url, "classes", F.explode("classes").alias("class"))
        .join(rarest, "class")
        .filter(F.size(F.array_except("antecedent", "classes")) == 0)
        .groupBy(url)
        .agg(F.max("confidence").alias("rule_confidence"))
    )


def judge(
    pages: DataFrame,
    labels: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    least: int = LEAST_ROWS,
    confidence: float = LEAST_CONFIDENCE,
) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, rule_confidence) of every row of ``pages``.

    A page counts as bad for mining if the document its URL names has quality 0 or toxic 1. The
    longest given rule decides; where none fits, a page that a mined rule fits is blocked and all
    others are allowed. A null URL, or one without ``://``, has an empty host and path and no tokens.
    Rows stay, repeated ones too.
    """
    narrow = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    distinct = cut_lineage(narrow.filter("url is not null").select("url").distinct())
    bad = (
        labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
        .filter(F.col("doc_id").isNotNull() & F.col("bad").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("bad").alias("bad"))
    )
    labelled = (
        distinct.withColumn("doc_id", document_of("url"))
        .join(bad, "doc_id")
        .select(tokens("url").alias("items"), "bad")
    )
    blocked = fitting(distinct, *mine(labelled, least, confidence))
    judged = narrow.join(blocked, "url", "left")
    host, path = host_of("url"), path_of("url")
    judged = judged.withColumn("host", host).withColumn("path", path)
    judged = judged.withColumn("_given", given_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("rule_confidence").isNotNull(), "block").otherwise("allow")
    return judged.select(
        "page_id", "url", "host", "path",
        F.col("_given.rule").alias("rule"),
        F.coalesce("_given.verdict", own).alias("verdict"),
        "rule_confidence",
    )
