"""Many-to-many links that are counted without being joined row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .groups import counts
from .joins import left_join

PAIRS = 1_000_000  # joined rows of one key that one task writes


class Link:
    """A left join in which both sides may repeat a key, kept as its two sides.

    A key with many rows on both sides has their product in joined rows. What is asked of the link is
    answered from the distinct rows of each side with their multiplicities; only ``expand`` makes the
    joined rows. Missing keys match each other; right columns that collide get a suffix.
    """

    def __init__(self, left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str = "_y"):
        self.on = list(on)
        self.left = left
        taken = {c: c + suffix for c in right.columns if c in left.columns and c not in self.on}
        self.right = right.withColumnsRenamed(taken)

    def sizes(self) -> DataFrame:
        """Each key of the left side with its number of rows there and on the right: n_left, n_right."""
        left = counts(self.left, *self.on, name="n_left")
        right = counts(self.right, *self.on, name="n_right")
        joined = left_join(left, right, self.on)
        return joined.withColumn("n_right", F.coalesce("n_right", F.lit(0).cast("long")))

    def size(self) -> DataFrame:
        """Joined rows, rows of the left side without a match, and keys: one row."""
        n_left, n_right = F.col("n_left"), F.col("n_right")
        none = F.lit(0).cast("long")
        return self.sizes().agg(
            F.coalesce(F.sum(n_left * F.greatest(n_right, F.lit(1))), none).alias("n"),
            F.coalesce(F.sum(F.when(n_right == 0, n_left)), none).alias("n_unmatched"),
            F.count(F.lit(1)).alias("n_keys"),
        )

    def counts(self, *columns: str, name: str = "n") -> DataFrame:
        """Joined rows by columns of either side.

        Each side is counted by key and its columns first; a pair of such counts stands for the product.
        """
        left = [c for c in columns if c in self.left.columns and c not in self.on]
        right = [c for c in columns if c in self.right.columns and c not in self.on]
        unknown = set(columns) - {*left, *right, *self.on}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        ours = counts(self.left, *self.on, *left, name="_n_left")
        theirs = counts(self.right, *self.on, *right, name="_n_right")
        joined = left_join(ours, theirs, self.on)
        rows = F.col("_n_left") * F.coalesce("_n_right", F.lit(1))
        return joined.groupBy(*columns).agg(F.sum(rows).alias(name))

    def expand(self, pairs: int | None = PAIRS) -> DataFrame:
        """The joined rows.

        A key with more than ``pairs`` of them is dealt out: its left rows by a hash of themselves over
        as many parts as it needs, its right rows to each part. The sizes are checkpointed for that. With
        None there is one plain join, in which Spark may still split a hot partition.
        """
        if pairs is None:
            return left_join(self.left, self.right, self.on)
        product = F.col("n_left") * F.col("n_right")
        parts = F.least(F.ceil(product / pairs), F.col("n_left")).cast("int")
        hot = cut_lineage(self.sizes().filter(product > pairs).select(*self.on, parts.alias("_parts")))
        many: Column = F.coalesce("_parts", F.lit(1))
        left = left_join(self.left, hot, self.on).withColumn(
            "_part", F.pmod(F.xxhash64(*self.left.columns), many).cast("int")
        )
        right = left_join(self.right, hot, self.on).withColumn(
            "_part", F.explode(F.sequence(F.lit(0), many - 1))
        )
        joined = left_join(left.drop("_parts"), right.drop("_parts"), [*self.on, "_part"], null_safe=self.on)
        return joined.drop("_part")
