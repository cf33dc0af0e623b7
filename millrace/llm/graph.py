"""Connected components over distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import kept


def _downward(pairs: DataFrame) -> DataFrame:
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    return pairs.filter(F.col("a") != F.col("b")).select(high, low).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the smallest node that it reaches.

    Large and small stars by turns: each node's larger neighbours, then its smaller ones, are hung below the smallest.
    Rounds grow with the logarithm of the longest path. A node's neighbours are never gathered, only their minimum is taken.
    Each round is written to the shared folder. NULL ends and loops are left out; the edges may repeat.
    """
    now = kept(_downward(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())))
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.select(F.col("a").alias("n"), "m"), F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = kept(_downward(small.union(low)))
        last, now, mark = mark, then, _mark(then)
        if mark == last:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
