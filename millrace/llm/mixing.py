"""Mixing sources to target weights by capped water-filling.

Every source wants its weight's share of the mix; a source that would be repeated more than ``max_epochs`` times is
clamped there, and what it leaves goes to the others by weight, round after round, until none is above. A source then
takes whole repetitions of all its documents, and for the fractional rest a seeded selection: documents in the order of a
hash of (seed, doc_id) while they fit, and last the one document that brings the words nearest to the target.

The order is never sorted per source: documents fall into 4096 buckets by hash, sums per (source, bucket) find the bucket
in which a source's selection ends, and only that bucket is ordered. The driver sees two sums per round.

Defined cases: NULL text has size 0; NULL sources form one source, the last; NULL doc_id hashes like an empty string;
equal rows are taken or left together; an empty table, or one without words, has targets 0. Only doc_id, source and text
are read; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import kept, words


def _order(seed: int) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 16)


def _numbered(sources: DataFrame) -> DataFrame:
    """Number sources from 0 by code point, NULL last, without sorting them in one task."""
    order = [F.col("__source").isNull(), F.col("__source")]
    dealt = kept(sources.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__part", before.alias("__before"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return dealt.join(parts, "__part").withColumn("__rank", inside + F.col("__before")).drop("__part", "__before")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add ``__target`` to rows (__source, __size, __weight): weight times the common level, clamped at the cap.

    The level rises with each round's redistribution and the clamped set only grows, so the rounds end.
    """
    cap = F.col("__size") * F.lit(float(max_epochs))
    total = float(sources.agg(F.sum("__size")).first()[0] or 0) * share
    level, clamped = 0.0, -1
    while True:
        above = F.col("__weight") * F.lit(level) > cap
        row = sources.agg(
            F.sum(F.when(above, cap)).alias("full"), F.sum(F.when(~above, F.col("__weight"))).alias("free"),
            F.count(F.when(above, 1)).alias("n")).first()
        if row["n"] == clamped or not row["free"]:
            break
        clamped, level = row["n"], (total - float(row["full"] or 0)) / float(row["free"])
    above = F.col("__weight") * F.lit(level) > cap
    return sources.withColumn("__target", F.when(above, cap).otherwise(F.col("__weight") * F.lit(level)))


def mix_plan(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """Sizes of all documents, and per source what decides for its documents.

    The first has doc_id, __source, __size, __h; the second __source, __source_size, __target, __whole (whole
    repetitions), __end (documents before this key get one more) and __fit (and so does this one).
    """
    buckets = 4096
    sized = kept(docs.select(
        "doc_id", F.col("source").alias("__source"), F.size(words(F.col("text"))).cast("long").alias("__size"), _order(seed).alias("__h"))
        .withColumn("__bucket", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int")))
    piles = kept(sized.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__pile")))
    sources = _numbered(piles.groupBy("__source").agg(F.sum("__pile").alias("__size")))
    listed = F.array(*[F.lit(float(x)) for x in weights])
    filled = water_fill(kept(sources.withColumn("__weight", F.get(listed, (F.col("__rank") % len(weights)).cast("int")))), share, max_epochs)
    whole = F.when(F.col("__size") > 0, F.floor(F.col("__target") / F.col("__size"))).otherwise(0).cast("long")
    aim = filled.select(F.col("__source").alias("__s"), F.col("__size").alias("__source_size"), "__target", whole.alias("__whole")).withColumn(
        "__rest", F.col("__target") - F.col("__whole") * F.col("__source_size"))
    # the bucket in which the rest of a source ends
    run = W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    base = piles.withColumn("__base", F.coalesce(F.sum("__pile").over(run), F.lit(0)))
    ends = base.join(aim, F.col("__source").eqNullSafe(F.col("__s"))).filter(
        (F.col("__base") <= F.col("__rest")) & (F.col("__base") + F.col("__pile") > F.col("__rest"))).select(
        "__s", F.col("__bucket").alias("__b"), "__base", "__rest")
    at = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b"))
    key = F.struct("__h", "doc_id", "__size")
    inside = W.partitionBy("__s").orderBy("__h", "doc_id", "__size").rowsBetween(W.unboundedPreceding, -1)
    first_over = (
        sized.join(ends, at).withColumn("__before", F.col("__base") + F.coalesce(F.sum("__size").over(inside), F.lit(0)))
        .filter((F.col("__before") <= F.col("__rest")) & (F.col("__before") + F.col("__size") > F.col("__rest")))
        .groupBy("__s").agg(F.min(F.struct(key.alias("end"), (F.col("__rest") - F.col("__before")).alias("open"))).alias("__x"))
        .select("__s", F.col("__x.end").alias("__end"), F.col("__x.open").alias("__open")))
    # the one document that fills what is open best
    off = F.abs(F.col("__size") - F.col("__open"))
    fits = (
        sized.join(first_over, F.col("__source").eqNullSafe(F.col("__s")) & (key >= F.col("__end")) & (off < F.col("__open")))
        .groupBy("__s").agg(F.min(F.struct(off.alias("off"), key.alias("fit"))).alias("__x"))
        .select("__s", F.col("__x.fit").alias("__fit")))
    ended = first_over.select(F.col("__s").alias("__es"), "__end")
    fitted = fits.select(F.col("__s").alias("__fs"), "__fit")
    decided = aim.join(ended, F.col("__s").eqNullSafe(F.col("__es")), "left").join(fitted, F.col("__s").eqNullSafe(F.col("__fs")), "left")
    return sized.drop("__bucket"), kept(decided.select("__s", "__source_size", "__target", "__whole", "__end", "__fit", "__rest"))


def _copies(epochs: float) -> Column:
    key = F.struct("__h", "doc_id", "__size")
    early = F.coalesce(key < F.col("__end"), F.lit(True)) & (F.col("__rest") > 0)
    more = F.when(early | F.coalesce(key == F.col("__fit"), F.lit(False)), 1).otherwise(0)
    return F.least(F.col("__whole") + more, F.lit(math.ceil(epochs))).cast("int")


def mixed_sizes(docs: DataFrame, max_epochs: float = 2.0, **settings) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it."""
    sized, decided = mix_plan(docs, max_epochs=max_epochs, **settings)
    joined = sized.join(decided, F.col("__source").eqNullSafe(F.col("__s")))
    return joined.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (_copies(max_epochs) * F.col("__size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, max_epochs: float = 2.0, seed: int = 17, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole. Columns as in ``docs``; a document without words of
    a source with a whole repetition stays."""
    _, decided = mix_plan(docs, max_epochs=max_epochs, seed=seed, **settings)
    sized = docs.withColumn("__size", F.size(words(F.col("text"))).cast("long")).withColumn("__h", _order(seed))
    joined = sized.join(decided, F.col("source").eqNullSafe(F.col("__s")))
    again = joined.withColumn("__n", F.explode(F.array_repeat(F.lit(1), _copies(max_epochs))))
    return again.select(*docs.columns)
