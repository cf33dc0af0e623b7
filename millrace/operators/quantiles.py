"""Exact quantiles of columns that are too large for one aggregation buffer.

``percentile`` keeps every distinct value of a group in one buffer. Up to ``direct_rows`` rows that is the quickest way.
Beyond it the wanted order statistics are bracketed: each round cuts the bracket of every target at approximate
quantiles, counts rows per piece exactly, and keeps the piece that holds the wanted rank, until it is small.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import kept_table

OUT_SCHEMA = "column string, prob double, value double"
PIECES = 64


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], direct_rows: int = 1_000_000) -> DataFrame:
    """Linear-interpolation quantiles, one row per (column, prob); NULL and NaN are ignored, infinities are values."""
    df = df.select(*[_known(df, c) for c in dict.fromkeys(cols)])
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    if max(counts) <= direct_rows:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.percentile(c, F.array(*[F.lit(float(p)) for p in probs])).alias("q")) for c in cols])
        rows = df.agg(pairs.alias("__a")).select(F.explode("__a").alias("__r"))
        named = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("__r.q").alias("value"))
        return rows.select(F.col("__r.column").alias("column"), F.explode(F.coalesce(named, _no_values(probs))).alias("__z")).select(
            "column", F.col("__z.prob").alias("prob"), F.col("__z.value").alias("value"))
    ranks = {}
    for c in cols:
        if counts[c]:
            spots = [p * (counts[c] - 1) for p in probs]
            ranks[c] = sorted({int(math.floor(s)) for s in spots} | {int(math.ceil(s)) for s in spots})
    found = order_statistics(df, ranks, direct_rows)
    rows = []
    for c in cols:
        for p in probs:
            if not counts[c]:
                rows.append((c, float(p), None))
                continue
            spot = p * (counts[c] - 1)
            low, high = found[c, math.floor(spot)], found[c, math.ceil(spot)]
            part = spot - math.floor(spot)
            rows.append((c, float(p), low if low == high or not part else (1 - part) * low + part * high))
    return df.sparkSession.createDataFrame(rows, OUT_SCHEMA)


def _known(df: DataFrame, c: str) -> Column:
    """The column with NaN as NULL."""
    return F.when(~F.isnan(c), F.col(c)).alias(c) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)


def _no_values(probs: Sequence[float]):
    return F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.lit(None).cast("double").alias("value")) for p in probs])


def order_statistics(df: DataFrame, ranks: dict[str, Sequence[int]], small: int = 1_000_000) -> dict[tuple[str, int], float]:
    """Value at each 0-based rank per column. What reaches the driver is a few numbers per wanted rank.

    A bracket is (column, low, high, rows at or below low); ranks that fall into the same bracket share its work. A
    round costs one pass for the approximate cuts and one for the exact counts, whatever the number of ranks.
    """
    df = df.select(*[_known(df, c) for c in ranks])
    box = {(c, r): (c, None, math.inf, 0) for c, rs in ranks.items() for r in rs}
    done: dict[tuple[str, int], float] = {}
    ready: set = set()
    while True:
        opened = sorted({b for t, b in box.items() if t not in done and b not in ready}, key=_bracket_order)
        if not opened:
            break
        inside = [_inside(b) for b in opened]
        cuts_at = F.array(*[F.lit(k / PIECES) for k in range(PIECES + 1)])
        stats = df.agg(*[
            F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
                     F.percentile_approx(v, cuts_at, 10_000).alias("cuts")).alias(f"b{i}")
            for i, v in enumerate(inside)]).first()
        narrow = []
        for i, b in enumerate(opened):
            stat = stats[f"b{i}"]
            if stat["lo"] == stat["hi"]:
                done.update({t: stat["lo"] for t, own in box.items() if own == b})
            elif stat["n"] <= small:
                ready.add(b)
            else:
                # the middle by value makes sure that a bracket shrinks even where approximate cuts coincide
                low, high = max(stat["lo"], -sys.float_info.max), min(stat["hi"], sys.float_info.max)
                narrow.append((i, b, sorted({*stat["cuts"], stat["lo"], low / 2 + high / 2, high, stat["hi"]})))
        if narrow:
            sums = df.agg(*[
                F.count_if(inside[i] <= F.lit(cut)).alias(f"b{i}_{k}") for i, _, cuts in narrow for k, cut in enumerate(cuts)]).first()
            for i, b, cuts in narrow:
                upto = [b[3] + sums[f"b{i}_{k}"] for k in range(len(cuts))]
                for t in [t for t, own in box.items() if own == b]:
                    k = next(k for k in range(len(cuts)) if upto[k] > t[1])
                    box[t] = (b[0], cuts[k - 1], cuts[k], upto[k - 1]) if k else (b[0], b[1], cuts[0], b[3])
    wanted = {t: b for t, b in box.items() if b in ready}
    if wanted:
        boxes = sorted(ready & set(wanted.values()), key=_bracket_order)
        hits = F.filter(F.array(*[F.struct(F.lit(i).alias("box"), _inside(b).alias("v")) for i, b in enumerate(boxes)]), lambda h: h["v"].isNotNull())
        counts = df.select(F.explode(hits).alias("h")).groupBy("h.box", "h.v").count()
        seen = F.sum("count").over(W.partitionBy("box").orderBy("v"))  # at most `small` values per bracket
        ranked = counts.select("box", "v", seen.alias("upto"))
        targets = list(wanted)
        row = ranked.agg(*[
            F.min(F.when((F.col("box") == boxes.index(wanted[t])) & (F.col("upto") > t[1] - wanted[t][3]), F.col("v"))).alias(f"t{i}")
            for i, t in enumerate(targets)]).first()
        done.update({t: row[f"t{i}"] for i, t in enumerate(targets)})
    return done


def _inside(box: tuple) -> Column:
    column, low, high, _ = box
    above = F.lit(True) if low is None else F.col(column) > F.lit(low)
    return F.when(above & (F.col(column) <= F.lit(high)), F.col(column).cast("double"))


def _bracket_order(box: tuple) -> tuple:
    column, low, high, below = box
    return column, low is not None, low or 0.0, high, below


def cumulative_counts(df: DataFrame, by: Sequence[str], col: str, pieces: int | None = None) -> DataFrame:
    """Per group and distinct value: ``__n`` rows of the value and ``__upto`` rows at or below it."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("__n"))
    return running_counts(counts, by, col, {"__n": "__upto"}, pieces)


def running_counts(
    counts: DataFrame, by: Sequence[str], col: str, upto: Mapping[str, str], pieces: int | None = None,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running sums of count columns along the values of a group, one row per (group, value); ``totals`` adds a group's whole sums.

    The counts are sorted by ranges that Spark samples over (group, value), so a range holds about as many distinct values as any other, however
    the values are spread and whatever a group's share of them. They are written once, accumulated per range, and chained by the sums of a
    group's ranges: a table of some rows per group and range. ``pieces`` sets the number of ranges.
    """
    ranged = counts.repartitionByRange(*([pieces] if pieces else []), *by, col)
    placed = kept_table(ranged.withColumn("__piece", F.spark_partition_id()))
    sums = placed.groupBy(*by, "__piece").agg(*[F.sum(n).alias(f"__sum_{n}") for n in upto])
    earlier = W.partitionBy(*by).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by).orderBy("__piece").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    base = sums.select(
        *by, "__piece", *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__base_{n}") for n in upto],
        *[F.sum(f"__sum_{n}").over(whole).alias(name) for n, name in (totals or {}).items()])
    inside = W.partitionBy(*by, "__piece").orderBy(col).rowsBetween(W.unboundedPreceding, 0)
    return placed.join(base.hint("shuffle_hash"), [*by, "__piece"]).select(
        *counts.columns, *[(F.col(f"__base_{n}") + F.sum(n).over(inside)).alias(name) for n, name in upto.items()], *(totals or {}).values())


def centred_ranks(counts: DataFrame, by: Sequence[str], col: str, names: Mapping[str, str], pieces: int | None = None) -> DataFrame:
    """Add per count column the mean rank that the rows of a value share, less the mean rank of the group; both are exact halves."""
    upto, totals = ({n: f"__{k}_{n}" for n in names} for k in ("upto", "all"))
    table = running_counts(counts, by, col, upto, pieces, totals)
    return table.select(*counts.columns, *[
        (F.col(upto[n]) - (F.col(n) + F.col(totals[n])) / F.lit(2.0)).alias(name) for n, name in names.items()])


def average_rank(df: DataFrame, by: Sequence[str], col: str, name: str, pieces: int | None = None) -> DataFrame:
    """Rank from 1 with ties sharing their mean rank, NULLs unranked."""
    return average_ranks(df, by, {col: name}, pieces)


def average_ranks(df: DataFrame, by: Sequence[str], names: Mapping[str, str], pieces: int | None = None) -> DataFrame:
    """``average_rank`` of several numeric columns together: one table of counts for all, joined back per column by its value."""
    one = next(iter(names))
    if len(names) == 1:
        table, keys, value = df.select(*by, one), [*by], one
    else:
        keys, value = [*by, "__col"], "__value"
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("__col"), F.col(c).cast("double").alias("__value")) for c in names])).alias("__c")
        table = df.select(*by, cells).select(*by, "__c.*")
    rank = (F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)).alias("__rank")
    ranked = cumulative_counts(table, keys, value, pieces).select(*keys, value, rank)
    if len(names) > 1:
        ranked = kept_table(ranked)
    out = df
    for c, name in names.items():
        own = ranked.filter(F.col("__col") == c).drop("__col").withColumn(value, F.col(value).cast(df.schema[c].dataType)) if len(names) > 1 else ranked
        out = out.join(own.withColumnRenamed(value, c).withColumnRenamed("__rank", name), [*by, c], "left")
    return out


def grouped_quantile(df: DataFrame, by: Sequence[str], col: str, prob: float, name: str, pieces: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantile per group, for groups that may be too large for one buffer."""
    table = cumulative_counts(df, by, col, pieces)
    total = df.filter(F.col(col).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("__total"))
    spot = F.lit(float(prob)) * (F.col("__total") - 1)
    if by:
        both = table.join(total, list(by))
    else:
        both = table.withColumn("__total", F.lit(total.first()[0]))
    low = F.min(F.when(F.col("__upto") > F.floor(spot), F.col(col)))
    high = F.min(F.when(F.col("__upto") > F.ceil(spot), F.col(col)))
    found = both.groupBy(*by).agg(low.cast("double").alias("__a"), high.cast("double").alias("__b"), F.first(spot).alias("__s"))
    return found.select(*by, (F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__s") - F.floor("__s"))).alias(name))
