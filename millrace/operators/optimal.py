"""Exact penalised segmentation of series of any length, by dynamic programming in blocks of rows.

``best[e] = min over s of best[s] + cost(s, e) + penalty``. Ends are taken a block at a time, all series and penalties
together. What an earlier start offers to the ends of a block is computed for tiles of starts side by side and reduced to a
minimum per end; the recursion inside a block is one task per series, which holds a block and nothing of the rest. Starts that
cannot win any more are dropped between blocks, the others go on as rows. Each block leaves a table of predecessors; at the end
these are walked back, a block at a time, from the end of the series to its start. Rounds are blocks of the longest series.
Short series are packed, some ``PACK`` rows to a group, and searched side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import kept_table

BLOCK = 50_000
TILE = 2_000
PACK = 10_000
SHORT = 1_000
NEVER = np.iinfo(np.int64).max


def block_search(
    idx: np.ndarray, s: np.ndarray, q: np.ndarray, pen: float, min_size: int, outer: np.ndarray, source: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best, back, until) for the admissible rows ``idx`` of one block, in order.

    ``s`` are prefix sums per feature, ``q`` those of squares over all features. ``outer`` is the least cost from a start before the block
    and ``source`` that start. ``back`` is the row number of the best start, -1 for none. A start is out from row ``until`` on: some end at
    least ``min_size`` before proved that it cannot win, which keeps the search exact. Of equal starts the earliest wins.
    """
    m = len(idx)
    best, back, until = np.full(m, np.inf), np.full(m, -1, np.int64), np.full(m, NEVER, np.int64)
    starts = np.empty(0, dtype=int)
    waiting = 0
    for e in range(m):
        here = idx[e]
        if here == 0:
            best[e] = -pen
            continue
        first = waiting
        while waiting < e and idx[waiting] <= here - min_size:
            waiting += 1
        fresh = np.arange(first, waiting)
        starts = np.concatenate([starts, fresh[np.isfinite(best[fresh])]])
        reach = np.empty(0)
        if len(starts):
            ds = s[e] - s[starts]
            reach = best[starts] + (q[e] - q[starts]) - (ds * ds).sum(axis=1) / (here - idx[starts])
        k = int(np.argmin(reach)) if len(reach) else -1
        if k >= 0 and reach[k] < outer[e]:
            best[e], back[e] = reach[k] + pen, idx[starts[k]]
        elif np.isfinite(outer[e]):
            best[e], back[e] = outer[e] + pen, source[e]
        if len(starts):
            lost = starts[reach > best[e]]
            until[lost] = np.minimum(until[lost], here + min_size)
            starts = starts[until[starts] > here]
    return best, back, until


def short_search(
    idx: np.ndarray, s: np.ndarray, q: np.ndarray, pen: np.ndarray, min_size: int, outer: np.ndarray, source: np.ndarray, size: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``block_search`` for several series side by side: a row of the arrays is a series, filled up with any rows after its ``size``."""
    n, m = idx.shape
    best, back, until = np.full((n, m), np.inf), np.full((n, m), -1, np.int64), np.full((n, m), NEVER, np.int64)
    every = np.arange(n)
    for e in range(m):
        here = idx[:, e]
        reach = np.full((n, 1), np.inf)
        if e:
            length = here[:, None] - idx[:, :e]
            ds = s[:, e, None, :] - s[:, :e]
            reach = best[:, :e] + (q[:, e, None] - q[:, :e]) - (ds * ds).sum(axis=2) / length
            reach[(length < min_size) | (until[:, :e] <= idx[:, e - 1, None])] = np.inf
        k = reach.argmin(axis=1)
        least = reach[every, k]
        inner = least < outer[:, e]
        best[:, e] = np.where(here == 0, -pen, np.where(inner, least, outer[:, e]) + pen)
        back[:, e] = np.where(inner & (here != 0), idx[every, k], np.where(np.isfinite(outer[:, e]) & (here != 0), source[:, e], -1))
        if e:
            lost = np.isfinite(reach) & (reach > best[:, e, None]) & (e < size)[:, None]
            until[:, :e] = np.where(lost, np.minimum(until[:, :e], here[:, None] + min_size), until[:, :e])
    return best, back, until


def series_bounds(pdf: pd.DataFrame, keys: Sequence[str], order: str) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows by series and ``order``, one per place, and where the series begin, the end of the last included."""
    number = pdf.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), np.int64)
    place = pdf[order].to_numpy()
    down = np.lexsort((place, number))
    number, place = number[down], place[down]
    new = np.concatenate([[True], (number[1:] != number[:-1]) | (place[1:] != place[:-1])])
    return pdf.iloc[down[new]].reset_index(drop=True), np.append(np.flatnonzero(np.diff(number[new], prepend=-1)), new.sum())


def packed(df: DataFrame, series_cols: Sequence[str], rows: int, pack: int = PACK):
    """Groups of whole series with about ``pack`` of all ``rows`` rows each: a group per series costs more than a short series' work."""
    packs = max(1, -(-rows // pack))
    number = F.pmod(F.xxhash64(*series_cols), F.lit(packs)) if series_cols else F.lit(0)
    return df.withColumn("__pack", number).groupBy("__pack")


def _offers(starts: pd.DataFrame, ends: pd.DataFrame, sums: Sequence[str], min_size: int) -> np.ndarray:
    """Cost of each end (column) from each start (row), infinite where the start is too near or out."""
    i, e = starts["i"].to_numpy(), ends["i"].to_numpy()
    ds = ends[sums].to_numpy()[None, :, :] - starts[sums].to_numpy()[:, None, :]
    length = e[None, :] - i[:, None]
    cost = starts["best"].to_numpy()[:, None] + (ends["squares"].to_numpy()[None, :] - starts["squares"].to_numpy()[:, None])
    cost = cost - (ds * ds).sum(axis=2) / np.maximum(length, 1)
    return np.where((length >= max(1, min_size)) & (starts["until"].to_numpy()[:, None] > e[None, :]), cost, np.inf)


def search_exactly(points: DataFrame, series_cols: Sequence[str], min_size: int, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """Segments (series, penalty, regime, start_idx, end_idx) of least squared error plus penalty per segment.

    ``points`` is a change table with a column ``penalty``; a block is ``block`` rows of the series, admissible or not.
    A series too short for a change of ``min_size`` is one segment.
    """
    keys = [*series_cols, "penalty"]
    sums = [c for c in points.columns if c.startswith("s_")]
    key_schema = [points.schema[c] for c in keys]
    number = F.floor(F.col("i") / block).cast("long")
    table = kept_table(points.select(*keys, "i", *sums, "squares", number.alias("block")), ["block"])
    sizes = {r["block"]: r["count"] for r in table.groupBy("block").count().collect()}
    last = max(sizes, default=None)
    segment_schema = T.StructType([*key_schema, *[T.StructField(c, T.LongType()) for c in ("start_idx", "end_idx", "__rank", "__next")]])
    if last is None:
        return points.sparkSession.createDataFrame([], T.StructType([*key_schema, T.StructField("regime", T.IntegerType()),
                                                                     *segment_schema.fields[-4:-2]]))
    row = T.StructType([*key_schema, T.StructField("i", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in (*sums, "squares", "best")],
                        T.StructField("back", T.LongType()), T.StructField("until", T.LongType())])
    offer_schema = T.StructType([*key_schema, T.StructField("i", T.LongType()), T.StructField("reach", T.DoubleType()), T.StructField("source", T.LongType())])
    left = row.fieldNames()

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at = series_bounds(pdf, keys, "i")
        i, s, q, pen = pdf["i"].to_numpy(), pdf[sums].to_numpy(), pdf["squares"].to_numpy(), pdf["penalty"].to_numpy(dtype=float)
        outer, source = pdf["reach"].fillna(np.inf).to_numpy(dtype=float), pdf["source"].fillna(-1).to_numpy().astype(np.int64)
        best, back, until = np.empty(len(i)), np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        length = np.diff(at)
        for k in np.flatnonzero(length > SHORT):
            own = slice(at[k], at[k + 1])
            best[own], back[own], until[own] = block_search(i[own], s[own], q[own], float(pen[at[k]]), min_size, outer[own], source[own])
        short = np.flatnonzero(length <= SHORT)
        short = short[np.argsort(length[short], kind="stable")]
        while len(short):
            # the longest together with as many others as make some 100,000 places
            m = length[short[-1]]
            short, some = np.split(short, [max(0, len(short) - 100_000 // m)])
            place = np.arange(m)
            over = np.maximum(place[None, :] - (length[some] - 1)[:, None], 0)
            rows = at[some][:, None] + place[None, :] - over
            found = short_search(i[rows] + over, s[rows], q[rows], pen[at[some]], min_size, outer[rows], source[rows], length[some])
            for whole, part in zip((best, back, until), found, strict=True):
                whole[rows[over == 0]] = part[over == 0]
        return pdf.assign(best=best, back=back, until=until)[left]

    def offer(starts: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        starts = starts.sort_values("i")
        ends = ends if len(starts) else ends.iloc[:0]
        reach, source = np.full(len(ends), np.inf), np.zeros(len(ends), np.int64)
        for at in range(0, len(ends), 512):
            cost = _offers(starts, ends.iloc[at:at + 512], sums, min_size)
            k = cost.argmin(axis=0)
            reach[at:at + 512], source[at:at + 512] = cost[k, np.arange(cost.shape[1])], starts["i"].to_numpy()[k]
        found = np.isfinite(reach)
        out = pd.DataFrame({"i": ends["i"].to_numpy()[found], "reach": reach[found], "source": source[found]})
        for c in keys:
            out[c] = ends[c].iloc[0] if len(ends) else None
        return out[offer_schema.fieldNames()]

    def outlive(starts: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        until = starts["until"].to_numpy().copy()
        for at in range(0, len(ends), 512):
            some = ends.iloc[at:at + 512]
            cost = _offers(starts, some, sums, min_size)
            lost = np.isfinite(cost) & (cost > some["best"].to_numpy()[None, :])
            until = np.minimum(until, np.where(lost, some["i"].to_numpy()[None, :] + min_size, NEVER).min(axis=1))
        out = pd.DataFrame({c: starts[c].to_numpy() for c in left if c not in keys}).assign(until=until)
        for c in keys:
            out[c] = starts[c].iloc[0] if len(starts) else None
        return out[left]

    def by_tile(starts: DataFrame, ends: DataFrame, solve, schema: T.StructType) -> DataFrame:
        """``solve`` on each tile of a series' starts with all the block's ends."""
        tiles = starts.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("__n"))
        dealt = starts.join(tiles, keys).withColumn("__tile", F.pmod(F.xxhash64("i"), F.col("__n")).cast("int")).drop("__n")
        spread = ends.join(tiles, keys).withColumn("__tile", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
        return dealt.groupBy(*keys, "__tile").cogroup(spread.groupBy(*keys, "__tile")).applyInPandas(solve, schema)

    blocks, starts = [], None
    for b in range(last + 1):
        ends = table.filter(F.col("block") == b).drop("block")
        if starts is None:
            offered = ends.withColumns({"reach": F.lit(None).cast("double"), "source": F.lit(None).cast("long")})
        else:
            least = by_tile(starts, ends, offer, offer_schema).groupBy(*keys, "i").agg(F.min(F.struct("reach", "source")).alias("__o"))
            offered = ends.join(least.select(*keys, "i", "__o.*"), [*keys, "i"], "left")
        solved = kept_table(packed(offered, keys, sizes.get(b, 0)).applyInPandas(inside, row))
        blocks.append(solved)
        if b < last:
            new = solved if starts is None else by_tile(starts, solved, outlive, row).unionByName(solved)
            starts = kept_table(new.filter((F.col("until") > (b + 1) * block) & (F.col("best") < float("inf"))))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """From each series' place ``__next`` back to the first row before the block."""
        pdf, bounds = series_bounds(pdf, keys, "i")
        i, back, to, reached = (pdf[c].to_numpy().tolist() for c in ("i", "back", "__next", "__rank"))
        rows = []
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            before = dict(zip(i[a:z], back[a:z], strict=True))
            at, rank, low, first = to[a], reached[a], i[a], len(rows)
            while at > 0 and at >= low:
                start = max(0, before[at])  # without a start the rest is one segment
                rank += 1
                rows.append((a, start, at, rank, 0))
                at = start
            rows[first:] = [(*r[:4], at) for r in rows[first:]]
        out = pd.DataFrame(rows, columns=["__row", "start_idx", "end_idx", "__rank", "__next"], dtype="int64")
        for c in keys:
            out[c] = pdf[c].to_numpy()[out["__row"].to_numpy()]
        return out[segment_schema.fieldNames()]

    at = table.groupBy(*keys).agg(F.max("i").alias("__next")).withColumn("__rank", F.lit(0).cast("long"))
    segments = None
    for b in reversed(range(last + 1)):
        here = blocks[b].select(*keys, "i", "back").join(at.filter((F.col("__next") >= b * block) & (F.col("__next") > 0)), keys)
        found = packed(here, keys, sizes.get(b, 0)).applyInPandas(walk, segment_schema)
        found = kept_table(found) if last else found
        segments = found if segments is None else segments.unionByName(found)
        if b:
            moved = found.groupBy(*keys).agg(F.min("__next").alias("__to"), F.max("__rank").alias("__reached"))
            at = kept_table(at.join(moved, keys, "left").select(
                *keys, F.coalesce("__to", "__next").alias("__next"), F.coalesce("__reached", "__rank").alias("__rank")))
    total = segments.groupBy(*keys).agg(F.max("__rank").alias("__total"))
    return segments.join(total, keys).select(*keys, (F.col("__total") - F.col("__rank")).cast("int").alias("regime"), "start_idx", "end_idx")
