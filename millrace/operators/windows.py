"""Rolling, recursive and local filters along a series."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.chunks import (
    CHUNK, DEFAULT_CHUNK, DEFAULT_ROWS, HOME, by_chunk, framed, row_index, with_halo,
)
from millrace.operators.grid import fill_gaps
from millrace.operators.quantiles import grouped_quantile
from millrace.session import cut_lineage

FRAME_AGGREGATES = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


def frame_sides(width: int, center: bool) -> tuple[int, int]:
    """Rows before and after the current one in a frame of ``width`` rows; even centred frames reach further back."""
    after = (width - 1) // 2 if center else 0
    return width - 1 - after, after


def rolling(
    df: DataFrame, series_cols: Sequence[str], time_col: str, cols: Sequence[str], width: int, agg: str = "mean", *,
    center: bool = True, min_periods: int | None = None, suffix: str = "_roll", step: str | None = None,
    tie_cols: Sequence[str] = (), chunk: str = DEFAULT_CHUNK, rows_per_chunk: int = DEFAULT_ROWS,
) -> DataFrame:
    """Frame aggregate over ``width`` rows; NULL when fewer than ``min_periods`` values (default: the width) are there."""
    needed = width if min_periods is None else min_periods
    before, after = frame_sides(width, center)

    def build(w: W) -> dict[str, Column]:
        frame = w.rowsBetween(-before, after)
        return {
            f"{c}{suffix}": F.when(F.count(c).over(frame) >= needed, FRAME_AGGREGATES[agg](F.col(c)).over(frame))
            for c in cols
        }

    return framed(df, series_cols, time_col, before, after, build, step=step, tie_cols=tie_cols, chunk=chunk,
                  rows_per_chunk=rows_per_chunk)


def rolling_mean(df, series_cols, time_col, cols, width=15, **options) -> DataFrame:
    return rolling(df, series_cols, time_col, cols, width, "mean", **{"min_periods": 1, **options})


def rolling_median(df, series_cols, time_col, cols, width=5, **options) -> DataFrame:
    return rolling(df, series_cols, time_col, cols, width, "median", **{"min_periods": 1, **options})


def detrend(df, series_cols, time_col, cols, width=60, suffix="_detrended", **options) -> DataFrame:
    """Subtract the mean of the last ``width`` rows, the current one included."""
    rolled = rolling(df, series_cols, time_col, cols, width, "mean", center=False, min_periods=1, suffix="__m", **options)
    return rolled.select(*df.columns, *[(F.col(c) - F.col(f"{c}__m")).alias(f"{c}{suffix}") for c in cols])


def rolling_zscore(
    df: DataFrame, series_cols: Sequence[str], time_col: str, cols: Sequence[str], width: int = 30, *,
    suffix: str = "_z", **options,
) -> DataFrame:
    """Absolute distance from the centred rolling mean in rolling sample deviations; full windows only."""
    before, after = frame_sides(width, True)

    def build(w: W) -> dict[str, Column]:
        frame = w.rowsBetween(-before, after)
        return {
            f"{c}{suffix}": F.when(
                F.count(c).over(frame) >= width,
                F.abs(F.try_divide(F.col(c) - F.avg(c).over(frame), F.stddev_samp(c).over(frame))))
            for c in cols
        }

    return framed(df, series_cols, time_col, before, after, build, **options)


def zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), suffix: str = "_z") -> DataFrame:
    """Standard score with population deviation; a constant column is only centred."""
    stats = [f(F.col(c).cast("double")).alias(f"__{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))]

    def score(c: str, mean: Column, std: Column) -> Column:
        return ((F.col(c) - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)).alias(f"{c}{suffix}")

    if by:
        joined = df.join(df.groupBy(*by).agg(*stats), list(by), "left")
        return joined.select(*df.columns, *[score(c, F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in cols])
    row = df.agg(*stats).first()
    return df.select("*", *[score(c, F.lit(row[f"__m_{c}"]), F.lit(row[f"__s_{c}"])) for c in cols])


def shift_rows(
    df: DataFrame, series_cols: Sequence[str], time_col: str, shifts: dict[str, int], *, trim: bool = False, **options,
) -> DataFrame:
    """Replace columns by their value ``k`` rows earlier (later for negative ``k``).

    ``trim`` drops the rows at the series' ends for which a shifted row does not exist, and rows whose shifted value is
    NULL. All shifts are applied at once.
    """
    back = max([0, *shifts.values()])
    ahead = max([0, *[-k for k in shifts.values()]])

    def build(w: W) -> dict[str, Column]:
        moved = {f"__v_{c}": F.lag(c, k).over(w) for c, k in shifts.items()}
        moved["__ok"] = F.lag(F.lit(True), back).over(w).isNotNull() & F.lead(F.lit(True), ahead).over(w).isNotNull()
        return moved

    out = framed(df, series_cols, time_col, back, ahead, build, **options)
    if trim:
        out = out.filter("__ok").dropna(subset=[f"__v_{c}" for c in shifts])
    return out.select(*[F.col(f"__v_{c}").alias(c) if c in shifts else F.col(c) for c in df.columns])


def shift_rows_by(
    df: DataFrame, series_cols: Sequence[str], time_col: str, shifts: DataFrame, features: Sequence[str], *, trim: bool = False,
    chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """``shift_rows`` with a shift per series and feature, given as rows (series, feature, shift); none means 0.

    Values move to the row number they belong to, in long form, and are gathered there again: two shuffles by (series, row), whatever the shifts.
    """
    numbered = cut_lineage(row_index(df, series_cols, time_col, name="__i", total="__n", chunk=chunk))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("__c")
    long = numbered.select(*series_cols, "__i", cells).select(*series_cols, "__i", "__c.feature", "__c.v")
    moved = long.join(shifts.select(*series_cols, "feature", "shift"), [*series_cols, "feature"], "left").withColumn(
        "__i", F.col("__i") + F.coalesce("shift", F.lit(0)))
    wide = moved.groupBy(*series_cols, "__i").agg(
        *[F.max(F.when(F.col("feature") == f, F.col("v"))).cast(df.schema[f].dataType).alias(f"__v_{f}") for f in features])
    reach = shifts.groupBy(*series_cols).agg(F.greatest(F.max("shift"), F.lit(0)).alias("__back"), F.greatest(-F.min("shift"), F.lit(0)).alias("__ahead"))
    out = numbered.join(wide, [*series_cols, "__i"], "left").join(reach, list(series_cols), "left")
    if trim:
        inside = (F.col("__i") >= F.coalesce("__back", F.lit(0))) & (F.col("__i") < F.col("__n") - F.coalesce("__ahead", F.lit(0)))
        out = out.filter(inside).dropna(subset=[f"__v_{f}" for f in features])
    return out.select(*[F.col(f"__v_{c}").alias(c) if c in features else F.col(c) for c in df.columns])


def diff_prev(df: DataFrame, series_cols: Sequence[str], time_col: str, col: str, name: str, **options) -> DataFrame:
    return framed(df, series_cols, time_col, 1, 0, lambda w: {name: F.col(col) - F.lag(col).over(w)}, **options)


# --- filters that need a whole neighbourhood: Arrow grouped maps over chunks with a halo ---------------------------


def _per_chunk(
    df: DataFrame, series_cols: Sequence[str], time_col: str, cols: Sequence[str], before: int, after: int, compute,
    suffix: str, rows_per_chunk: int, chunk: str, tie_cols: Sequence[str] = (),
) -> DataFrame:
    """Run ``compute(values, positions, n_rows)`` on each chunk and column; only the chunk's own rows are returned."""
    numbered = row_index(df, series_cols, time_col, tie_cols=tie_cols, name="__i", total="__n", chunk=chunk)
    placed = with_halo(numbered, F.col("__i"), max(rows_per_chunk, before + after), before, after).drop("__pos")
    placed = by_chunk(placed, series_cols)
    fields = [f for f in df.schema.fields] + [T.StructField(f"{c}{suffix}", T.DoubleType()) for c in cols]
    names = [f.name for f in fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        positions = pdf["__i"].to_numpy()
        total = int(pdf["__n"].iloc[0])
        for c in cols:
            pdf[f"{c}{suffix}"] = compute(pdf[c].to_numpy(dtype=float), positions, total)
        return pdf.loc[pdf[HOME], names]

    return placed.groupBy(*series_cols, CHUNK).applyInPandas(run, T.StructType(fields))


def ewm(
    df: DataFrame, series_cols: Sequence[str], time_col: str, cols: Sequence[str], *, alpha: float | None = None,
    span: float | None = None, adjust: bool = False, gaps: bool = True, suffix: str = "_ewm",
    rows_per_chunk: int = DEFAULT_ROWS, chunk: str = DEFAULT_CHUNK, tie_cols: Sequence[str] = (),
) -> DataFrame:
    """Exponentially weighted mean, recursive (``adjust=False``) or as a weighted mean (``adjust=True``).

    A row's weight falls below double precision after a fixed number of rows, which is the halo a chunk needs.
    NULL rows repeat the last result, over any distance; ``gaps=False`` promises that there are none and saves a pass.
    """
    if (alpha is None) == (span is None):
        raise ValueError("give either alpha or span")
    factor = alpha if alpha is not None else 2.0 / (span + 1.0)
    # rows after which a weight is below 1e-18 of the current one
    reach = 0 if factor >= 1 else math.ceil(math.log(1e-18) / math.log(1.0 - factor))

    def compute(values: np.ndarray, positions: np.ndarray, total: int) -> np.ndarray:
        return pd.Series(values).ewm(alpha=factor, adjust=adjust).mean().to_numpy()

    out = _per_chunk(df, series_cols, time_col, cols, reach, 0, compute, suffix, rows_per_chunk, chunk, tie_cols)
    if not gaps:
        return out
    return fill_gaps(out, series_cols, time_col, [f"{c}{suffix}" for c in cols], "ffill", tie_cols=tie_cols, chunk=chunk)


def ewm_recursive(df, series_cols, time_col, cols, alpha=0.3, **options) -> DataFrame:
    return ewm(df, series_cols, time_col, cols, alpha=alpha, adjust=False, **options)


def ewm_span(df, series_cols, time_col, cols, span=15, **options) -> DataFrame:
    return ewm(df, series_cols, time_col, cols, span=span, adjust=True, **options)


def odd_window(width: int, larger: bool = False) -> int:
    return width if width % 2 else width + (1 if larger else -1)


def savgol_matrix(width: int, poly: int) -> np.ndarray:
    """Row ``k`` gives the fitted value at position ``k`` of a window as weights of the window's values."""
    x = np.linspace(-1.0, 1.0, width)
    basis = np.vander(x, poly + 1, increasing=True)
    q, _ = np.linalg.qr(basis)
    return q @ q.T


def savgol(
    df: DataFrame, series_cols: Sequence[str], time_col: str, cols: Sequence[str], width: int = 11, poly: int = 2, *,
    suffix: str = "_smooth", larger: bool = False, step: str | None = None, rows_per_chunk: int = DEFAULT_ROWS, chunk: str = DEFAULT_CHUNK,
    tie_cols: Sequence[str] = (),
) -> DataFrame:
    """Least-squares polynomial smoothing; the ends use the fit of the first and last full window.

    A series shorter than the window gets the largest odd window that it fills. The weights of a row depend on its place in its window
    alone, so they are a table of ``width`` places, and smoothing is a sum of products over the rows around. How many of those
    there are also tells how near the ends of the series are; with ``step``, on a regular grid, no row is numbered. A NULL among the rows gives NULL.
    """
    width = odd_window(width, larger)
    if width == 1:
        return df.select("*", *[F.col(c).cast("double").alias(f"{c}{suffix}") for c in cols])
    reach, held = width - 1, {c: f"__x_{c}" for c in cols}

    def build(w: W) -> dict[str, Column]:
        around = w.rowsBetween(-reach, reach)
        return {"__p": F.count(F.lit(1)).over(w.rowsBetween(-reach, -1)), "__a": F.count(F.lit(1)).over(w.rowsBetween(1, reach)),
                **{name: F.collect_list(F.struct(F.col(c).cast("double").alias("v"))).over(around) for c, name in held.items()}}

    out = framed(df, series_cols, time_col, reach, reach, build, step=step, tie_cols=tie_cols, chunk=chunk, rows_per_chunk=rows_per_chunk)
    there = F.col("__p") + F.col("__a") + 1  # all of a series that is shorter than the window
    own = F.when(there >= width, width).otherwise(there - 1 + there % 2)
    half = F.floor(own / 2)
    place = F.when(F.col("__p") < half, F.col("__p")).when(F.col("__a") < half, own - 1 - F.col("__a")).otherwise(half)
    # as many rows as a window has places, for each odd size up to the window's
    weights = [(size, k, [float(x) for x in row]) for size in range(1, width + 1, 2) for k, row in enumerate(savgol_matrix(size, min(poly, size - 1)))]
    table = df.sparkSession.createDataFrame(weights, "__own int, __k int, __weights array<double>")
    placed = out.withColumns({"__own": own.cast("int"), "__k": place.cast("int")}).join(F.broadcast(table), ["__own", "__k"])

    def smooth(name: str) -> Column:
        used = F.slice(F.col(name), (F.col("__p") - F.col("__k") + 1).cast("int"), F.col("__own"))
        return F.aggregate(F.zip_with(used, "__weights", lambda x, y: x["v"] * y), F.lit(0.0), lambda total, x: total + x)

    return placed.select(*df.columns, *[smooth(name).alias(f"{c}{suffix}") for c, name in held.items()])


def lowess(
    df: DataFrame, series_cols: Sequence[str], time_col: str, col: str, frac: float = 0.3, *, iterations: int = 3,
    suffix: str = "_lowess", block: int = 1024, chunk: str = DEFAULT_CHUNK, tie_cols: Sequence[str] = (),
) -> DataFrame:
    """Local linear regression over the ``frac`` nearest rows with tricube weights and robustness rounds.

    A fit may span a large part of the series, so it is never gathered. A tricube weight is a polynomial in the distance on
    either side of a row, so all rows of a block that lies wholly on one side, inside the neighbourhoods of all fits of another block, enter
    through their moments; only blocks at the borders of the neighbourhoods, and the block of the fits itself, are sent there row by
    row: some eight blocks, whatever the length. Moments are summed along the series within stretches of half a neighbourhood, which keeps
    them small, so a stretch of any length takes two of them. NULL rows are left out, as if absent.
    """
    base = df.filter(F.col(col).isNotNull())
    points = cut_lineage(row_index(base, series_cols, time_col, tie_cols=tie_cols, name="__i", total="__n", chunk=chunk)
                         .withColumn("__w", F.lit(1.0)))
    name = f"{col}{suffix}"
    fitted = None
    for round_no in range(iterations + 1):
        fitted = _local_fits(points, series_cols, col, frac, block)
        if round_no == iterations:
            break
        joined = points.drop("__w").join(fitted, [*series_cols, "__i"])
        residual = F.abs(F.col(col) - F.col("__fit"))
        scale = grouped_quantile(joined.withColumn("__res", residual), series_cols, "__res", 0.5, "__med")
        joined = joined.join(scale, list(series_cols)) if series_cols else joined.withColumn("__med", F.lit(scale.first()[0]))
        u = F.try_divide(residual, 6.0 * F.col("__med"))
        # an exact median fit leaves no scale: rows on the fit keep full weight, others none
        weight = F.when(F.col("__med") == 0, (residual == 0).cast("double")).when(u < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(0.0)
        points = cut_lineage(joined.withColumn("__w", weight).drop("__fit", "__med"))
    return points.join(fitted, [*series_cols, "__i"]).select(*df.columns, F.col("__fit").alias(name))


#: Powers of the distance: 9 of the tricube weight and 2 of the regression.
POWERS = 12
FIT_SUMS = ["__s0", "__s1", "__s2", "__t0", "__t1"]


def neighbourhood_start(i, n: int, k: int):
    """First of the ``k`` rows nearest to row ``i`` of ``n``; of two equally far the earlier one belongs."""
    return np.clip(i - k // 2, 0, n - k)


def _needed_blocks(n: int, k: int, block: int, half: int) -> list[tuple[int, int, int, int]]:
    """(fit block, row block, sign, kind) for one series: rows of border blocks (kind 0) and moments summed up to a block (kind 1, with the sign)."""
    found = []
    last = (n - 1) // block
    for t in range(last + 1):
        low, high = (int(neighbourhood_start(x, n, k)) for x in (t * block, min(n, (t + 1) * block) - 1))
        # blocks wholly between the farthest start and the fits, and between the fits and the nearest end
        sides = ((-(-high // block), t), (t + 1, (low + k) // block))
        border = set(range(low // block, (high + k - 1) // block + 1))
        for a, b in sides:
            if b - a < 2:
                continue
            border -= set(range(a, b))
            # pieces within stretches of `half` rows
            while a < b:
                stretch = a * block // half
                upto = min(b, -(-(stretch + 1) * half // block))
                found.append((t, upto - 1, 1, 1))
                if (a - 1) * block // half == stretch and a:
                    found.append((t, a - 1, -1, 1))
                a = upto
        found += [(t, s, 1, 0) for s in sorted(border)]
    return found


def _local_fits(points: DataFrame, series_cols: Sequence[str], col: str, frac: float, block: int) -> DataFrame:
    nearest = F.least(F.greatest(F.floor(F.col("__n") * F.lit(frac) + F.lit(1e-10)), F.lit(2)), F.greatest("__n", F.lit(2))).cast("long")
    own_block = F.floor(F.col("__i") / block).cast("long")
    placed = points.select(*series_cols, "__i", "__n", "__w", F.col(col).cast("double").alias("__y")).withColumns(
        {"__k": nearest, "__source": own_block})
    half = F.greatest(F.floor(F.col("__k") / 2), F.lit(block)).cast("long")
    key_fields = [f for f in points.schema.fields if f.name in series_cols]
    wide = T.StructType(key_fields + [T.StructField("__i", T.LongType())] + [T.StructField(s, T.DoubleType()) for s in FIT_SUMS])
    names = wide.fieldNames()

    # which blocks meet, from a row per series
    plan_schema = T.StructType(key_fields + [T.StructField(c, T.LongType()) for c in ("__target", "__source", "__sign", "__kind", "__n", "__k", "__half")])

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                rows = _needed_blocks(int(row["__n"]), int(row["__k"]), block, int(row["__half"]))
                for at in range(0, len(rows), 50_000):
                    out = pd.DataFrame(rows[at:at + 50_000], columns=["__target", "__source", "__sign", "__kind"])
                    for c in [*series_cols, "__n", "__k", "__half"]:
                        out[c] = row[c]
                    yield out[plan_schema.fieldNames()]

    series = placed.groupBy(*series_cols).agg(F.max("__n").alias("__n"), F.max("__k").alias("__k")).filter(F.col("__n") > 0)
    needs = cut_lineage(series.withColumn("__half", half).mapInPandas(plan, plan_schema))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of a border block, one by one."""
        total, k, target = (int(pdf[c].iloc[0]) for c in ("__n", "__k", "__target"))
        rows = np.arange(target * block, min(total, (target + 1) * block))
        source, y, robust = pdf["__i"].to_numpy(), pdf["__y"].to_numpy(), pdf["__w"].to_numpy()
        acc = np.zeros((len(FIT_SUMS), len(rows)))
        for begin in range(0, len(rows), 512):
            part = rows[begin:begin + 512]
            left = neighbourhood_start(part, total, k)
            far = np.maximum(part - left, left + k - 1 - part)
            d = source[None, :] - part[:, None]
            inside = (source[None, :] >= left[:, None]) & (source[None, :] <= (left + k - 1)[:, None])
            share = np.abs(d) / np.maximum(far, 1)[:, None]
            # the usual cut-offs: full weight very near, none at the edge of the neighbourhood
            tri = np.where(share <= 0.001, 1.0, np.where(share < 0.999, (1 - np.minimum(share, 1) ** 3) ** 3, 0.0))
            w = np.where(inside, tri, 0.0) * robust[None, :]
            acc[0, begin:begin + 512] = w.sum(1)
            acc[1, begin:begin + 512] = (w * d).sum(1)
            acc[2, begin:begin + 512] = (w * d * d).sum(1)
            acc[3, begin:begin + 512] = (w * y[None, :]).sum(1)
            acc[4, begin:begin + 512] = (w * d * y[None, :]).sum(1)
        return _fit_rows(pdf, rows, acc)

    def far_off(pdf: pd.DataFrame) -> pd.DataFrame:
        """Moments of whole blocks on either side."""
        total, k, target, half = (int(pdf[c].iloc[0]) for c in ("__n", "__k", "__target", "__half"))
        rows = np.arange(target * block, min(total, (target + 1) * block))
        middle = target * block + block / 2
        acc = np.zeros((len(FIT_SUMS), len(rows)))
        far = np.maximum(rows - neighbourhood_start(rows, total, k), neighbourhood_start(rows, total, k) + k - 1 - rows).astype(float)
        before = (pdf["__source"] < target).to_numpy()
        for side, mine in ((-1.0, before), (1.0, ~before)):
            if not mine.any():
                continue
            sums = np.zeros((2, POWERS))  # about the middle of the fits, in units of `half`
            for r in pdf[mine].to_dict("records"):
                shift = (r["_stretch"] * half - middle) / half
                for q, kind in enumerate(("a", "b")):
                    own = np.array([r[f"_{kind}{m}"] for m in range(POWERS)])
                    for m in range(POWERS):
                        sums[q, m] += r["__sign"] * sum(math.comb(m, j) * own[j] * shift ** (m - j) for j in range(m + 1))
            # about each fit, in units of its own reach
            step, unit = (middle - rows) / half, half / far
            about = np.zeros((2, POWERS, len(rows)))
            for m in range(POWERS):
                about[:, m] = sum(math.comb(m, j) * sums[:, j][:, None] * step[None, :] ** (m - j) for j in range(m + 1)) * unit ** m
            for p in range(3):
                for q in range(2 if p < 2 else 1):
                    value = sum(c * side ** m * about[q, m + p] for m, c in ((0, 1), (3, -3), (6, 3), (9, -1))) * far ** p
                    acc[(3 if q else 0) + p] += value
        return _fit_rows(pdf, rows, acc)

    def _fit_rows(pdf: pd.DataFrame, rows: np.ndarray, acc: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({s: acc[j] for j, s in enumerate(FIT_SUMS)})
        out.insert(0, "__i", rows)
        for c in series_cols:
            out[c] = pdf[c].iloc[0]
        return out[names]

    by_row = placed.join(needs.filter("__kind = 0").select(*series_cols, "__source", "__target"), [*series_cols, "__source"])
    parts = by_row.groupBy(*series_cols, "__target", "__source").applyInPandas(near, wide)
    whole = needs.filter("__kind = 1")
    if not whole.isEmpty():
        # moments of each block about the start of its stretch, summed along the stretch
        stretch = F.floor(F.col("__source") * block / half).cast("long")
        u = (F.col("__i") - stretch * half) / half
        powers = [F.lit(1.0), u]
        for _ in range(POWERS - 2):
            powers.append(powers[-1] * u)
        moments = placed.groupBy(*series_cols, "__source", stretch.alias("_stretch")).agg(
            *[F.sum(F.col("__w") * x).alias(f"_a{m}") for m, x in enumerate(powers)],
            *[F.sum(F.col("__w") * F.col("__y") * x).alias(f"_b{m}") for m, x in enumerate(powers)])
        along = W.partitionBy(*series_cols, "_stretch").orderBy("__source").rowsBetween(W.unboundedPreceding, 0)
        summed = moments.select(*series_cols, "__source", "_stretch", *[F.sum(f"_{q}{m}").over(along).alias(f"_{q}{m}") for q in "ab" for m in range(POWERS)])
        asked = whole.drop("__kind").join(summed, [*series_cols, "__source"])
        parts = parts.unionByName(asked.groupBy(*series_cols, "__target").applyInPandas(far_off, wide))
    s = parts.groupBy(*series_cols, "__i").agg(*[F.sum(x).alias(x) for x in FIT_SUMS])
    s0, s1, s2, t0, t1 = (F.col(x) for x in FIT_SUMS)
    spread_x = s2 - F.try_divide(s1 * s1, s0)
    slope = F.when(spread_x > 1e-12, F.try_divide(t1 - F.try_divide(s1 * t0, s0), spread_x))
    mean_x, mean_y = F.try_divide(s1, s0), F.try_divide(t0, s0)
    fit = F.coalesce(mean_y - slope * mean_x, mean_y)
    return s.select(*series_cols, "__i", fit.alias("__fit"))
