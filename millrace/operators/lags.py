"""Delay between series from cross-correlation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import duration_micros
from millrace.operators.chunks import CHUNK, DEFAULT_CHUNK, HOME, POSITION, row_index, time_position, with_halo
from millrace.operators.windows import detrend, shift_rows, shift_rows_by
from millrace.session import cut_lineage

SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def unpivot_features(df: DataFrame, series_cols: Sequence[str], time_col: str, target: str, features: Sequence[str]) -> DataFrame:
    """Rows (series, feature, time, x, y) with both values present."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    long = df.select(*series_cols, time_col, F.col(target).cast("double").alias("y"), pairs.alias("__p"))
    return long.select(*series_cols, "__p.feature", time_col, "__p.x", "y").filter("x is not null and y is not null")


def ccf_table(
    df: DataFrame, series_cols: Sequence[str], time_col: str, target: str, features: Sequence[str], *, max_lag: int = 120,
    detrend_rows: int | None = 60, step: str | None = None, rows_per_chunk: int = 20_000, chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Correlation of ``target(t)`` and ``feature(t - lag)`` for each lag; positive lag means the feature leads.

    Rows are counted after removing incomplete pairs, or placed on the time grid ``step``. Lags are evaluated inside
    chunks: what is shuffled per chunk is one set of sums per lag, not a copy of the data per lag. Standardising the
    two series does not change a correlation and is left out; both are centred for numerical safety.
    """
    long = unpivot_features(df, series_cols, time_col, target, features)
    by = [*series_cols, "feature"]
    if detrend_rows and detrend_rows > 1:
        flat = detrend(long, by, time_col, ["x", "y"], detrend_rows, suffix="_d", chunk=chunk)
        long = flat.select(*by, time_col, F.col("x_d").alias("x"), F.col("y_d").alias("y"))
    if step is None:
        placed = row_index(long, by, time_col, name="__i", chunk=chunk)
        position = F.col("__i")
    else:
        placed, position = long, (time_position(time_col) / F.lit(duration_micros(step))).cast("long")
    haloed = with_halo(placed.select(*by, "x", "y", position.alias("__i")), F.col("__i"), max(rows_per_chunk, max_lag), max_lag, max_lag)
    keys = [f for f in haloed.schema.fields if f.name in by]
    schema = T.StructType(keys + [T.StructField("lag", T.IntegerType())] + [T.StructField(s, T.DoubleType()) for s in SUMS])

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POSITION)
        start = int(pdf[POSITION].iloc[0])
        size = int(pdf[POSITION].iloc[-1]) - start + 1
        at = (pdf[POSITION] - start).to_numpy()
        x, y = np.zeros(size), np.zeros(size)
        has_x, has_y = np.zeros(size), np.zeros(size)
        x[at], has_x[at] = pdf["x"].to_numpy(), 1.0
        home = pdf[HOME].to_numpy()
        y[at[home]], has_y[at[home]] = pdf["y"].to_numpy()[home], 1.0
        rows = []
        for lag in range(-max_lag, max_lag + 1):
            cut = min(abs(lag), size)
            a, ha = (x[: size - cut], has_x[: size - cut]) if lag >= 0 else (x[cut:], has_x[cut:])
            b, hb = (y[cut:], has_y[cut:]) if lag >= 0 else (y[: size - cut], has_y[: size - cut])
            rows.append((lag, ha @ hb, a @ hb, b @ ha, (a * a) @ hb, (b * b) @ ha, a @ b))
        out = pd.DataFrame(rows, columns=["lag", *SUMS])
        for f in keys:
            out[f.name] = pdf[f.name].iloc[0]
        return out[[f.name for f in schema.fields]]

    parts = haloed.groupBy(*by, CHUNK).applyInPandas(sums, schema)
    total = parts.groupBy(*by, "lag").agg(*[F.sum(s).alias(s) for s in SUMS])
    n, sx, sy, sxx, syy, sxy = (F.col(s) for s in SUMS)
    cov = n * sxy - sx * sy
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    # a variance that is only rounding noise counts as none
    corr = F.when((vx > 1e-12 * n * sxx) & (vy > 1e-12 * n * syy), F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))
    return total.select(*by, "lag", n.cast("long").alias("n"), corr.alias("corr"))


def estimate_lag_ccf(df: DataFrame, series_cols: Sequence[str], time_col: str, target: str, features: Sequence[str], **options) -> DataFrame:
    """Lag with the largest absolute correlation per feature, the smallest lag on ties."""
    table = ccf_table(df, series_cols, time_col, target, features, **options)
    strength = F.abs(F.col("corr"))
    order = W.partitionBy(*series_cols, "feature").orderBy(strength.desc_nulls_last(), "lag")
    return table.withColumn("__r", F.row_number().over(order)).filter("__r = 1 and corr is not null").select(
        *series_cols, "feature", F.col("lag").alias("best_lag"), F.col("corr").alias("best_corr"))


def align_by_best_lag(
    df: DataFrame, time_col: str, target: str, features: Sequence[str], *, series_cols: Sequence[str] = (),
    trim: bool = True, **options,
) -> DataFrame:
    """Shift every feature of every series by its own best lag, all at once; rows left without a value are trimmed."""
    best = estimate_lag_ccf(df, series_cols, time_col, target, features, **options)
    complete = df.dropna(subset=[target, *features]) if trim else df
    if series_cols:
        shifts = cut_lineage(best.select(*series_cols, "feature", F.col("best_lag").alias("shift")))
        return shift_rows_by(complete, series_cols, time_col, shifts, list(features), trim=trim)
    shifts = {r["feature"]: r["best_lag"] for r in best.select("feature", "best_lag").collect() if r["best_lag"]}
    return shift_rows(complete, series_cols, time_col, shifts, trim=trim) if shifts else complete
