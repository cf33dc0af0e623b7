"""The whole regime study: sweep penalties, pick one, segment, label, summarise, correlate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.operators.chunks import DEFAULT_CHUNK
from millrace.operators.dedup import top_k
from millrace.operators.regimes import (
    change_table, detect_regimes, label_rows, penalty_measures, pick_penalty, regime_features, segment_times, segments_of_penalties,
    settled_features, summarize_segments,
)
from millrace.operators.stats import regime_corr
from millrace.session import cut_lineage


@dataclass
class RegimeStudy:
    tuning: DataFrame
    penalty: DataFrame
    segments: DataFrame
    labelled: DataFrame
    summary: DataFrame
    correlations: DataFrame
    lowest: DataFrame
    highest: DataFrame
    jumps: DataFrame


def samples(minutes: float, step: str) -> int:
    """Minutes to rows of the grid, rounded up, at least one."""
    return max(1, math.ceil(minutes / (pd.Timedelta(step).total_seconds() / 60)))


def regime_study(
    df: DataFrame, time_col: str, *, series_cols: Sequence[str] = (), features: Sequence[str] | None = None, target: str = "PSI200",
    penalties: Sequence[float] = tuple(fixed.PENALTIES), min_size: int = 60, min_minutes: float | None = None, jump: int = 5,
    step: str = "5 minutes", min_regimes: int = 5, max_regimes: int = 120, min_avg_minutes: float = 180,
    target_regimes: int | None = None, method: str = "pelt", corr_method: str = "pearson", chunk: str = DEFAULT_CHUNK,
) -> RegimeStudy:
    """The study of one series, or of each of several: every series has its own penalty, segments, summary and extremes."""
    wanted = [c for c in (features or []) if c in df.columns]
    chosen = wanted if len(wanted) >= 2 else regime_features(df.drop(*series_cols))
    if min_minutes is not None:
        min_size = max(min_size, samples(min_minutes, step))
    base = cut_lineage(df)
    filled = settled_features(base, series_cols, time_col, chosen, target if target in base.columns else None, chunk)
    points = cut_lineage(change_table(
        filled, series_cols, time_col, chosen, jump, target=target if target in base.columns else None, chunk=chunk))
    every, with_penalty = segments_of_penalties(filled, points, series_cols, time_col, chosen, penalties, method, min_size, jump, chunk)
    every = cut_lineage(every)
    tuning = cut_lineage(penalty_measures(every, points, series_cols))
    penalty = cut_lineage(pick_penalty(
        tuning, series_cols, min_regimes=min_regimes, max_regimes=max_regimes, min_avg_len=samples(min_avg_minutes, step)))
    if target_regimes is None:
        # segmentations of the sweep are reused; a median between two tried penalties needs one of its own
        known = every.join(penalty, [*series_cols, "penalty"])
        untried = penalty.filter(~F.col("penalty").isin([float(p) for p in penalties]))
        found = known if untried.isEmpty() else known.unionByName(with_penalty(untried))
        segments = segment_times(found.drop("penalty"), points, series_cols)
    else:
        # a number of changes is a matter of the greedy methods
        segments = detect_regimes(base, series_cols, time_col, chosen, method="binseg" if method == "pelt" else method,
                                  min_size=min_size, jump=jump, n_bkps=max(0, target_regimes - 1), chunk=chunk)
    segments = cut_lineage(segments)
    labelled = cut_lineage(label_rows(base, segments, series_cols, time_col, chunk))
    summary = summarize_segments(labelled, series_cols, time_col, target=target)
    mean, delta = f"{target}_mean", "psi200_delta_vs_prev"
    return RegimeStudy(
        tuning, penalty, segments, labelled, summary,
        regime_corr(labelled, target, [c for c in chosen if c != target], corr_method, [*series_cols, "regime"]),
        top_k(summary, 5, [F.col(mean).asc_nulls_last(), "regime"], series_cols), top_k(summary, 5, [F.col(mean).desc_nulls_last(), "regime"], series_cols),
        top_k(summary.select(*series_cols, "regime", "start_time", delta), 10, [F.abs(F.col(delta)).desc_nulls_last(), "regime"], series_cols))
