"""Sensor and laboratory data on one time grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.operators.chunks import DEFAULT_CHUNK
from millrace.operators.grid import process_series
from millrace.operators.joins import join_on_time


def combine_mill_and_lab(
    mill: DataFrame, lab: DataFrame, time_col: str, features: Sequence[str], lab_cols: Sequence[str] = tuple(fixed.LAB_COLUMNS), *,
    series_cols: Sequence[str] = ("mill",), step: str = "1 minute", smooth: int = 15, start=None, end=None,
    mill_order: Sequence[str] = (), lab_order: Sequence[str] = (), hold_past_end: bool = False, chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Smoothed sensor rows with the laboratory values that hold at their time.

    Laboratory rows are plant-wide (no series) and few. By default the frame ends at the last laboratory row, as an
    inner join does; ``hold_past_end`` lets the last values hold on.
    """
    smoothed = process_series(mill, series_cols, time_col, features, step=step, smooth=smooth, start=start, end=end, order=mill_order, chunk=chunk)
    until = smoothed.agg(F.max(time_col)).first()[0] if hold_past_end else None
    held = process_series(lab, [], time_col, lab_cols, step=step, hold=True, start=start, end=end, order=lab_order,
                          hold_until=until, chunk=chunk)
    return join_on_time(smoothed, held, [time_col])
