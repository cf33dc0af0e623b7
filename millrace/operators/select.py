"""Projection, renaming, conversion and filters. Narrow operators: no shuffle, filters reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import fixed_values as fixed
from millrace.functions.columns import to_numeric as numeric_column

Limits = Mapping[str, tuple[float | None, float | None]]


def select_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Wanted columns that exist, in wanted order."""
    present = set(df.columns)
    return df.select(*[c for c in wanted if c in present])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def select_numeric(df: DataFrame, exclude: Sequence[str] = fixed.TARGET_AND_LAB_COLUMNS) -> DataFrame:
    return df.select(*numeric_columns(df, exclude))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def _plain_header(name: str) -> str:
    return name.replace("\n", "").replace("\r", "").strip()


def rename_normalized(df: DataFrame, names: Mapping[str, str] = fixed.SHEET_HEADERS) -> DataFrame:
    """Rename by header text without line breaks and outer blanks; columns without a match are dropped."""
    wanted = {_plain_header(k): v for k, v in names.items()}
    picked = [F.col(f"`{c}`").alias(wanted[_plain_header(c)]) for c in df.columns if _plain_header(c) in wanted]
    return df.select(*picked)


def match_columns(columns: Sequence[str], rules: Sequence[tuple[str, Sequence[str]]] = tuple(fixed.SHIFT_HEADER_RULES)) -> dict[str, str]:
    """Column per measure by ordered substring rules; a later matching header replaces an earlier one."""
    found: dict[str, str] = {}
    for column in columns:
        lowered = column.lower()
        hit = next((measure for measure, parts in rules if any(p in lowered for p in parts)), None)
        if hit is not None:
            found[hit] = column
    return found


def match_columns_fuzzy(df: DataFrame, keep: Sequence[str] = (), rules: Sequence[tuple[str, Sequence[str]]] = tuple(fixed.SHIFT_HEADER_RULES)) -> DataFrame:
    """Select ``keep`` and the matched measures under their measure names; unmatched measures become NULL."""
    found = match_columns([c for c in df.columns if c not in keep], rules)
    measures = [
        (F.col(f"`{found[m]}`") if m in found else F.lit(None).cast("string")).alias(m) for m, _ in rules
    ]
    return df.select(*[F.col(f"`{c}`") for c in keep], *measures)


def reorder_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: numeric_column(c) for c in cols})


def filter_time_range(df: DataFrame, time_col: str, start=None, end=None) -> DataFrame:
    """Rows with ``start <= time <= end``; bounds are literals on the bare column, so they reach the scan."""
    if start is not None:
        df = df.filter(F.col(time_col) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(time_col) <= F.lit(end).cast("timestamp"))
    return df


def within(bounds: Limits, strict: bool = False) -> Column:
    """Conjunction of bounds as one predicate; an open side is None."""
    parts: list[Column] = []
    for name, (low, high) in bounds.items():
        c = F.col(name)
        if low is not None:
            parts.append(c > low if strict else c >= low)
        if high is not None:
            parts.append(c < high if strict else c <= high)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _known(df: DataFrame, bounds: Limits) -> Limits:
    return {k: v for k, v in bounds.items() if k in df.columns}


def filter_bounds(df: DataFrame, bounds: Limits = fixed.WIDE_BOUNDS) -> DataFrame:
    """Rows inside all inclusive bounds of the columns that exist; NULL fails."""
    return df.filter(within(_known(df, bounds)))


def filter_bounds_strict(df: DataFrame, limits: Limits = fixed.REPORT_LIMITS) -> DataFrame:
    return df.filter(within(_known(df, limits), strict=True))


def mask_bounds(df: DataFrame, bounds: Limits = fixed.WIDE_BOUNDS, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep every row, but set ``cols`` to NULL where any bound is broken."""
    known = _known(df, bounds)
    inside = within(known)
    return df.withColumns({c: F.when(inside, F.col(c)) for c in (cols or list(known))})


def drop_nulls(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how=how, subset=list(subset) if subset else None)


def drop_total_rows(df: DataFrame, shift_col: str = fixed.SHIFT_COLUMN, marker: str = fixed.TOTAL_MARKER) -> DataFrame:
    return df.filter(~F.coalesce(F.col(shift_col).cast("string").contains(marker), F.lit(False)))


def valid_shift(shift: Column) -> Column:
    """Shift number 1, 2 or 3 from a text or number cell, otherwise NULL."""
    number = numeric_column(shift).cast("int")
    return F.when(number.isin(*fixed.SHIFT_HOURS), number)
