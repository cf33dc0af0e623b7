"""Column-level building blocks. Everything here stays inside Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import fixed_values as fixed

__all__ = [
    "adjusted_kurtosis", "adjusted_skewness", "calendar_parts", "chunk_of", "clean_double", "day_in_month",
    "duration_micros", "floor_time", "month_from_sheet", "right_closed_bin", "safe_corr",
    "sum_of_squares", "to_numeric", "unordered_mean", "year_from_name",
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def duration_micros(text: str) -> int:
    """Length of a duration such as ``1 minute`` or ``8 hours`` in microseconds."""
    return int(pd.Timedelta(text).value // 1000)


def floor_time(ts: Column | str, step: str) -> Column:
    """Start of the epoch-aligned bucket that holds ``ts``."""
    us = F.unix_micros(_col(ts))
    return F.timestamp_micros(us - F.pmod(us, F.lit(duration_micros(step))))


def chunk_of(position: Column, length: int) -> Column:
    """Floor division of a long position; exact for negative positions too."""
    size = F.lit(length).cast("long")
    return ((position - F.pmod(position, size)) / size).cast("long")


def clean_double(c: Column | str) -> Column:
    """Double value with NaN turned into NULL: inside the library NULL is the only missing value."""
    value = _col(c).cast("double")
    return F.when(~F.isnan(value), value)


def to_numeric(c: Column | str) -> Column:
    """Text to double; a decimal comma is accepted, anything unreadable becomes NULL."""
    text = F.regexp_replace(F.trim(_col(c).cast("string")), ",", ".")
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over complete pairs; NULL when a side is constant (``corr`` raises there)."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def sum_of_squares(c: Column | str) -> Column:
    """Sum of squared deviations from the mean, computed in centred form."""
    return F.var_pop(_col(c)) * F.count(_col(c))


def adjusted_skewness(c: Column | str) -> Column:
    """Sample skewness with bias adjustment; NULL below three values, 0 for a constant column."""
    c = _col(c)
    n = F.count(c).cast("double")
    g1 = F.when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(F.skewness(c))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def adjusted_kurtosis(c: Column | str) -> Column:
    """Sample excess kurtosis with bias adjustment; NULL below four values, 0 for a constant column."""
    c = _col(c)
    n = F.count(c).cast("double")
    raw = F.try_divide((n - 1) * ((n + 1) * F.kurtosis(c) + 6), (n - 2) * (n - 3))
    return F.when(n >= 4, F.when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(raw))


def calendar_parts(ts: Column | str) -> dict[str, Column]:
    ts = _col(ts)
    return {"month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts)}


def right_closed_bin(c: Column | str, edges: Sequence[float]) -> Column:
    """Bin number from 0 in right-closed bins, lowest edge included, NULL outside the edges.

    The number of inner edges below the value is the bin number, so it stays a plain sum of comparisons.
    """
    c = _col(c)
    if len(edges) < 2:
        return F.lit(None).cast("int")
    inside = (c >= F.lit(float(edges[0]))) & (c <= F.lit(float(edges[-1])))
    number = F.lit(0)
    for edge in edges[1:-1]:
        number = number + (c > F.lit(float(edge))).cast("int")
    return F.when(inside, number)


def year_from_name(path: Column | str) -> Column:
    """First ``20xx`` in the last part of a path, NULL when there is none."""
    base = F.element_at(F.split(_col(path), r"[/\\]"), -1)
    return F.nullif(F.regexp_extract(base, r"(20\d{2})", 1), F.lit("")).cast("int")


def month_from_sheet(name: Column | str, numeric_names: bool = False) -> Column:
    """Month number of a sheet name; ``numeric_names`` also accepts a number, held within 1..12, and takes any other
    name as the first month."""
    name = _col(name)
    pairs = [F.lit(v) for item in fixed.MONTH_NUMBERS.items() for v in item]
    month = F.try_element_at(F.create_map(*pairs), name)
    if numeric_names:
        number = F.trim(name).try_cast("int")
        held = F.when(number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(12), number))).otherwise(F.lit(1))
        month = F.coalesce(month, F.when(name.isNotNull(), held))
    return month


def day_in_month(year: Column, month: Column, day: Column) -> Column:
    """Whether ``day`` exists in the month."""
    last = F.dayofmonth(F.last_day(F.try_make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))))
    return (day >= 1) & (day <= last)


def unordered_mean(col: str) -> Column:
    """Mean that does not depend on the order of addition: a sum of doubles does in its last bit, which is enough to break a flat top.

    Values are added as decimals of 18 places, as they are written. Where a value is too large or all are too small for that, it is the
    mean of doubles.
    """
    value = F.col(col)
    size = F.max(F.abs(value))
    exact = F.try_avg(F.when(F.abs(value) < 1e12, value).cast("decimal(38,18)")).cast("double")
    return F.coalesce(F.when((size < 1e12) & ((size >= 1e-3) | (size == 0)), exact), F.avg(value))
