"""Shift reports from landed monthly sheets.

Sheet rows have ``file``, ``sheet``, ``row_no`` and text cells; order within a sheet is ``row_no``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.functions.columns import chunk_of, day_in_month, month_from_sheet, to_numeric, year_from_name
from millrace.operators.chunks import CHUNK, carry
from millrace.operators.select import drop_total_rows, match_columns, valid_shift

SHEET = ["file", "sheet"]
ROWS_PER_PIECE = 10_000


def shift_time(date: Column, shift: Column) -> Column:
    """Timestamp of a shift: the date at the shift's hour."""
    hours = F.create_map(*[F.lit(v) for item in fixed.SHIFT_HOURS.items() for v in item])
    return F.timestamp_micros(F.unix_micros(date.cast("timestamp")) + F.try_element_at(hours, shift).cast("long") * F.lit(3_600_000_000))


def carried_day(rows: DataFrame, day_col: str = fixed.DAY_COLUMN) -> DataFrame:
    """``day``: the last numeric cell of the day column at or above the row, within its sheet."""
    numbered = rows.withColumn("__d", to_numeric(day_col).cast("int"))
    pieces = numbered.withColumn(CHUNK, chunk_of(F.col("row_no").cast("long"), ROWS_PER_PIECE))
    joined = carry(
        pieces, SHEET, {"__last": F.max_by("__d", F.when(F.col("__d").isNotNull(), F.col("row_no")))},
        before={"__above": lambda w: F.last("__last", ignorenulls=True).over(w)})
    up = W.partitionBy(*SHEET, CHUNK).orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)
    day = F.coalesce(F.last("__d", ignorenulls=True).over(up), F.col("__above"))
    return joined.withColumn("day", day).drop("__d", "__above", CHUNK)


def assemble_shift_report(
    rows: DataFrame, *, year: Column | None = None, day_col: str = fixed.DAY_COLUMN, shift_col: str = fixed.SHIFT_COLUMN,
) -> tuple[DataFrame, DataFrame]:
    """Dated shift rows and the rejected ones.

    Rows without a valid shift number (total rows, blanks) or above the first day cell are no shift rows and left out.
    A shift row whose year, month or day cannot be a date is rejected with its reason, not guessed.
    """
    measures = match_columns([c for c in rows.columns if c not in (*SHEET, "row_no", day_col, shift_col)])
    dated = carried_day(rows, day_col)
    dated = dated.withColumn("shift", valid_shift(F.col(shift_col))).filter("shift is not null and day is not null")
    dated = dated.withColumn("__year", year if year is not None else year_from_name("file")).withColumn(
        "__month", month_from_sheet("sheet"))
    y, m, d = F.col("__year"), F.col("__month"), F.col("day")
    reason = F.when(y.isNull(), "unknown year").when(m.isNull(), "unknown month").when(
        ~F.coalesce(day_in_month(y, m, d), F.lit(False)), "no such day")
    checked = dated.withColumn("reject_reason", reason)
    good = checked.filter("reject_reason is null")
    date = F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    values = [
        (to_numeric(F.col(f"`{measures[name]}`")) if name in measures else F.lit(None).cast("double")).alias(name)
        for name, _ in fixed.SHIFT_HEADER_RULES]
    report = good.select(
        date.alias("date"), "shift", shift_time(date, F.col("shift")).alias("TimeStamp"), *values,
        F.col("sheet").alias("original_sheet"))
    return report, checked.filter("reject_reason is not null").select(*SHEET, "row_no", "day", "shift", "reject_reason")


def assemble_shift_ordinal(
    rows: DataFrame, *, year: Column | None = None, as_of: str | None = None, shift_col: str = fixed.SHIFT_COLUMN,
    numeric_names: bool = True,
) -> DataFrame:
    """Shift rows dated by order: the n-th row of each shift belongs to the n-th day of the sheet's month.

    Days covered: the smallest of the three shifts' row counts, the month's length, and, for the month of ``as_of``,
    its day.
    """
    kept = drop_total_rows(rows, shift_col).withColumn("shift", valid_shift(F.col(shift_col))).filter("shift is not null")
    w = W.partitionBy(*SHEET, "shift").orderBy("row_no")  # a sheet is one month of one file
    numbered = kept.withColumn("__nth", F.row_number().over(w))
    hits = [F.count_if(F.col("shift") == s) for s in fixed.SHIFT_HOURS]
    cover = kept.groupBy(*SHEET).agg(F.least(*hits).alias("__full"))
    both = numbered.join(cover, SHEET).withColumn("__year", year if year is not None else year_from_name("file")).withColumn(
        "__month", month_from_sheet("sheet", numeric_names))
    y, m, n = F.col("__year"), F.col("__month"), F.col("__nth")
    fits = (n <= F.col("__full")) & F.coalesce(day_in_month(y, m, n), F.lit(False))
    if as_of is not None:
        today = F.lit(as_of).cast("date")
        fits = fits & ((y != F.year(today)) | (m != F.month(today)) | (n <= F.dayofmonth(today)))
    date = F.try_make_timestamp(y, m, n, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    dated = both.filter(fits).withColumn("__date", date)
    return dated.select(
        *[F.col(f"`{c}`") for c in rows.columns if c != "sheet"], shift_time(F.col("__date"), F.col("shift")).alias("TimeStamp"),
        F.date_format("__date", "dd.MM.yyyy").alias("date_text"), "shift", F.col("sheet").alias("OriginalSheet"))


def union_sheets(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
