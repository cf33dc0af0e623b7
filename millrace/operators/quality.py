"""Profiles and data quality. One aggregate pass each, results a few rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.quantiles import exact_quantiles
from millrace.operators.select import numeric_columns


def per_column(df: DataFrame, cols: Sequence[str], measures: dict[str, callable], name: str = "column") -> DataFrame:
    """One row per column from a single aggregate over all of them."""
    row = F.struct(*[F.struct(F.lit(c).alias(name), *[m(F.col(c)).alias(k) for k, m in measures.items()]).alias(c) for c in cols])
    wide = df.agg(row.alias("__all"))
    return wide.select(F.explode(F.array(*[F.col(f"__all.{c}") for c in cols])).alias("__r")).select("__r.*")


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per numeric column."""
    names = list(cols) if cols is not None else numeric_columns(df)
    basics = per_column(df, names, {
        "n": F.count, "mean": F.avg, "std": F.stddev_samp,
        "min": lambda c: F.min(c.cast("double")), "max": lambda c: F.max(c.cast("double"))})
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    spread = quartiles.groupBy("column").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
    spread = spread.toDF("column", "q25", "q50", "q75")
    return basics.join(spread, "column").select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def missing_rates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    names = list(cols) if cols is not None else df.columns
    return per_column(df, names, {
        "n_rows": lambda c: F.count(F.lit(1)),
        "n_present": F.count,
        "n_missing": lambda c: F.count_if(c.isNull()),
        "missing_rate": lambda c: F.try_divide(F.count_if(c.isNull()), F.count(F.lit(1))),
    })


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def balance_check(df: DataFrame, *cols: str) -> DataFrame:
    """Smallest and largest group, and whether they are equal."""
    counts = value_counts(df, *cols)
    return counts.agg(
        F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("min_n"), F.max("n").alias("max_n"),
        (F.min("n") == F.max("n")).alias("balanced"))


def time_coverage(df: DataFrame, time_col: str, approximate: bool = False) -> DataFrame:
    day = F.to_date(time_col)
    days = F.approx_count_distinct(day) if approximate else F.count_distinct(day)
    return df.agg(F.min(time_col).alias("first_ts"), F.max(time_col).alias("last_ts"), days.alias("n_days"))


def removed_rows_report(df: DataFrame, keep: Column) -> DataFrame:
    """Rows before and after a predicate, without running it twice."""
    before, after = F.count(F.lit(1)), F.count_if(F.coalesce(keep, F.lit(False)))
    return df.agg(
        before.alias("rows_before"), after.alias("rows_after"), (before - after).alias("rows_removed"),
        F.try_divide(before - after, before).alias("removed_rate"))


def load_report(log: DataFrame, tag_dim: DataFrame, tag_col: str = "tag_id", time_col: str = "ts") -> DataFrame:
    """Per tag of the dimension: rows, distinct times, duplicates, time range; tags without data appear with zero rows."""
    # per (tag, time) first: duplicates collapse before they meet, so a busy tag is spread over its times
    slots = log.groupBy(tag_col, time_col).agg(F.count(F.lit(1)).alias("__n"))
    per_tag = slots.groupBy(tag_col).agg(
        F.sum("__n").alias("__rows"), F.count(F.lit(1)).alias("__times"),
        F.min(time_col).alias("first_ts"), F.max(time_col).alias("last_ts"))
    zero = F.lit(0).cast("long")
    rows, times = F.coalesce("__rows", zero), F.coalesce("__times", zero)
    return tag_dim.join(per_tag, tag_col, "left").select(
        *tag_dim.columns, rows.alias("n_rows"), (rows - times).alias("n_duplicates"), "first_ts", "last_ts",
        (rows == 0).alias("delivered_nothing"))


def missing_tags(log: DataFrame, tag_dim: DataFrame, tag_col: str = "tag_id") -> DataFrame:
    return tag_dim.join(log.select(tag_col), tag_col, "left_anti")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over the column's range, empty bins included; the last bin is closed."""
    low, high = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n bigint")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    number = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = df.filter(F.col(col).isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("__n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("upper"), F.coalesce("__n", F.lit(0)).cast("long").alias("n"))


def trial_stats(df: DataFrame, value_col: str = "value") -> DataFrame:
    v = F.col(value_col)
    return df.agg(
        F.count(v).alias("n_trials"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
