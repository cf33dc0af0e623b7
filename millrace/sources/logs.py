"""Reading sensor logs and series tables. Filters are plain comparisons on bare columns, so they reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import clean_double
from millrace.operators.select import filter_time_range

LOG_SCHEMA = T.StructType([
    T.StructField("IndexTime", T.TimestampType()), T.StructField("LoggerTagID", T.IntegerType()),
    T.StructField("Value", T.DoubleType()),
])


def normalise_log(df: DataFrame, time_col: str = "IndexTime", tag_col: str = "LoggerTagID", value_col: str = "Value", extra: Sequence[str] = ()) -> DataFrame:
    """Columns ts, tag_id, value; NaN becomes NULL and wall-clock times become timestamps."""
    return df.select(F.col(time_col).cast("timestamp").alias("ts"), F.col(tag_col).alias("tag_id"), clean_double(value_col).alias("value"), *extra)


def scan_log(
    source: DataFrame, tags: Sequence | DataFrame | None = None, *, since=None, as_of=None, default_days: int = 7,
    whole: bool = False, time_col: str = "IndexTime", tag_col: str = "LoggerTagID", value_col: str = "Value",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Log rows of some tags: after ``since``, else the last ``default_days`` before ``as_of``, else all.

    The time filter is on the stored column before any cast. A list of tags becomes a pushed-down membership test;
    a tag table becomes a semi join.
    """
    df = source
    stored = dict(source.dtypes)[time_col]
    if since is not None:
        df = df.filter(F.col(time_col) > F.lit(since).cast(stored))
    elif not whole and as_of is not None:
        df = df.filter(F.col(time_col) >= (F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(default_days)} DAYS")).cast(stored))
    if isinstance(tags, DataFrame):
        df = df.join(tags.select(F.col(tags.columns[0]).alias(tag_col)), tag_col, "left_semi")
    elif tags is not None:
        df = df.filter(F.col(tag_col).isin(list(tags)))
    return normalise_log(df, time_col, tag_col, value_col, extra)


def scan_log_archives(parts: Sequence[DataFrame], **options) -> DataFrame:
    """Live log and archives as one frame; ``src_priority`` is the position in the list, the smaller the stronger."""
    tagged = [scan_log(p, **options).withColumn("src_priority", F.lit(k)) for k, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def scan_series_range(df: DataFrame, time_col: str, start=None, end=None, *, series: Mapping[str, object] | None = None) -> DataFrame:
    """One series (a partition of the table) within an inclusive time range."""
    for name, value in (series or {}).items():
        df = df.filter(F.col(name) == value)
    return filter_time_range(df, time_col, start, end)


def read_parquet(spark: SparkSession, path: str, time_cols: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in time_cols}) if time_cols else df


def read_jdbc(spark: SparkSession, table: str, options: Mapping[str, str], *, partition_column: str | None = None,
              lower=None, upper=None, partitions: int = 8) -> DataFrame:
    """A database table; connection options come from the caller. Give bounds to read it in parallel."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions))
    return reader.load()


def scan_csv_series(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
