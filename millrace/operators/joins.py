"""Joins along tags and time."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.functions.columns import duration_micros
from millrace.operators.chunks import (
    CHUNK, DEFAULT_CHUNK, carry, chunk_window, row_index, time_position, with_time_chunk,
)


def join_tag_dim(log: DataFrame, tag_dim: DataFrame, tag_col: str = "tag_id") -> DataFrame:
    """Attach (feature, mill) to log rows; a tag that serves several of them fans out.

    The dimension's size is measured by the optimizer (it broadcasts below its threshold); a large one falls back to
    a shuffle join with runtime skew splitting.
    """
    return log.join(tag_dim, tag_col, "inner")


def broadcast_global_feature(wide: DataFrame, plant: DataFrame, time_col: str) -> DataFrame:
    """Attach plant-wide series, one row per time, to every mill."""
    return wide.join(plant, time_col, "inner")


def align_features(
    df: DataFrame, row_cols: Sequence[str], feature_col: str, value_col: str, features: Sequence[str]
) -> DataFrame:
    """Rows (for example mill and minute) at which *all* features exist, one column per feature.

    One aggregate instead of a chain of joins; a feature counts as present when it has a row, even a NULL one.
    """
    cells = [F.max(F.when(F.col(feature_col) == f, F.col(value_col))).alias(f) for f in features]
    wide = df.filter(F.col(feature_col).isin(list(features))).groupBy(*row_cols).agg(
        F.count_distinct(feature_col).alias("__k"), *cells)
    return wide.filter(F.col("__k") == len(features)).drop("__k")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"{what} has duplicate {', '.join(keys)}")


def join_on_time(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = False) -> DataFrame:
    """Inner join on time keys. ``check`` makes duplicates and an empty intersection errors."""
    joined = left.join(right, list(keys), "inner")
    if check:
        assert_unique(left, keys, "left side")
        assert_unique(right, keys, "right side")
        if joined.isEmpty():
            raise ValueError("no common times")
    return joined


def join_identical_index(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails unless both sides have the same keys."""
    a = left.select(*keys, F.lit(1).alias("__l"))
    b = right.select(*keys, F.lit(1).alias("__r"))
    odd = a.join(b, list(keys), "full_outer").filter(F.col("__l").isNull() | F.col("__r").isNull())
    if not odd.isEmpty():
        raise ValueError("the two sides have different keys")
    return left.join(right, list(keys), "inner")


def asof_join(
    left: DataFrame, right: DataFrame, series_cols: Sequence[str], time_col: str, cols: Sequence[str], *,
    tolerance: str | None = None, right_time: str | None = None, chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Each left row takes the latest right row at or before it (values as they are, NULLs included).

    Both sides are stacked and the last right row is carried along time, so there is no range join. A right row at the
    same time counts; of several at one time the largest values win. ``right_time`` names an output column with the matched time.
    """
    rest = [c for c in left.columns if c not in (*series_cols, time_col)]
    stacked = left.select(
        *series_cols, time_col, F.struct(*rest, F.lit(True).alias("__is_left")).alias("__l"),
    ).unionByName(
        right.select(*series_cols, time_col, F.struct(F.col(time_col).alias("__t"), *cols).alias("__r")),
        allowMissingColumns=True)
    ordered = stacked.withColumn("__side", F.col("__l").isNotNull().cast("int"))
    chunked = with_time_chunk(ordered, time_col, chunk)
    joined = carry(
        chunked, series_cols,
        {"__last": F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct(time_col, "__r")))},
        before={"__carried": lambda w: F.last("__last", ignorenulls=True).over(w)})
    up = chunk_window(series_cols, [time_col, "__side", "__r"]).rowsBetween(W.unboundedPreceding, 0)
    found = joined.withColumn("__hit", F.coalesce(F.last("__r", ignorenulls=True).over(up), F.col("__carried")))
    hit = F.col("__hit")
    if tolerance is not None:
        near = time_position(time_col) - F.unix_micros(F.col("__hit.__t")) <= F.lit(duration_micros(tolerance))
        hit = F.when(near, hit)
    matched = found.filter(F.col("__side") == 1).withColumn("__hit", hit)
    out = [F.col(f"__hit.{c}").alias(c) for c in cols]
    if right_time:
        out.append(F.col("__hit.__t").alias(right_time))
    return matched.select(*series_cols, time_col, *[F.col(f"__l.{c}").alias(c) for c in rest], *out)


def semi_new_rows(df: DataFrame, stored_max: DataFrame, series_cols: Sequence[str], time_col: str, max_col: str = "max_ts") -> DataFrame:
    """Rows newer than what is stored for their series, or of a series that is not stored yet."""
    limits = stored_max.select(*series_cols, F.col(max_col).alias("__max"))
    if series_cols:
        joined = df.join(limits, list(series_cols), "left")
        return joined.filter(F.col("__max").isNull() | (F.col(time_col) > F.col("__max"))).drop("__max")
    top = limits.agg(F.max("__max")).first()[0]
    return df if top is None else df.filter(F.col(time_col) > F.lit(top))


def late_rows(df: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored, however old they are."""
    return df.join(stored.select(*keys), list(keys), "left_anti")


def attach_labels(
    df: DataFrame, segments: DataFrame, series_cols: Sequence[str], time_col: str, *, start_col: str = "start_time",
    label_col: str = "regime", chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Label of the segment that covers each row, from segments given by their first time."""
    starts = segments.select(*series_cols, F.col(start_col).alias(time_col), F.col(label_col).alias(label_col))
    return asof_join(df, starts, series_cols, time_col, [label_col], chunk=chunk)


def label_lookup(df: DataFrame, labels: DataFrame, id_col: str, text_col: str = "label") -> DataFrame:
    """Left join to a label table; an unknown identifier is its own label."""
    named = labels.select(F.col("id").alias(id_col), F.concat("name", F.lit(" ("), "unit", F.lit(")")).alias("__text"))
    return df.join(named, id_col, "left").withColumn(
        text_col, F.coalesce("__text", F.col(id_col).cast("string"))).drop("__text")


def parameter_labels(spark) -> DataFrame:
    return spark.createDataFrame(fixed.PARAMETERS, "id string, name string, unit string")


def tag_dimension(spark, features: Sequence[str] | None = None, mills: Sequence[str] | None = None) -> DataFrame:
    """Table (feature, mill, tag_id); its size is fixed by the plant."""
    rows = [
        (feature, mill, tag)
        for feature, tags in fixed.FEATURE_TAGS.items() if features is None or feature in features
        for mill, tag in zip(fixed.MILLS, tags) if mills is None or mill in mills
    ]
    return spark.createDataFrame(rows, "feature string, mill string, tag_id int")


def pair_features(features: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(features, 2))
