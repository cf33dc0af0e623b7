"""Deduplication, top-k and repeatable sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def dedup_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the last by ``order``. An aggregate with map-side combine: a hot key shuffles few rows."""
    return _one_per_key(df, keys, order, F.max_by)


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _one_per_key(df, keys, order, F.min_by)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return dedup_keep_first(df, keys, order)


def sort_rows(df: DataFrame, *order: str | Column) -> DataFrame:
    return df.orderBy(*order)


def top_k(df: DataFrame, k: int, order: Sequence[str | Column], by: Sequence[str] = (), salts: int = 32) -> DataFrame:
    """First ``k`` rows by ``order``, overall or per group.

    Per group the ranking runs twice: inside salted slices of the group, then over at most ``k * salts`` survivors,
    so a hot group never meets in one task.
    """
    if not by:
        return df.orderBy(*order).limit(k)
    # `k` earliest of a group are among the `k` earliest of their slice
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    ranked = df.withColumn("__salt", salt).withColumn(
        "__r", F.row_number().over(W.partitionBy(*by, "__salt").orderBy(*order)))
    survivors = ranked.filter(F.col("__r") <= k).drop("__salt", "__r")
    return survivors.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(
        F.col("__r") <= k).drop("__r")


def sample_ordered(df: DataFrame, n: int, key_cols: Sequence[str], time_col: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement in time order; repeatable, because rows are drawn by a seeded hash of the key."""
    draw = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed))), 256)
    return (
        df.withColumn("__draw", draw).orderBy("__draw", *key_cols).limit(n).drop("__draw").orderBy(time_col, *key_cols)
    )
