"""Registration, inputs derived from the given tables, and output conventions of the catalogue."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import clean_double, floor_time, unordered_mean
from millrace.session import ensure_checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TYPES = ["click", "error", "purchase", "signup", "view"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None, name: str | None = None, digits: int = 6):
    """Register a query under its function name; doubles are rounded to ``digits`` and times leave as wall-clock."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return tidy(fn(spark, sf_dir), digits)

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    def settled(value):
        # a hair above a rounding border on both sides, and no negative zero
        return F.round(value + F.lit(1e-10), digits) + F.lit(0.0)

    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = settled(c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DoubleType):
            c = F.transform(c, settled)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def R(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round(({expr}) + 1e-10, {digits}) + 0.0)"


def RN(expr: str, digits: int = 6) -> str:
    """Rounding with NaN as NULL."""
    return R(f"CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END", digits)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.withColumns({"ts": F.col("ts").cast("timestamp"), "value": clean_double("value")})


def hourly_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series per user: mean per hour, hours without events absent."""
    e = events(spark, sf_dir)
    return e.groupBy("user_id", floor_time("ts", "1 hour").alias("ts")).agg(unordered_mean("value").alias("value"))


def hourly_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.groupBy("event_type", floor_time("ts", "1 hour").alias("ts")).agg(F.avg("value").alias("value"))


def wide(spark: SparkSession, sf_dir: str, step: str = "1 hour") -> DataFrame:
    """One column per event type: mean per bucket, NULL where a type has no event."""
    e = events(spark, sf_dir)
    return e.groupBy(floor_time("ts", step).alias("ts")).pivot("event_type", TYPES).agg(F.avg("value"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder for round trips through files."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


# --- the same inputs as SQL common table expressions ---------------------------------------------------------------

HU = "hu AS (SELECT user_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2)"
HT = "ht AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2)"


def wide_sql(trunc: str = "date_trunc('hour', ts)", name: str = "w") -> str:
    cells = ", ".join(f"avg(value) FILTER (event_type = '{t}') AS {t}" for t in TYPES)
    return f"{name} AS (SELECT {trunc} AS ts, {cells} FROM events GROUP BY 1)"


W = wide_sql()

# hours from the first to the last of each user, missing hours as NULL
GU = HU + """, gu AS (
  SELECT g.user_id, g.ts, hu.value,
         row_number() OVER (PARTITION BY g.user_id ORDER BY g.ts) - 1 AS i
  FROM (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hu GROUP BY 1) g
  LEFT JOIN hu ON hu.user_id = g.user_id AND hu.ts = g.ts)"""

# the same grid by user, gaps filled from both sides
FU = GU + """, fu AS (
  SELECT user_id, ts, i, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts),
         first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
  FROM gu)"""
