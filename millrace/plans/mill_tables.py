"""From the tag log to aligned one-minute tables, all features and mills in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.operators.chunks import CHUNK, DEFAULT_CHUNK
from millrace.operators.grid import chunk_first, fill_gaps, resample_mean, resample_median, shift_time
from millrace.operators.joins import join_tag_dim, semi_new_rows
from millrace.operators.select import filter_bounds, filter_time_range, select_existing
from millrace.session import kept_table
from millrace.sources.sinks import MONTH, append_marks, path_has_data, stored_limits, with_month

TIME_SHIFT = "2 hours"
OVERLAP = "6 hours"


def compose_features(
    log: DataFrame, tag_dim: DataFrame, mills: Sequence[str], *, step: str = "1 minute", shift: str = TIME_SHIFT,
    dedup_keys: Sequence[str] = ("tag_id", "ts"), leading: str = "bfill", chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Rows (feature, ts, one column per mill) on the minute grid.

    ``log`` has ts, tag_id, value and optionally ``src_priority`` (smaller wins where sources overlap). Per feature and
    source: last sample per tag and time, values held between samples, minute means with empty minutes; then sources
    are merged per minute, moved by the source's clock offset, and filled.
    ``dedup_keys=("ts",)`` keeps a single sample per time of a feature, whatever its tag.
    """
    if "src_priority" not in log.columns:
        log = log.withColumn("src_priority", F.lit(0))
    if "seq" not in log.columns:
        log = log.withColumn("seq", F.lit(0).cast("long"))
    tagged = join_tag_dim(log, tag_dim).filter(F.col("mill").isin(list(mills)))
    if tuple(dedup_keys) == ("ts",):
        winner = F.max(F.struct("seq", "tag_id")).alias("__win")
        per_time = tagged.groupBy("feature", "src_priority", "ts").agg(winner)
        tagged = tagged.join(per_time, ["feature", "src_priority", "ts"]).filter(
            (F.col("tag_id") == F.col("__win.tag_id")) & (F.col("seq") == F.col("__win.seq")))
    # one shuffle of the log: deduplication with pivot, holding and averaging all stay within (source, chunk)
    source = ["feature", "src_priority"]
    placed = chunk_first(tagged.select(*source, "mill", "ts", "seq", "value"), source, "ts", step, chunk)
    wide = placed.groupBy(*source, CHUNK, "ts").pivot("mill", list(mills)).agg(F.max_by("value", F.struct("seq", "value")))
    held = fill_gaps(wide, source, "ts", list(mills), "both", leading=leading, chunk=chunk)
    minutes = resample_mean(held, source, "ts", list(mills), step, chunk=chunk, span_of=tagged)
    merged = minutes.groupBy("feature", "ts").agg(F.min_by(F.struct(*mills), "src_priority").alias("__m"))
    moved = shift_time(merged.select("feature", "ts", *[F.col(f"__m.{m}").alias(m) for m in mills]), "ts", shift)
    return fill_gaps(moved, ["feature"], "ts", list(mills), "both", leading=leading, step=step, chunk=chunk)


def align_mills(composed: DataFrame, mills: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Rows (mill, ts, features): minutes at which every feature the mill delivers has a value.

    The minutes are written once, so that counting what a mill delivers does not compose the log a second time.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("mill"), F.col(m).alias("value")) for m in mills]))
    long = composed.select("feature", "ts", cells.alias("__c")).select("feature", "ts", "__c.*").filter("value is not null")
    wide = kept_table(long.groupBy("mill", "ts").agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features]))
    # a feature takes part for a mill when it delivered anything at all: a row per mill
    delivered = wide.groupBy("mill").agg(*[F.max(F.col(f).isNotNull()).alias(f"__d_{f}") for f in features])
    there = [F.col(f).isNotNull() | ~F.col(f"__d_{f}") for f in features]
    return wide.join(delivered, "mill").filter(reduce(lambda x, y: x & y, there)).select("mill", "ts", *features)


def build_mill_table(
    log: DataFrame, tag_dim: DataFrame, *, mills: Sequence[str] = tuple(fixed.MILLS),
    features: Sequence[str] = tuple(fixed.FEATURE_TAGS), **options,
) -> DataFrame:
    dim = tag_dim.filter(F.col("feature").isin(list(features)))
    return align_mills(compose_features(log, dim, mills, **options), mills, features)


def log_since(log: DataFrame, tag_dim: DataFrame, limits: Mapping[str, object], overlap: str) -> DataFrame:
    """Rows of the log that the mills in ``limits`` (mill to stored maximum) may need: per tag those since its mills' oldest maximum minus ``overlap``.

    A condition for each group of tags with one bound reaches the scan, so a mill that has stopped does not widen what is read for the tags of others.
    """
    dim = tag_dim.filter(F.col("mill").isin(list(limits))).select("mill", "tag_id").distinct().collect()  # tags times mills
    bounds: dict[int, object] = {}
    for row in dim:
        since = limits[row["mill"]] - pd.Timedelta(overlap).to_pytimedelta()
        bounds[row["tag_id"]] = min(since, bounds.get(row["tag_id"], since))
    wanted = F.lit(False)
    for since in sorted(set(bounds.values())):
        wanted = wanted | (F.col("tag_id").isin([t for t, own in bounds.items() if own == since]) & (F.col("ts") > F.lit(since)))
    return log.filter(wanted)


def new_mill_rows(
    log: DataFrame, tag_dim: DataFrame, stored: DataFrame | None, *, mills: Sequence[str], features: Sequence[str],
    overlap: str = OVERLAP, **options,
) -> DataFrame:
    """Rows to append: built from the log since each mill's stored maximum minus ``overlap``, newer than that maximum.

    ``stored`` is the table of maxima per mill (mill, max_ts) or None. The overlap must cover the clock offset and the
    longest gap that filling bridges; rows not newer than the maximum are discarded. Mills with one maximum are built together.
    """
    if stored is None:
        return build_mill_table(log, tag_dim, mills=mills, features=features, **options)
    known = {r["mill"]: r["max_ts"] for r in stored.filter(F.col("mill").isin(list(mills))).collect()}  # a row per mill asked for
    dim = tag_dim.filter(F.col("feature").isin(list(features)))
    new = [m for m in mills if m not in known]
    parts = []
    if known:
        recent = log_since(log, dim, known, overlap)
        parts.append(build_mill_table(recent, tag_dim, mills=[m for m in mills if m in known], features=features, **options))
    if new:  # mills without stored rows are built from the whole log, the others are not
        parts.append(build_mill_table(log, tag_dim, mills=new, features=features, **options))
    built = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return semi_new_rows(built, stored, ["mill"], "ts").select("mill", "ts", *features)


def incremental_load(log: DataFrame, tag_dim: DataFrame, path: str, *, mills: Sequence[str], features: Sequence[str], **options) -> None:
    """Bring the mill table at ``path`` up to date: full build when absent or empty, else append what is newer.

    The table is partitioned by mill and month, and each run notes the maxima of what it wrote, so a later run reads
    neither old months of the table nor, for a mill that goes on, what another one's pause would need.
    """
    spark = log.sparkSession
    there = path_has_data(spark, path)
    if there:
        by_month = MONTH in spark.read.parquet(path).columns
        fresh = new_mill_rows(log, tag_dim, stored_limits(spark, path, ["mill"], "ts"), mills=mills, features=features, **options)
    else:
        by_month = True
        fresh = build_mill_table(log, tag_dim, mills=mills, features=features, **{k: v for k, v in options.items() if k != "overlap"})
    fresh = kept_table(with_month(fresh, "ts") if by_month else fresh)
    fresh.write.mode("append" if there else "overwrite").partitionBy("mill", *([MONTH] if by_month else [])).parquet(path)
    append_marks(fresh, path, ["mill"], "ts")


def load_clean(
    df: DataFrame, time_col: str, columns: Sequence[str], *, series_cols: Sequence[str] = (), start=None, end=None,
    freq: str | None = "5 minutes", bounds=fixed.WIDE_BOUNDS,
) -> DataFrame:
    """Existing columns, time range, median per bucket, physical bounds."""
    present = [c for c in columns if c in df.columns]
    base = filter_time_range(select_existing(df, [*series_cols, time_col, *columns]), time_col, start, end)
    if freq:
        base = resample_median(base, series_cols, time_col, present, freq)
    return filter_bounds(base, bounds) if bounds else base
