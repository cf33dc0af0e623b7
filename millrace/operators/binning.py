"""Discretisation into right-closed bins. Edges are a few numbers per feature; the data is only projected."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import right_closed_bin
from millrace.operators.quantiles import exact_quantiles, order_statistics
from millrace.operators.select import numeric_columns

METHODS = ("quantile", "kmeans", "entropy", "equal_width")
BIN_INFO_SCHEMA = "feature string, method string, bins array<double>, bin_counts array<bigint>"

Edges = dict[str, list[float]]


def _ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in cols]).first()
    return {c: (row[c]["lo"], row[c]["hi"]) for c in cols if row[c]["lo"] is not None}


def bins_equal_width(df: DataFrame, cols: Sequence[str], n_bins: int) -> Edges:
    edges = {}
    for c, (low, high) in _ranges(df, cols).items():
        step = (high - low) / n_bins
        edges[c] = [low + k * step for k in range(n_bins)] + [high]
    return edges


def bins_quantile(df: DataFrame, cols: Sequence[str], n_bins: int, direct_rows: int = 1_000_000) -> Edges:
    """Edges at quantiles ``k/n``, equal edges merged; a constant column falls back to equal width."""
    rows = exact_quantiles(df, cols, [k / n_bins for k in range(n_bins + 1)], direct_rows).collect()
    edges: Edges = {}
    for r in rows:
        if r["value"] is not None:
            edges.setdefault(r["column"], []).append(r["value"])
    edges = {c: sorted(set(v)) for c, v in edges.items()}
    flat = [c for c, v in edges.items() if len(v) < 2]
    return {**edges, **(bins_equal_width(df, flat, n_bins) if flat else {})}


def _nearest(c: str, centres: Sequence[float], span: tuple[float, float]) -> Column:
    return right_closed_bin(c, [span[0], *[(a + b) / 2 for a, b in zip(centres, centres[1:])], span[1]])


def bins_kmeans(
    df: DataFrame, cols: Sequence[str], n_bins: int, rounds: int = 100, tolerance: float = 1e-4, direct_rows: int = 1_000_000,
) -> Edges:
    """One-dimensional k-means: edges midway between sorted centres.

    Lloyd rounds from quantile starts, all features in one aggregate per round, until the squared moves of a feature's
    centres are below ``tolerance`` of its variance; a centre that loses its rows stays. Features that have not settled after ``rounds`` are named in a warning.
    Features with fewer distinct values than bins take quantile bins.
    """
    distinct = df.agg(*[F.count_distinct(c).alias(c) for c in cols]).first()
    able = [c for c in cols if distinct[c] >= n_bins]
    rest = [c for c in cols if c not in able]
    starts = exact_quantiles(df, able, [(k + 0.5) / n_bins for k in range(n_bins)], direct_rows).collect() if able else []
    centres: Edges = {}
    for r in starts:
        centres.setdefault(r["column"], []).append(r["value"])
    ranges = _ranges(df, able) if able else {}
    for c, values in centres.items():
        if len(set(values)) < len(values):  # tied quantiles: start from evenly spaced centres
            low, high = ranges[c]
            centres[c] = [low + (high - low) * (k + 0.5) / n_bins for k in range(n_bins)]
    spread = df.agg(*[F.var_pop(c).alias(c) for c in able]).first() if able else {}
    moving = set(centres)
    for _ in range(rounds):
        if not moving:
            break
        placed = df.select(*[x for c in sorted(moving) for x in (F.col(c), _nearest(c, centres[c], ranges[c]).alias(f"__b_{c}"))])
        row = placed.agg(*[
            F.avg(F.when(F.col(f"__b_{c}") == k, F.col(c))).alias(f"{c}__{k}") for c in sorted(moving) for k in range(n_bins)]).first()
        for c in sorted(moving):
            updated = sorted(row[f"{c}__{k}"] if row[f"{c}__{k}"] is not None else centres[c][k] for k in range(n_bins))
            drift = sum((a - b) ** 2 for a, b in zip(updated, centres[c]))
            centres[c] = updated
            if drift <= tolerance * spread[c]:
                moving.discard(c)
    if moving:
        warnings.warn(f"k-means has not settled after {rounds} rounds: {', '.join(sorted(moving))}", stacklevel=2)
    edges = {
        c: sorted({ranges[c][0], *[(a + b) / 2 for a, b in zip(v, v[1:])], ranges[c][1]}) for c, v in centres.items()}
    return {**edges, **(bins_quantile(df, rest, n_bins, direct_rows) if rest else {})}


def bins_supervised(df: DataFrame, cols: Sequence[str], n_bins: int, target: str, direct_rows: int = 1_000_000) -> Edges:
    """Equal frequency by row: edge ``i`` is the value at sorted position ``int(n * i / n_bins)``.

    The target only decides which rows count (both values present); it does not shape the edges.
    """
    usable = df.select(*[F.when(F.col(target).isNotNull(), F.col(c)).alias(c) for c in cols])
    row = usable.agg(*[F.struct(F.count(c).alias("n"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in cols]).first()
    ranks = {c: sorted({int(row[c]["n"] * i / n_bins) for i in range(1, n_bins)}) for c in cols if row[c]["n"]}
    values = order_statistics(usable, ranks, direct_rows)
    return {
        c: sorted({row[c]["lo"], *[values[c, r] for r in rs], row[c]["hi"]}) for c, rs in ranks.items()}


def bin_edges(df: DataFrame, cols: Sequence[str], n_bins: int, method: str = "quantile", target: str | None = None, direct_rows: int = 1_000_000) -> Edges:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "equal_width":
        return bins_equal_width(df, cols, n_bins)
    if method == "kmeans":
        return bins_kmeans(df, cols, n_bins, direct_rows=direct_rows)
    if method == "entropy" and target is not None:
        return bins_supervised(df, cols, n_bins, target, direct_rows)
    return bins_quantile(df, cols, n_bins, direct_rows)


def apply_bins(df: DataFrame, edges: Mapping[str, Sequence[float]], suffix: str = "") -> DataFrame:
    """Replace (or add, with a suffix) columns by their bin number; one projection for all features."""
    return df.withColumns({f"{c}{suffix}": right_closed_bin(c, e) for c, e in edges.items() if c in df.columns})


def smart_binning(
    df: DataFrame, n_bins: int, method: str = "quantile", target: str | None = None, cols: Sequence[str] | None = None,
    direct_rows: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """Binned frame and bin table (feature, method, bins, bin_counts) for the numeric columns except the target."""
    names = [c for c in (cols if cols is not None else numeric_columns(df)) if c != target]
    edges = bin_edges(df, names, n_bins, method, target, direct_rows)
    return apply_bins(df, edges), bin_info(df, edges, method)


def _per_bin(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """(feature, bin, n, m, sse) of the bins that hold rows: a value's bin is found once, and bins are summed with map-side combine."""
    placed = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), right_closed_bin(c, e).alias("bin")) for c, e in edges.items()])).alias("__p")
    rows = df.select(placed).select("__p.*").filter("bin is not null")
    return rows.groupBy("feature", "bin").agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("sse"))


def bin_info(df: DataFrame, edges: Mapping[str, Sequence[float]], method: str) -> DataFrame:
    found = _per_bin(df, edges).groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda b: b["n"]).alias("bin_counts"))
    named = df.sparkSession.createDataFrame([(c, method, [float(x) for x in e]) for c, e in edges.items()], "feature string, method string, bins array<double>")
    # a row per feature; bins without rows are not listed
    return named.join(F.broadcast(found), "feature", "left").withColumn("bin_counts", F.coalesce("bin_counts", F.array().cast("array<bigint>")))


def edges_from_info(info: DataFrame) -> Edges:
    """Edges per feature out of a bin table (one row per feature)."""
    return {r["feature"]: list(r["bins"]) for r in info.select("feature", "bins").collect()}


def binning_quality(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Bins in use, their sizes, balance, and how much of the feature its bin means retain."""
    # the correlation with the bin mean is sqrt(between / total), all of it from sums per bin
    per_bin = _per_bin(df, edges)
    mean = F.sum(F.col("n") * F.col("m")).over(W.partitionBy("feature")) / F.sum("n").over(W.partitionBy("feature"))
    spread = per_bin.withColumn("__between", F.col("n") * F.pow(F.col("m") - mean, F.lit(2.0)))
    within, between = F.sum("sse"), F.sum("__between")
    return spread.groupBy("feature").agg(
        F.count(F.lit(1)).alias("unique_bins"), F.min("n").alias("min_bin_size"), F.max("n").alias("max_bin_size"),
        (1 - F.try_divide(F.stddev_pop("n"), F.sum("n") / F.count(F.lit(1)))).alias("balance_score"),
        F.when(between > 0, F.sqrt(F.try_divide(between, within + between))).alias("information_retention"))


def compare_binnings(df: DataFrame, cols: Sequence[str], n_bins: int, target: str | None = None, methods: Sequence[str] = METHODS) -> DataFrame:
    """Quality of every feature under every method."""
    out = None
    for method in methods:
        part = binning_quality(df, bin_edges(df, cols, n_bins, method, target)).withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out
