"""Correlation, regression and moments from one-pass sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import adjusted_kurtosis, adjusted_skewness, floor_time, safe_corr, sum_of_squares
from millrace.operators.joins import pair_features
from millrace.operators.quality import per_column
from millrace.operators.quantiles import centred_ranks, exact_quantiles
from millrace.operators.select import numeric_columns


def _long(df: DataFrame, rows: Sequence[Sequence[Column]]) -> DataFrame:
    """One aggregate over ``df`` whose result columns are turned into rows."""
    wide = df.agg(F.array(*[F.struct(*r) for r in rows]).alias("__rows"))
    return wide.select(F.explode("__rows").alias("__r")).select("__r.*")


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every ordered pair (a, b), diagonal included, each over its complete pairs."""
    names = list(cols) if cols is not None else numeric_columns(df)
    half = [(a, b) for a, b in pair_features(names)] + [(a, a) for a in names]
    upper = _long(df, [[F.lit(a).alias("a"), F.lit(b).alias("b"), safe_corr(a, b).alias("corr")] for a, b in half])
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return upper.select(F.explode(both).alias("__p"), "corr").select("__p.a", "__p.b", "corr")


def target_corr(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    names = [c for c in (cols if cols is not None else numeric_columns(df)) if c != target]
    rows = [[F.lit(c).alias("feature"), safe_corr(c, target).alias("corr")] for c in names]
    return _long(df, rows).orderBy(F.col("corr").desc_nulls_last(), "feature")


def pair_regression(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """r, r squared, slope and intercept of ``target`` on each feature over complete pairs."""
    rows = []
    y = F.col(target)
    for c in cols:
        x = F.when(y.isNotNull(), F.col(c))
        yy = F.when(F.col(c).isNotNull(), y)
        slope = F.try_divide(F.covar_pop(x, yy), F.var_pop(x))
        rows.append([
            F.lit(c).alias("feature"), F.count(F.when(x.isNotNull(), yy)).alias("n"), safe_corr(x, yy).alias("r"),
            F.pow(safe_corr(x, yy), F.lit(2.0)).alias("r2"), slope.alias("slope"),
            (F.avg(yy) - slope * F.avg(x)).alias("intercept")])
    return _long(df, rows)


def windowed_corr(
    df: DataFrame, time_col: str, cols: Sequence[str], window: str = "8 hours", min_periods: int = 10,
    series_cols: Sequence[str] = (),
) -> DataFrame:
    """Correlations of all pairs per tumbling window; short windows and all-NULL rows are left out."""
    pairs = pair_features(cols)
    out = df.withColumn(time_col, floor_time(time_col, window)).groupBy(*series_cols, time_col).agg(
        F.count(F.lit(1)).alias("__n"), *[safe_corr(a, b).alias(f"corr_{a}_{b}") for a, b in pairs])
    return out.filter(F.col("__n") >= min_periods).drop("__n").dropna(
        how="all", subset=[f"corr_{a}_{b}" for a, b in pairs])


def regime_corr(
    df: DataFrame, target: str, cols: Sequence[str], method: str = "pearson", regime_cols: Sequence[str] = ("regime",)
) -> DataFrame:
    """Correlation of target and features inside each regime, plus its row count."""
    if method == "pearson":
        return df.groupBy(*regime_cols).agg(
            F.count(F.lit(1)).alias("n_samples"), *[safe_corr(target, c).alias(f"corr_{c}") for c in cols])
    if method != "spearman":
        raise ValueError("method must be 'pearson' or 'spearman'")
    return _rank_corr(df, target, cols, regime_cols)


def _rank_corr(df: DataFrame, target: str, cols: Sequence[str], regime_cols: Sequence[str]) -> DataFrame:
    """Ranks are taken over the complete pairs of each feature.

    A value of the target is counted once, for all features, and its ranks are joined to the rows, which are summed per value of a feature: what
    the correlation needs of a feature's rank is the sum of the target's ranks beside each value. So rows are shuffled by the target
    and then only sums per value, and a feature's ranks are never joined back.
    """
    number = range(len(cols))
    x, n, r = ([f"__{k}{i}" for i in number] for k in "xnr")
    group = F.struct(*regime_cols).alias("__g")  # a struct matches in joins where a regime is NULL
    rows = df.select(group, F.col(target).cast("double").alias("__y"), *[F.col(c).cast("double").alias(x[i]) for i, c in enumerate(cols)])
    rows = rows.filter(F.col("__y").isNotNull())
    targets = rows.groupBy("__g", "__y").agg(*[F.count(x[i]).alias(n[i]) for i in number])
    ranks = centred_ranks(targets, ["__g"], "__y", dict(zip(n, r))).drop(*n)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("__f"), F.col(x[i]).alias("__x"), F.col(r[i]).alias("__r")) for i in number])).alias("__c")
    long = rows.join(ranks, ["__y", "__g"]).select("__g", cells).select("__g", "__c.*").filter(F.col("__x").isNotNull())
    beside = long.groupBy("__g", "__f", "__x").agg(
        F.count(F.lit(1)).alias("__n"), F.sum("__r").alias("__sum"), F.sum(F.col("__r") * F.col("__r")).alias("__yy"))
    table = centred_ranks(beside, ["__g", "__f"], "__x", {"__n": "__own"})
    terms = {"xy": F.col("__own") * F.col("__sum"), "xx": F.col("__n") * F.col("__own") * F.col("__own"), "yy": F.col("__yy")}

    def total(i: int, k: str) -> Column:
        return F.sum(F.when(F.col("__f") == i, terms[k]))

    corr = table.groupBy("__g").agg(*[
        F.try_divide(total(i, "xy"), F.sqrt(total(i, "xx")) * F.sqrt(total(i, "yy"))).alias(f"corr_{c}") for i, c in enumerate(cols)])
    counts = df.groupBy(*regime_cols).agg(F.count(F.lit(1)).alias("n_samples")).withColumn("__g", group)
    return counts.join(corr, "__g", "left").drop("__g")


def segment_r2(df: DataFrame, value_col: str, regime_col: str = "regime", by: Sequence[str] = ()) -> DataFrame:
    """Share of the variance explained by regime means, not below 0; 0 for a constant target."""
    parts = df.groupBy(*by, regime_col).agg(
        F.count(value_col).alias("__n"), F.avg(value_col).alias("__m"), sum_of_squares(value_col).alias("__sse"))
    # total = within + between; the mean of all rows is the weighted mean of segment means
    mean = F.try_divide(F.sum(F.col("__n") * F.col("__m")), F.sum("__n")).alias("__mean")
    means = parts.groupBy(*by).agg(mean)
    parts = parts.join(means, list(by)) if by else parts.withColumn("__mean", F.lit(means.first()[0]).cast("double"))
    between = F.sum(F.col("__n") * F.pow(F.col("__m") - F.col("__mean"), F.lit(2.0)))
    within = F.coalesce(F.sum("__sse"), F.lit(0.0))
    sst = within + F.coalesce(between, F.lit(0.0))
    r2 = F.when(sst == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(within, sst)))
    return parts.groupBy(*by).agg(r2.alias("r2"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    return exact_quantiles(df, cols, probs)


def skew_kurt(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return per_column(df, cols, {"n": F.count, "skew": adjusted_skewness, "kurtosis": adjusted_kurtosis})
