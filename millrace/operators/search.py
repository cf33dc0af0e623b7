"""Set-point search as a distributed job: candidates are generated, filtered, scored and ranked on the cluster."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.functions.columns import safe_corr
from millrace.session import cut_lineage

Bounds = Mapping[str, tuple[float, float]]
Scorer = Callable[[DataFrame], DataFrame]


def bounds_from_data(df: DataFrame, cols: Sequence[str], low: float = 0.95, high: float = 1.05) -> DataFrame:
    """Rows (feature, lower, upper): smallest value times ``low``, largest times ``high``."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.lo").alias("lower"), F.col(f"{c}.hi").alias("upper")) for c in cols]))
    stats = df.agg(*[F.struct((F.min(c) * low).alias("lo"), (F.max(c) * high).alias("hi")).alias(c) for c in cols])
    return stats.select(rows.alias("__r")).select("__r.*")


def bounds_dict(bounds: DataFrame) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (r["lower"], r["upper"]) for r in bounds.collect()}


def uniform_draw(trial: Column, name: str, seed: int) -> Column:
    """Number in [0, 1) that depends only on trial, parameter and seed."""
    key = F.concat_ws("|", trial.cast("string"), F.lit(name), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def candidates(spark: SparkSession, bounds: Bounds, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``trial_number`` and one column per parameter, spread evenly within the bounds."""
    trials = spark.range(n, numPartitions=partitions).withColumnRenamed("id", "trial_number")
    return trials.withColumns({
        p: F.lit(float(lo)) + uniform_draw(F.col("trial_number"), p, seed) * F.lit(float(hi) - float(lo)) for p, (lo, hi) in bounds.items()})


def constraint_filter(df: DataFrame, constraints: Sequence[str | Column]) -> DataFrame:
    """Candidates that satisfy every predicate (SQL text or column)."""
    for c in constraints:
        df = df.filter(c)
    return df


def _direction(maximize: bool, value: str = "value") -> list[Column]:
    return [F.col(value).desc_nulls_last() if maximize else F.col(value).asc_nulls_last(), F.col("trial_number").asc()]


def search_setpoints(
    spark: SparkSession, bounds: Bounds, scorer: Scorer, n: int = 150, *, maximize: bool = True,
    constraints: Sequence[str | Column] = (), rounds: int = 1, elite_share: float = 0.1, seed: int = 42,
    fixed_features: Mapping[str, float] | None = None, value_col: str = "prediction", partitions: int | None = None,
) -> DataFrame:
    """Score ``n`` candidates per round and return all trials (trial_number, value, parameters).

    After a round the bounds shrink to the range of the best share of trials. Candidates that break a constraint are
    dropped before scoring. Minimising really minimises.
    """
    current: Bounds = dict(bounds)
    trials: DataFrame | None = None
    for r in range(rounds):
        pool = candidates(spark, current, n, seed + r, partitions).withColumn("trial_number", F.col("trial_number") + r * n)
        pool = pool.withColumns({k: F.lit(float(v)) for k, v in (fixed_features or {}).items()})
        scored = scorer(constraint_filter(pool, constraints)).select("trial_number", F.col(value_col).alias("value"), *bounds)
        scored = cut_lineage(scored) if rounds > 1 else scored
        trials = scored if trials is None else trials.unionByName(scored)
        if r + 1 < rounds:
            elite = scored.orderBy(*_direction(maximize)).limit(max(2, int(n * elite_share)))
            row = elite.agg(*[F.struct(F.min(p).alias("lo"), F.max(p).alias("hi")).alias(p) for p in bounds]).first()
            if row[next(iter(bounds))]["lo"] is not None:
                current = {p: (row[p]["lo"], row[p]["hi"]) for p in bounds}
    return trials


def recommendations(trials: DataFrame, params: Sequence[str], k: int = 5, maximize: bool = True) -> DataFrame:
    """Best ``k`` trials with their parameters as a map."""
    pairs = [x for p in params for x in (F.lit(p), F.col(p))]
    return trials.orderBy(*_direction(maximize)).limit(k).select("trial_number", "value", F.create_map(*pairs).alias("params"))


def search_history(trials: DataFrame, maximize: bool = True, block: int = 10_000) -> DataFrame:
    """Best value so far by trial: inside blocks of trials, with the earlier blocks' best carried in."""
    best = F.max if maximize else F.min
    blocked = trials.withColumn("__b", F.floor(F.col("trial_number") / block).cast("long"))
    tops = blocked.groupBy("__b").agg(best("value").alias("__top"))
    earlier = tops.select("__b", best("__top").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    inside = best("value").over(W.partitionBy("__b").orderBy("trial_number").rowsBetween(W.unboundedPreceding, 0))
    pick = F.greatest if maximize else F.least
    return blocked.join(earlier, "__b").select("trial_number", "value", pick(inside, F.col("__before")).alias("best_value"))


def param_effects(trials: DataFrame, params: Sequence[str], min_trials: int = 10) -> DataFrame:
    """Strength of each parameter: absolute correlation with the value, given more than ``min_trials`` trials."""
    rows = F.array(*[F.struct(F.lit(p).alias("param"), F.abs(safe_corr(p, "value")).alias("effect")) for p in params])
    wide = trials.agg(F.count("value").alias("__n"), rows.alias("__rows"))
    return wide.filter(F.col("__n") > min_trials).select(F.explode("__rows").alias("__r")).select("__r.*").orderBy(
        F.col("effect").desc_nulls_last(), "param")


def trials_export(trials: DataFrame, params: Sequence[str], started=None, completed=None) -> DataFrame:
    """Trial table with ``param_`` columns; all trials of a job share its start and end."""
    stamp = [F.lit(t).cast("timestamp").alias(n) for t, n in ((started, "datetime_start"), (completed, "datetime_complete"))]
    return trials.select(F.col("trial_number").cast("int").alias("trial_number"), "value", *stamp,
                         *[F.col(p).cast("double").alias(f"param_{p}") for p in params])


def default_bounds(features: Sequence[str]) -> dict[str, tuple[float, float]]:
    missing = [f for f in features if f not in fixed.SETPOINT_BOUNDS]
    if missing:
        raise ValueError(f"no default bounds for {', '.join(missing)}")
    return {f: fixed.SETPOINT_BOUNDS[f] for f in features}
