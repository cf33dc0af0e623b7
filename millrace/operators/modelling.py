"""Regression on DataFrames with MLlib: features, splits, training, evaluation, persistence, scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from millrace import fixed_values as fixed
from millrace.functions.columns import adjusted_kurtosis, adjusted_skewness, sum_of_squares
from millrace.operators import boosting
from millrace.operators.chunks import DEFAULT_CHUNK, row_index
from millrace.operators.quality import per_column
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.select import filter_bounds_strict
from millrace.session import cut_lineage

PREDICTION = "prediction"
WEIGHT = "__weight"

# Training parameters.
BOOSTING = {"n_estimators": 300, "learning_rate": 0.05, "max_depth": 6, "subsample": 0.8, "colsample": 0.8, "early_stopping_rounds": 30}
METADATA_SCHEMA = (
    "features array<string>, target_col string, model_params map<string,string>, "
    "feature_importance struct<Feature: map<string,string>, Importance: map<string,double>>, "
    "training_history struct<best_iteration: int, best_score: double>, last_trained string"
)


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def prepare_features(
    df: DataFrame, features: Sequence[str], target: str | None = None, keep: Sequence[str] = (),
    limits: Mapping[str, tuple[float | None, float | None]] | None = fixed.TRAINING_LIMITS,
) -> DataFrame:
    """Complete rows of the wanted columns inside the strict limits. Limits apply to the input frame's columns."""
    wanted = [*features, *([target] if target else [])]
    require_columns(df, [*wanted, *keep])
    if limits:
        df = filter_bounds_strict(df, limits)
    return df.select(*dict.fromkeys([*keep, *wanted])).dropna(subset=wanted)


def split_chronological(
    df: DataFrame, time_col: str, test_size: float = 0.2, *, series_cols: Sequence[str] = (), tie_cols: Sequence[str] = (),
    chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Column ``is_train``: the first ``int(n * (1 - test_size))`` rows by time."""
    numbered = row_index(df, series_cols, time_col, tie_cols=tie_cols, name="__i", total="__n", chunk=chunk)
    cut = (F.col("__n") * F.lit(1.0 - test_size)).cast("long")
    return numbered.withColumn("is_train", F.col("__i") < cut).drop("__i", "__n")


def split_random(df: DataFrame, key_cols: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Column ``is_train`` from a seeded hash of the key: repeatable, and the same for a row in any job."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed)))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return df.withColumn("is_train", draw >= test_size)


@dataclass
class Scaling:
    """Mean and population deviation per column, a few numbers."""

    means: dict[str, float]
    deviations: dict[str, float]

    def columns(self, names: Sequence[str]) -> dict[str, Column]:
        return {c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.deviations[c]) for c in names}


def fit_scaling(df: DataFrame, cols: Sequence[str]) -> Scaling:
    row = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]).first()
    return Scaling({c: row[c]["m"] for c in cols}, {c: row[c]["s"] or 1.0 for c in cols})


def standardize(df: DataFrame, cols: Sequence[str], scaling: Scaling | None = None, *, fit_on: str = "train") -> tuple[DataFrame, Scaling]:
    """Scaled frame and the scaling, fitted on training rows when there is an ``is_train`` column."""
    if scaling is None:
        base = df.filter("is_train") if fit_on == "train" and "is_train" in df.columns else df
        scaling = fit_scaling(base, cols)
    return df.withColumns(scaling.columns(cols)), scaling


def scaling_stage(scaling: Scaling, cols: Sequence[str]) -> SQLTransformer:
    """The scaling as a pipeline stage, so that it is saved with the model."""
    scaled = ", ".join(
        f"(`{c}` - {scaling.means[c]!r}D) / {scaling.deviations[c]!r}D AS `__z_{c}`" for c in cols)
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


@dataclass
class FittedModel:
    """``best_iteration`` is the best round, from 0, and ``best_score`` the error of the watched rows there."""

    pipeline: PipelineModel
    features: list[str]
    target: str
    params: dict[str, Any] = field(default_factory=dict)
    best_score: float | None = None
    best_iteration: int | None = None

    @property
    def regressor(self):
        return self.pipeline.stages[-1]


def _fit(train: DataFrame, features: Sequence[str], target: str, regressor, params: dict[str, Any]) -> FittedModel:
    scaling = fit_scaling(train, features)
    stages: list[Transformer] = [
        scaling_stage(scaling, features),
        VectorAssembler(inputCols=[f"__z_{c}" for c in features], outputCol="__features", handleInvalid="error"),
    ]
    model = Pipeline(stages=[*stages, regressor.setFeaturesCol("__features").setLabelCol(target).setPredictionCol(PREDICTION)]).fit(train)
    return FittedModel(model, list(features), target, params)


def first_rounds(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The ensemble of the first ``rounds`` trees."""
    own = model._java_obj
    sc = SparkSession.active().sparkContext
    ml = sc._jvm.org.apache.spark.ml
    trees, weights = own.trees(), own.treeWeights()
    kept_trees = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, rounds)
    kept_weights = sc._gateway.new_array(sc._jvm.double, rounds)
    for i in range(rounds):
        kept_trees[i], kept_weights[i] = trees[i], weights[i]
    cut = ml.regression.GBTRegressionModel(own.uid(), kept_trees, kept_weights, own.numFeatures())
    own.copyValues(cut, ml.param.ParamMap.empty())
    return GBTRegressionModel(cut)


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """The round with the least error before ``patience`` rounds in a row brought none, and whether that happened."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def _boost(gbt: GBTRegressor, train: DataFrame, watched: DataFrame | None, rounds: int, patience: int) -> tuple[GBTRegressionModel, int | None, float | None]:
    """Fitted trees, the best round and its absolute error on the watched rows.

    Few features are few cells of bins, for which a round is one job. Otherwise MLlib fits. A run of fewer rounds has the first trees of a longer one, so twice the patience is tried first, and then twice as many rounds
    each time: at most twice the rounds of the whole are trained, and far fewer where the best round comes early.
    """
    found = boosting.boost(gbt, train, watched, rounds, lambda errors: best_round(errors, patience))
    if found:
        return found
    if watched is None:
        return gbt.setMaxIter(rounds).fit(train), None, None
    now = min(rounds, 2 * patience)
    while True:
        model = gbt.setMaxIter(now).fit(train)
        errors = model.evaluateEachIteration(watched, "absolute")
        best, settled = best_round(errors, patience)
        if settled or now == rounds:
            return first_rounds(model, best + 1), best, float(errors[best])
        now = min(rounds, 2 * now)


def weighted_rows(df: DataFrame, features: Sequence[str], target: str, slices: int | None = None) -> DataFrame:
    """Equal rows as one row with their number in ``__weight``; the features as they are, the target as double.

    With ``slices`` the rows of one combination of features are put together in up to that many, dealt by a hash of the target, under
    their mean target: all that a squared error sees of rows that no tree can tell apart. Rows that are all different stay as many.
    """
    rows = df.select(*features, F.col(target).cast("double").alias(target))
    if slices is None:
        return rows.groupBy(*features, target).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))
    dealt = rows.withColumn("__slice", F.pmod(F.xxhash64(target), F.lit(slices)))
    return dealt.groupBy(*features, "__slice").agg(F.avg(target).alias(target), F.count(F.lit(1)).cast("double").alias(WEIGHT))


def train_gbt(
    df: DataFrame, features: Sequence[str], target: str, *, n_estimators: int = BOOSTING["n_estimators"],
    learning_rate: float = BOOSTING["learning_rate"], max_depth: int = BOOSTING["max_depth"],
    subsample: float = BOOSTING["subsample"], colsample: float = BOOSTING["colsample"], absolute_error: bool = False,
    early_stop: bool = True, patience: int = BOOSTING["early_stopping_rounds"], seed: int = 42, rows_per_partition: int = 32_000,
    slices: int = 64,
) -> FittedModel:
    """Boosted trees. Rows with ``is_train`` false watch for early stopping; without the column all rows train.

    Training goes on until ``patience`` rounds in a row have not lowered the absolute error of the watched rows, and the model
    keeps its trees up to the best round. Columns are drawn per node.

    Each round is a few short jobs over the training rows, so rows that no round can tell apart are first put together with a weight:
    equal rows, or for the squared error rows of equal features, in up to ``slices`` that are drawn separately for a round's
    subsample. They are kept in partitions of about ``rows_per_partition``, each in a fixed order, as the draw goes by position. They are
    written once rather than persisted: every task of a round carries its lineage, which then ends at the files.
    """
    require_columns(df, [*features, target])
    split = "is_train" in df.columns
    train = df.filter("is_train") if split else df
    scaling = fit_scaling(train, features)
    prepared = PipelineModel(stages=[
        scaling_stage(scaling, features),
        VectorAssembler(inputCols=[f"__z_{c}" for c in features], outputCol="__features", handleInvalid="error")])

    def ready(rows: DataFrame) -> DataFrame:
        held = rows.persist()
        try:
            parts = max(1, -(-held.count() // rows_per_partition))
            keys = [c for c in held.columns if c != WEIGHT]
            dealt = held.repartition(parts, *keys).sortWithinPartitions(*keys)
            return cut_lineage(prepared.transform(dealt).select("__features", target, WEIGHT))
        finally:
            held.unpersist()

    gbt = GBTRegressor(
        stepSize=learning_rate, maxDepth=max_depth, subsamplingRate=subsample,
        featureSubsetStrategy=str(colsample) if colsample < 1 else "all", lossType="absolute" if absolute_error else "squared",
        seed=seed, featuresCol="__features", labelCol=target, weightCol=WEIGHT, predictionCol=PREDICTION)
    fitted_on = ready(weighted_rows(train, features, target, None if absolute_error else slices))
    watched = ready(weighted_rows(df.filter(~F.col("is_train")), features, target)) if split and early_stop else None
    model, best, score = _boost(gbt, fitted_on, watched, n_estimators, patience)
    params = {
        "n_estimators": n_estimators, "learning_rate": learning_rate, "max_depth": max_depth, "subsample": subsample,
        "colsample": colsample, "loss": "absolute" if absolute_error else "squared"}
    if watched is not None:
        params["early_stopping_rounds"] = patience
    return FittedModel(PipelineModel(stages=[*prepared.stages, model]), list(features), target, params, score, best)


def train_linear(df: DataFrame, features: Sequence[str], target: str) -> FittedModel:
    """Ordinary least squares on standardised features; the normal equations take one pass."""
    require_columns(df, [*features, target])
    train = df.filter("is_train") if "is_train" in df.columns else df
    return _fit(train, features, target, LinearRegression(solver="normal", standardization=False), {"method": "least squares"})


def linear_coefficients(spark: SparkSession, model: FittedModel) -> DataFrame:
    rows = [(f, float(c)) for f, c in zip(model.features, model.regressor.coefficients)]
    return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(F.abs(F.col("coefficient")).desc(), "feature")


def regression_metrics(df: DataFrame, actual: str, predicted: str = PREDICTION, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE and R² = 1 - SSE / SST in one aggregate."""
    both = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    e = F.col(actual) - F.col(predicted)
    mse = F.avg(e * e)
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), sum_of_squares(actual))).alias("r2"))


def feature_importance(spark: SparkSession, model: FittedModel) -> DataFrame:
    values = model.regressor.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(model.features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def predict_batch(model: FittedModel, df: DataFrame, defaults: Mapping[str, float] | None = None) -> DataFrame:
    """Score a batch or stream. A missing feature is an error unless a default is given for it.

    Boosted trees of few thresholds make few cells, which are scored once each for a batch; its rows look their cell up.
    """
    absent = [f for f in model.features if f not in df.columns]
    unknown = [f for f in absent if f not in (defaults or {})]
    if unknown:
        raise ValueError(f"missing features: {', '.join(unknown)}")
    complete = df.withColumns({f: F.lit(float(defaults[f])) for f in absent}) if absent else df
    helpers = [f"__z_{f}" for f in model.features]
    if isinstance(model.regressor, GBTRegressionModel) and not df.isStreaming and PREDICTION not in df.columns:
        scaled = PipelineModel(model.pipeline.stages[:-2]).transform(complete)
        scored = boosting.score_by_cells(model.regressor, scaled, [F.col(f"`{c}`") for c in helpers], PREDICTION)
        if scored is not None:
            return scored.drop(*helpers)
    return model.pipeline.transform(complete).drop(*helpers, "__features")


def feature_cells(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One row per combination of features: number ``__weight``, mean target, and the squares ``__within`` around that mean.

    A combination with a NULL target has a NULL mean.
    """
    y, n = F.col(target).cast("double"), F.count(F.lit(1)).cast("double")
    return df.groupBy(*features).agg(
        F.when(F.count(y) == n, F.avg(y)).alias(target), n.alias(WEIGHT), (F.var_pop(y) * n).alias("__within"))


def learning_curve(model: FittedModel, df: DataFrame, loss: str = "squared") -> list[float]:
    """Error after each boosting round; equal rows are evaluated once.

    The squared error of rows of equal features is that of their mean plus their squares around it, which no round changes, so there each
    combination of features is evaluated once.
    """
    ready = PipelineModel(model.pipeline.stages[:-1])
    if loss != "squared":
        return model.regressor.evaluateEachIteration(ready.transform(weighted_rows(df, model.features, model.target)), loss)
    cells = feature_cells(df, model.features, model.target).persist()
    try:
        same = cells.agg(F.sum("__within") / F.sum(WEIGHT)).first()[0]
        return [error + same for error in model.regressor.evaluateEachIteration(ready.transform(cells), loss)]
    finally:
        cells.unpersist()


def prediction_frame(scored: DataFrame, time_col: str, actual: str, keep: Sequence[str] = ()) -> DataFrame:
    return scored.select(
        *keep, time_col, F.col(actual).alias("actual"), F.col(PREDICTION).alias("predicted"),
        (F.col(actual) - F.col(PREDICTION)).alias("residual"))


def residual_stats(frame: DataFrame, residual: str = "residual") -> DataFrame:
    """Mean, population deviation, adjusted skewness and kurtosis in one aggregate."""
    return per_column(frame, [residual], {
        "n": F.count, "mean": F.avg, "std": F.stddev_pop, "skew": adjusted_skewness, "kurtosis": adjusted_kurtosis}).drop("column")


def range_bias(frame: DataFrame, actual: str = "actual", predicted: str = "predicted", direct_rows: int = 1_000_000) -> DataFrame:
    """Mean residual and metrics below the 33rd, between, and above the 67th percentile of the prediction."""
    q = {round(r["prob"], 2): r["value"] for r in exact_quantiles(frame, [predicted], [0.33, 0.67], direct_rows).collect()}
    p = F.col(predicted)
    band = F.when(p < q[0.33], "low").when(p > q[0.67], "high").otherwise("mid")
    banded = frame.filter(p.isNotNull()).withColumn("range", band).withColumn("__e", F.col(actual) - p)
    means = banded.groupBy("range").agg(F.avg("__e").alias("mean_residual"))
    return means.join(regression_metrics(banded, actual, predicted, by=["range"]), "range")


def model_name(target: str, mill: str) -> str:
    return f"boosted_{target}_{mill}"


def metadata_row(spark: SparkSession, model: FittedModel, trained_at: str) -> DataFrame:
    names, values = {}, {}
    if hasattr(model.regressor, "featureImportances"):
        ranked = sorted(zip(model.features, model.regressor.featureImportances.toArray()), key=lambda t: -t[1])
        names = {str(i): f for i, (f, _) in enumerate(ranked)}
        values = {str(i): float(v) for i, (_, v) in enumerate(ranked)}
    row = (model.features, model.target, {k: str(v) for k, v in model.params.items()}, (names, values),
           (model.best_iteration, model.best_score), trained_at)
    return spark.createDataFrame([row], METADATA_SCHEMA)


def save_model(model: FittedModel, folder: str, name: str, trained_at: str) -> None:
    """Pipeline (scaling included) and its metadata row next to each other."""
    spark = SparkSession.active()
    model.pipeline.write().overwrite().save(f"{folder}/{name}_model")
    metadata_row(spark, model, trained_at).coalesce(1).write.mode("overwrite").json(f"{folder}/{name}_metadata.json")


def load_model(folder: str, name: str) -> FittedModel:
    spark = SparkSession.active()
    row = spark.read.schema(METADATA_SCHEMA).json(f"{folder}/{name}_metadata.json").first()
    return FittedModel(PipelineModel.load(f"{folder}/{name}_model"), list(row["features"]), row["target_col"],
                       dict(row["model_params"]), row["training_history"]["best_score"], row["training_history"]["best_iteration"])


def train_per_mill(
    df: DataFrame, mills: Sequence[str], targets: Sequence[str], features: Sequence[str], time_col: str, *,
    mill_col: str = "mill", limits=None, at_once: int = 4, **options,
) -> dict[tuple[str, str], FittedModel]:
    """One distributed fit per (mill, target), ``at_once`` of them side by side; each reads only its mill's partition.

    A round of boosting is short jobs that leave most of a cluster idle, so fits share it: Spark runs jobs of several threads together.
    """
    def fit(mill: str, target: str) -> FittedModel:
        own = [f for f in features if f != target]
        rows = prepare_features(df.filter(F.col(mill_col) == mill), own, target, [time_col], limits)
        return train_gbt(cut_lineage(split_chronological(rows, time_col)), own, target, **options)

    wanted = [(mill, target) for mill in mills for target in targets]
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        fits = [pool.submit(inheritable_thread_target(df.sparkSession)(fit), *key) for key in wanted]
        return {key: done.result() for key, done in zip(wanted, fits, strict=True)}
