"""Training, persistence, lags and search on planted structure."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from millrace.operators import boosting
from millrace.operators import lags as L
from millrace.operators import modelling as M
from millrace.operators import search as O
from millrace.sources.tables import scan_model_registry

T0 = pd.Timestamp("2024-02-01")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 2000
    a, b = rng.uniform(0, 10, n), rng.uniform(-5, 5, n)
    y = 3 * a - b**2 + rng.normal(0, 0.3, n)
    pdf = pd.DataFrame({"ts": T0 + pd.to_timedelta(np.arange(n), unit="min"), "mill": np.where(np.arange(n) % 2, "m1", "m2"), "a": a, "b": b, "y": y})
    return spark.createDataFrame(pdf).repartition(4)


def test_split_is_by_time(data):
    split = M.split_chronological(data, "ts", 0.25, chunk="3 hours")
    row = split.groupBy("is_train").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).toPandas().set_index("is_train")
    assert row.loc[True, "n"] == 1500 and row.loc[True, "hi"] < row.loc[False, "lo"]


def test_boosting_learns_saves_and_scores(spark, data, tmp_path):
    split = M.split_chronological(data, "ts").cache()
    model = M.train_gbt(split, ["a", "b"], "y", n_estimators=40, max_depth=4, learning_rate=0.2)
    test = split.filter(~F.col("is_train"))
    row = M.regression_metrics(M.predict_batch(model, test), "y").first()
    assert row["r2"] > 0.9 and model.best_score == pytest.approx(row["mae"])
    assert {r["feature"] for r in M.feature_importance(spark, model).collect()} == {"a", "b"}
    curve = M.learning_curve(model, split.filter("is_train"))
    assert curve[-1] < curve[0]
    M.save_model(model, str(tmp_path), "boosted_y_m1", "2025-01-01T00:00:00")
    again = M.load_model(str(tmp_path), "boosted_y_m1")
    assert M.regression_metrics(M.predict_batch(again, test), "y").first()["mae"] == pytest.approx(row["mae"])
    registry = scan_model_registry(spark, str(tmp_path)).first()
    assert registry["features"] == ["a", "b"] and registry["files_complete"] and registry["training_history"]["best_score"] == pytest.approx(row["mae"])


@pytest.mark.parametrize("absolute", [False, True])
def test_copies_of_rows_weigh_and_change_no_tree(data, absolute):
    few = data.select(F.round("a").alias("a"), F.round("b").alias("b"), "y", F.lit(True).alias("is_train"))
    many = few.crossJoin(data.sparkSession.range(5)).drop("id")
    once, often = (M.train_gbt(rows, ["a", "b"], "y", n_estimators=8, max_depth=3, absolute_error=absolute, early_stop=False) for rows in (few, many))
    cells = few.select("a", "b").distinct()
    want = {(r["a"], r["b"]): r["prediction"] for r in M.predict_batch(once, cells).collect()}
    got = {(r["a"], r["b"]): r["prediction"] for r in M.predict_batch(often, cells).collect()}
    assert got == pytest.approx(want)
    assert M.learning_curve(often, many) == pytest.approx(M.learning_curve(once, few))


def test_equal_rows_are_held_once(data):
    few = data.select(F.round("a").alias("a"), F.round("b").alias("b"), "y")
    many = few.crossJoin(data.sparkSession.range(5)).drop("id")
    same = M.weighted_rows(many, ["a", "b"], "y")
    assert same.count() == few.distinct().count() and same.agg(F.sum(M.WEIGHT)).first()[0] == 10_000
    dealt = M.weighted_rows(many, ["a", "b"], "y", slices=4)
    assert dealt.count() <= 4 * few.select("a", "b").distinct().count()
    row = dealt.agg(F.sum(M.WEIGHT).alias("n"), F.sum(F.col("y") * F.col(M.WEIGHT)).alias("s")).first()
    assert row["n"] == 10_000 and row["s"] == pytest.approx(many.agg(F.sum("y")).first()[0])


def test_rounds_start_from_written_rows(data, monkeypatch):
    """The lineage that every task of a round carries ends at the written training rows."""
    seen, real = [], M._boost
    monkeypatch.setattr(M, "_boost", lambda gbt, train, *rest: seen.append(train) or real(gbt, train, *rest))
    M.train_gbt(data.withColumn("is_train", F.lit(True)), ["a", "b"], "y", n_estimators=2, max_depth=2, early_stop=False, rows_per_partition=500)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and "InMemory" not in plan and "Exchange" not in plan
    assert seen[0].rdd.getNumPartitions() == -(-seen[0].count() // 500) > 1


def test_learning_curve_looks_at_combinations_of_features(data, monkeypatch):
    rows = data.select(F.round("a").alias("a"), F.round("b").alias("b"), "y")
    model = M.train_gbt(rows, ["a", "b"], "y", n_estimators=5, max_depth=3, early_stop=False)
    ready = M.PipelineModel(model.pipeline.stages[:-1]).transform(rows.withColumn(M.WEIGHT, F.lit(1.0)))
    want = model.regressor.evaluateEachIteration(ready, "squared")
    seen, real = [], type(model.regressor).evaluateEachIteration

    def counted(self, dataset, loss):
        seen.append(dataset.count())
        return real(self, dataset, loss)

    monkeypatch.setattr(type(model.regressor), "evaluateEachIteration", counted)
    assert M.learning_curve(model, rows) == pytest.approx(want, rel=1e-12)
    assert seen == [rows.select("a", "b").distinct().count()] and seen[0] < rows.count()
    assert M.learning_curve(model, rows, "absolute") == pytest.approx(real(model.regressor, ready, "absolute"))


def boosted_rows(spark, n):
    rows = spark.range(0, n, 1, 3).select(
        (F.rand(1) - 0.5).alias("a"), (F.floor(F.rand(2) * 50) / 7 - 3).alias("b"), F.floor(F.rand(3) * 4 + 1).cast("double").alias(M.WEIGHT), F.randn(5).alias("e"))
    rows = rows.withColumn("y", F.col("a") * 30 + F.col("b") * F.col("b") + F.col("e"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="__features").transform(rows).select("__features", "y", M.WEIGHT, "a", "b").cache()


@pytest.mark.parametrize(("n", "loss"), [(3000, "squared"), (24_000, "squared"), (24_000, "absolute")])
def test_rounds_by_cells_give_the_trees_of_mllib(spark, monkeypatch, n, loss):
    """Also where bins come from a sample, and where samples of some rounds are taken ahead."""
    monkeypatch.setattr(boosting, "AHEAD", 4)
    rows = boosted_rows(spark, n)
    gbt = GBTRegressor(maxIter=7, stepSize=0.3, maxDepth=4, subsamplingRate=0.8, featureSubsetStrategy="0.8", lossType=loss, seed=42,
                       featuresCol="__features", labelCol="y", weightCol=M.WEIGHT, predictionCol="prediction")
    want = gbt.fit(rows)
    got, best, score = boosting.boost(gbt, rows.select("__features", "y", M.WEIGHT), None, 7, None)
    assert (best, score) == (None, None) and got.getNumTrees == 7 and got.totalNumNodes == want.totalNumNodes and list(got.treeWeights) == list(want.treeWeights)
    plain = lambda model: [x for x in model.toDebugString.split("\n") if "feature" in x]
    assert plain(got)[1:] == plain(want)[1:]
    np.testing.assert_allclose(got.featureImportances.toArray(), want.featureImportances.toArray())
    ours, theirs = ([r[0] for r in m.transform(rows).select("prediction").collect()] for m in (got, want))
    np.testing.assert_allclose(ours, theirs)
    assert got.extractParamMap().keys() == {got.getParam(p.name) for p in want.extractParamMap()}


def test_draws_are_those_of_spark(spark):
    for seed in (0, 43, -7, 2 ** 40):
        draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        assert boosting.draws(np.array([5, seed]), 600)[1].tolist() == [draw.nextDouble() for _ in range(600)]


@pytest.mark.parametrize("absolute", [False, True])
def test_each_round_is_trained_once(data, monkeypatch, absolute):
    """Rounds go on from those before, with and without early stop; MLlib fits where there are too many cells, with the same result."""
    fits, real = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, *rest: fits.append(self.getMaxIter()) or real(self, *rest))
    split = M.split_chronological(data, "ts").cache()
    options = {"n_estimators": 9, "max_depth": 3, "learning_rate": 0.3, "patience": 2, "absolute_error": absolute}
    model = M.train_gbt(split, ["a", "b"], "y", **options)
    assert not fits
    monkeypatch.setattr(boosting, "MOST_CELLS", 10)
    again = M.train_gbt(split, ["a", "b"], "y", **options)
    assert len(fits) > 1 and again.best_iteration == model.best_iteration and again.best_score == pytest.approx(model.best_score)


@pytest.mark.parametrize("odd", [None, float("nan"), float("inf")])
def test_labels_that_are_no_numbers_are_errors(data, odd):
    with pytest.raises(Exception, match="a label is NULL, NaN or infinite"):
        M.train_gbt(data.withColumn("y", F.when(F.col("a") < 5, F.col("y")).otherwise(F.lit(odd).cast("double"))), ["a", "b"], "y", n_estimators=2, absolute_error=True)


def test_cells_are_scored_instead_of_rows(data, monkeypatch):
    model = M.train_gbt(data, ["a", "b"], "y", n_estimators=12, max_depth=4, early_stop=False)
    points = boosting.split_points(model.regressor)
    rows = data.select("a", "b")
    want = model.pipeline.transform(rows).select("a", "b", "prediction")
    scored, real = [], type(model.regressor).transform
    monkeypatch.setattr(type(model.regressor), "transform", lambda self, df, *rest: scored.append(df.count()) or real(self, df, *rest))
    got = M.predict_batch(model, rows)
    assert scored == [np.prod([len(p) + 1 for p in points])] and got.columns == ["a", "b", "prediction"]
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == rows.count()
    with pytest.raises(Exception, match="null or NaN"):
        M.predict_batch(model, rows.withColumn("b", F.when(F.col("b") < 0, F.col("b")))).agg(F.sum("prediction")).collect()
    monkeypatch.setattr(boosting, "MOST_SCORED", 10)
    scored.clear()
    assert M.predict_batch(model, rows).exceptAll(want).count() == 0 and scored == [rows.count()]


def test_missing_features_are_errors(data):
    model = M.train_linear(data, ["a", "b"], "y")
    with pytest.raises(ValueError, match="missing features: b"):
        M.predict_batch(model, data.drop("b"))
    assert M.predict_batch(model, data.drop("b"), {"b": 0.0}).filter("prediction is null").count() == 0
    with pytest.raises(ValueError, match="missing columns: zz"):
        M.prepare_features(data, ["zz"], "y")


def test_limits_apply_to_the_input_frame(spark):
    df = spark.createDataFrame([(170.0, 1.0, 2.0), (100.0, 1.0, 2.0), (170.0, None, 2.0)], "Ore double, WaterMill double, PSI80 double")
    assert M.prepare_features(df, ["WaterMill"], "PSI80").count() == 1


def test_scaling_uses_training_rows(spark):
    df = spark.createDataFrame([(1.0, True), (3.0, True), (100.0, False)], "x double, is_train boolean")
    out, scaling = M.standardize(df, ["x"])
    assert scaling.means["x"] == 2.0 and scaling.deviations["x"] == 1.0
    assert sorted(r["x"] for r in out.collect()) == [-1.0, 1.0, 98.0]
    assert M.standardize(df, ["x"], fit_on="all")[1].means["x"] == pytest.approx(104 / 3)


def test_model_per_mill(data):
    models = M.train_per_mill(data, ["m1", "m2"], ["y"], ["a", "b"], "ts", n_estimators=3, max_depth=3)
    assert set(models) == {("m1", "y"), ("m2", "y")}


@pytest.mark.parametrize("step", [None, "1 minute"])
@pytest.mark.parametrize("planted", [12, -5, 0])
def test_planted_lag(spark, planted, step):
    rng = np.random.default_rng(4)
    n = 900
    x = rng.normal(0, 1, n)
    y = np.roll(x, planted) + rng.normal(0, 0.3, n)
    pdf = pd.DataFrame({"k": "s", "ts": T0 + pd.to_timedelta(np.arange(n), unit="min"), "x": x, "y": y})
    df = spark.createDataFrame(pdf).repartition(5)
    for rows in (40, 20_000):
        best = L.estimate_lag_ccf(df, ["k"], "ts", "y", ["x"], max_lag=30, step=step, rows_per_chunk=rows, chunk="2 hours").first()
        assert best["best_lag"] == planted and best["best_corr"] > 0.8
    aligned = L.align_by_best_lag(df, "ts", "y", ["x"], max_lag=30)
    assert aligned.count() == n - abs(planted)
    assert aligned.select(F.corr("x", "y")).first()[0] > 0.9


def test_a_lag_per_series(spark):
    rng = np.random.default_rng(14)
    parts, want = [], {}
    for k, planted, n in (("p", 3, 300), ("q", 9, 260), ("r", -4, 280)):
        x, z = rng.normal(0, 1, n), rng.normal(0, 1, n)
        y = np.roll(x, planted) + np.roll(z, -2) + rng.normal(0, 0.1, n)
        own = pd.DataFrame({"k": k, "ts": T0 + pd.to_timedelta(np.arange(n), unit="min"), "x": x, "z": z, "y": y, "note": np.arange(n)})
        parts.append(own)
        moved = own.assign(x=own["x"].shift(planted), z=own["z"].shift(-2))
        want[k] = moved.iloc[max(planted, 0):n - max(2, -planted)]
    df = spark.createDataFrame(pd.concat(parts)).repartition(6)
    out = L.align_by_best_lag(df, "ts", "y", ["x", "z"], series_cols=["k"], max_lag=15, chunk="40 minutes")
    assert out.columns == df.columns
    got = out.toPandas().sort_values(["k", "ts"])
    for k, own in want.items():
        mine = got[got["k"] == k]
        assert list(mine["note"]) == list(own["note"])
        np.testing.assert_allclose(mine[["x", "z", "y"]].to_numpy(), own[["x", "z", "y"]].to_numpy())
        alone = L.align_by_best_lag(df.filter(F.col("k") == k), "ts", "y", ["x", "z"], max_lag=15, chunk="40 minutes").toPandas().sort_values("ts")
        np.testing.assert_allclose(mine[["x", "z", "y"]].to_numpy(), alone[["x", "z", "y"]].to_numpy())


def test_ccf_with_gaps_matches_pandas(spark):
    rng = np.random.default_rng(9)
    n = 300
    pdf = pd.DataFrame({"ts": T0 + pd.to_timedelta(np.arange(n), unit="min"), "x": rng.normal(5, 1, n), "y": rng.normal(3, 2, n)})
    pdf.loc[rng.random(n) < 0.2, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = L.ccf_table(df, [], "ts", "y", ["x"], max_lag=10, detrend_rows=20, rows_per_chunk=25).toPandas().set_index("lag")["corr"].sort_index()
    s = pdf.dropna()
    xs, ys = (s[c] - s[c].rolling(20, min_periods=1).mean() for c in ("x", "y"))
    np.testing.assert_allclose(got.to_numpy(), [ys.corr(xs.shift(lag)) for lag in range(-10, 11)], rtol=1e-8)
    grid = L.ccf_table(df, [], "ts", "y", ["x"], max_lag=6, detrend_rows=None, step="1 minute", rows_per_chunk=50).toPandas().set_index("lag")["corr"].sort_index()
    full = pdf.assign(y=pdf["y"].where(pdf["x"].notna()))
    np.testing.assert_allclose(grid.to_numpy(), [full["y"].corr(full["x"].shift(lag)) for lag in range(-6, 7)], rtol=1e-8)


def test_search_directions_constraints_and_rounds(spark):
    def bowl(pool):
        return pool.withColumn("prediction", F.pow(F.col("p") - 3, 2) + F.pow(F.col("q") + 1, 2))

    bounds = {"p": (-10.0, 10.0), "q": (-10.0, 10.0)}
    low = O.search_setpoints(spark, bounds, bowl, 400, maximize=False, rounds=4)
    best = O.recommendations(low, ["p", "q"], 1, maximize=False).first()
    assert best["value"] < 0.05 and best["params"]["p"] == pytest.approx(3, abs=0.3)
    once = O.search_setpoints(spark, bounds, bowl, 400, constraints=["p + q < 0", F.col("p") > -5])
    assert once.filter("p + q >= 0 or p <= -5").count() == 0
    assert O.recommendations(once, ["p", "q"], 1).first()["value"] > 50
    history = O.search_history(low, maximize=False, block=64).toPandas().sort_values("trial_number")
    np.testing.assert_allclose(history["best_value"], history["value"].cummin())
    assert O.param_effects(low.limit(5), ["p", "q"]).count() == 0
    with pytest.raises(ValueError):
        O.default_bounds(["Shisti"])


def test_best_round_with_patience():
    assert M.best_round([5, 4, 3, 3, 3.5, 3.2, 1], 3) == (2, True)
    assert M.best_round([5, 4, 3, 3, 3.5, 1], 4) == (5, False)
    assert M.best_round([2.0], 1) == (0, False)
    assert M.best_round([float("nan"), 1.0], 5)[1] is False


@pytest.mark.parametrize(("rounds", "patience"), [(50, 4), (50, 30), (9, 30)])
def test_boosting_keeps_the_best_round_of_the_whole_curve(data, rounds, patience):
    split = M.split_chronological(data.filter("mill = 'm1'"), "ts").cache()
    settings = {"n_estimators": rounds, "learning_rate": 0.3, "max_depth": 6}
    model = M.train_gbt(split, ["a", "b"], "y", patience=patience, **settings)
    whole = M.train_gbt(split, ["a", "b"], "y", early_stop=False, **settings)
    assert whole.regressor.getNumTrees == rounds and whole.best_iteration is None
    watched = split.filter(~F.col("is_train"))
    curve = M.learning_curve(whole, watched, "absolute")
    best, _ = M.best_round(curve, patience)
    assert best > 1 and (model.best_iteration, model.regressor.getNumTrees) == (best, best + 1)
    assert model.best_score == pytest.approx(curve[best])
    assert M.regression_metrics(M.predict_batch(model, watched), "y").first()["mae"] == pytest.approx(curve[best])
    assert M.metadata_row(data.sparkSession, model, "now").first()["training_history"]["best_iteration"] == best


def test_models_side_by_side_equal_models_one_by_one(data):
    options = {"n_estimators": 12, "max_depth": 3, "learning_rate": 0.3, "patience": 3}
    together = M.train_per_mill(data, ["m1", "m2"], ["y", "a"], ["a", "b", "y"], "ts", at_once=4, **options)
    apart = M.train_per_mill(data, ["m1", "m2"], ["y", "a"], ["a", "b", "y"], "ts", at_once=1, **options)
    assert list(together) == list(apart) == [("m1", "y"), ("m1", "a"), ("m2", "y"), ("m2", "a")]
    for key, model in together.items():
        assert model.best_iteration == apart[key].best_iteration and model.best_score == pytest.approx(apart[key].best_score)
        assert model.features == [f for f in ("a", "b", "y") if f != key[1]]
