"""Regression models, their evaluation, and set-point search."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import modelling as M
from millrace.operators import search as O
from millrace.plans.catalogue.base import R, events, lineitem, query, table, work_folder
from millrace.session import kept_table
from millrace.sources.tables import scan_model_registry as read_registry

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
FEATURES = ["l_quantity", "l_discount", "l_tax"]
TARGET = "l_extendedprice"


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_extendedprice FROM (SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{R(c, 3)} AS {c}" for c in ["l_quantity", "l_discount", TARGET]) + ", l_quantity AS q, l_discount AS di FROM lineitem WHERE l_quantity > 5 AND l_quantity < 45 AND l_discount < 0.09)", digits=3)
def prepare_features(spark, d):
    return M.prepare_features(lineitem(spark, d), ["l_quantity", "l_discount"], TARGET, ["l_orderkey", "l_linenumber"],
                              {"l_quantity": (5, 45), "l_discount": (None, 0.09)})


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 < (count(*) OVER () * 0.8)::BIGINT AS is_train FROM events")
def split_chronological(spark, d):
    return M.split_chronological(events(spark, d).select("event_id", "ts"), "ts", 0.2, tie_cols=["event_id"]).drop("ts")


@query("SELECT event_id, ('0x' || substr(md5(concat_ws('|', event_id::VARCHAR, '42')), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.2 AS is_train FROM events")
def split_random(spark, d):
    return M.split_random(events(spark, d).select("event_id"), ["event_id"], 0.2, 42)


_TRAIN = "l_shipdate < TIMESTAMP '1999-06-01'"


@query(f"WITH t AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_tax) AS tm, stddev_pop(l_tax) AS ts FROM lineitem WHERE {_TRAIN}) "
       f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {R('(l_quantity - m) / s')} AS l_quantity, {R('(l_tax - tm) / ts')} AS l_tax FROM lineitem, t")
def standardize(spark, d):
    """Fitted on earlier rows, applied to all."""
    li = lineitem(spark, d).withColumn("is_train", F.col("l_shipdate") < F.lit("1999-06-01").cast("timestamp_ntz"))
    scaled, _ = M.standardize(li, ["l_quantity", "l_tax"])
    return scaled.select(*KEYS, "l_quantity", "l_tax")


def _fixed_predictor(spark, d):
    """A plain linear predictor, so that every measure of it can be checked."""
    li = lineitem(spark, d)
    return li.withColumn("prediction", F.col("l_quantity") * 1500.0 + 900.0)


_PRED = "(l_quantity * 1500.0::DOUBLE + 900.0::DOUBLE)"
_E = f"(l_extendedprice - {_PRED})"
_SST = "sum((l_extendedprice - g) * (l_extendedprice - g))"


def _metrics(digits: int = 4) -> str:
    return (f"count(*) AS n, {R(f'avg(abs({_E}))', digits)} AS mae, {R(f'avg({_E} * {_E}) / 1e6', digits)} AS mse_m, {R(f'sqrt(avg({_E} * {_E}))', digits)} AS rmse, "
            f"{R(f'1 - sum({_E} * {_E}) / {_SST}', digits)} AS r2")


@query(f"SELECT {_metrics()} FROM (SELECT *, avg(l_extendedprice) OVER () AS g FROM lineitem)", digits=4)
def regression_metrics(spark, d):
    out = M.regression_metrics(_fixed_predictor(spark, d), TARGET)
    return out.withColumn("mse_m", F.col("mse") / 1e6).drop("mse")


@query(f"SELECT l_shipdate AS ts, l_orderkey, l_linenumber, {R(TARGET, 3)} AS actual, {R(_PRED, 3)} AS predicted, {R(_E, 3)} AS residual FROM lineitem", digits=3)
def prediction_frame(spark, d):
    scored = _fixed_predictor(spark, d).withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    return M.prediction_frame(scored, "ts", TARGET, ["l_orderkey", "l_linenumber"])


def _frame(spark, d):
    return M.prediction_frame(_fixed_predictor(spark, d), "l_shipdate", TARGET)


@query(f"SELECT count(*) AS n, {R(f'avg({_E})', 3)} AS mean, {R(f'stddev_pop({_E})', 3)} AS std, {R(f'skewness({_E})', 3)} AS skew, {R(f'kurtosis({_E})', 3)} AS kurtosis FROM lineitem", digits=3)
def residual_stats(spark, d):
    return M.residual_stats(_frame(spark, d))


@query(f"""WITH q AS (SELECT quantile_cont({_PRED}, 0.33) AS a, quantile_cont({_PRED}, 0.67) AS b FROM lineitem),
      r AS (SELECT *, CASE WHEN {_PRED} < a THEN 'low' WHEN {_PRED} > b THEN 'high' ELSE 'mid' END AS range FROM lineitem, q),
      g AS (SELECT *, avg(l_extendedprice) OVER (PARTITION BY range) AS g FROM r)
      SELECT range, {R(f'avg({_E})', 3)} AS mean_residual, {_metrics(3)} FROM g GROUP BY 1""", digits=3)
def range_bias(spark, d):
    out = M.range_bias(_frame(spark, d))
    return out.withColumn("mse_m", F.col("mse") / 1e6).drop("mse")


@query(f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem WHERE {_TRAIN})
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {R('i + s * l_quantity', 3)} AS prediction FROM lineitem, f""", digits=3)
def train_linear(spark, d):
    """Least squares on earlier rows, scores for all."""
    li = lineitem(spark, d).withColumn("is_train", F.col("l_shipdate") < F.lit("1999-06-01").cast("timestamp_ntz"))
    model = M.train_linear(li, ["l_quantity"], TARGET)
    return M.predict_batch(model, li).select(*KEYS, "prediction")


@query(f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)
      SELECT p_partkey, {R('i + s * 12', 3)} AS prediction FROM part, f""", digits=3)
def predict_batch(spark, d):
    """Rows without the feature are scored with a given default."""
    model = M.train_linear(lineitem(spark, d), ["l_quantity"], TARGET)
    return M.predict_batch(model, table(spark, d, "part").select("p_partkey"), {"l_quantity": 12.0}).select("p_partkey", "prediction")


@query(f"""WITH f AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)
      SELECT 'l_quantity' AS feature, {R('b * s', 2)} AS coefficient FROM f""", digits=2)
def linear_coefficients(spark, d):
    """Coefficient per deviation of the feature."""
    return M.linear_coefficients(spark, M.train_linear(lineitem(spark, d), ["l_quantity"], TARGET))


def _boosted(spark, d, **options):
    li = lineitem(spark, d).select(*KEYS, *FEATURES, TARGET, F.col("l_shipdate").cast("timestamp").alias("ts"))
    split = kept_table(M.split_chronological(li, "ts", 0.2, tie_cols=KEYS, chunk="30 days"))
    return M.train_gbt(split, FEATURES, TARGET, **options), split


@query(digits=4)
def train_gbt(spark, d):
    """Quality on the held-out last fifth."""
    model, split = _boosted(spark, d)
    return M.regression_metrics(M.predict_batch(model, split.filter(~F.col("is_train"))), TARGET)


@query(digits=4)
def train_gbt_absolute(spark, d):
    model, split = _boosted(spark, d, absolute_error=True)
    return M.regression_metrics(M.predict_batch(model, split.filter(~F.col("is_train"))), TARGET)


@query()
def feature_importance(spark, d):
    model, _ = _boosted(spark, d, early_stop=False)
    return M.feature_importance(spark, model)


@query(digits=2)
def learning_curve(spark, d):
    model, split = _boosted(spark, d, early_stop=False)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(
        M.learning_curve(model, split.filter("is_train")), M.learning_curve(model, split.filter(~F.col("is_train")))), start=1)]
    return spark.createDataFrame(rows, "round int, train_error double, test_error double")


@query(digits=3)
def save_and_load_model(spark, d):
    """Scores of a model that went through its files."""
    model, split = _boosted(spark, d, early_stop=False)
    folder = work_folder(spark, "models")
    M.save_model(model, folder, M.model_name("price", "mill8"), "2025-01-01T00:00:00")
    return M.predict_batch(M.load_model(folder, M.model_name("price", "mill8")), split).select(*KEYS, "prediction")


@query("SELECT 'boosted_price_' || m AS model_name, 'l_extendedprice' AS target_col, m = 'mill6' AS files_complete FROM (VALUES ('mill6'), ('mill7')) t(m)")
def scan_model_registry(spark, d):
    """Two trained models, one of them without its model files."""
    li = lineitem(spark, d)
    folder = work_folder(spark, "registry")
    model = M.train_linear(li, ["l_quantity"], TARGET)
    M.save_model(model, folder, M.model_name("price", "mill6"), "2025-01-01T00:00:00")
    M.metadata_row(spark, model, "2025-01-01T00:00:00").coalesce(1).write.json(f"{folder}/{M.model_name('price', 'mill7')}_metadata.json")
    return read_registry(spark, folder).select("model_name", "target_col", "files_complete")


@query(digits=4)
def train_per_mill(spark, d):
    """One model per order status of the mill column."""
    li = lineitem(spark, d).select(F.col("l_returnflag").alias("mill"), *FEATURES, TARGET, F.col("l_shipdate").cast("timestamp").alias("ts"))
    models = M.train_per_mill(li, ["A", "N", "R"], [TARGET], FEATURES, "ts", early_stop=False)
    out = None
    for (mill, target), model in models.items():
        part = M.regression_metrics(M.predict_batch(model, li.filter(F.col("mill") == mill)), target).withColumn("mill", F.lit(mill))
        out = part if out is None else out.unionByName(part)
    return out


# --- set-point search -----------------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'min({c}) * 0.95', 4)} AS lower, {R(f'max({c}) * 1.05', 4)} AS upper FROM lineitem" for c in ["l_quantity", "l_extendedprice", "l_tax"]), digits=4)
def bounds_from_data(spark, d):
    return O.bounds_from_data(lineitem(spark, d), ["l_quantity", "l_extendedprice", "l_tax"])


_PARAMS = ["l_quantity", "l_tax"]


def _scorer(spark, d):
    """Response surface through data moments: the nearer to the mean order, the better."""
    m = lineitem(spark, d).agg(*[F.avg(p).alias(p) for p in _PARAMS]).first()

    def score(pool):
        loss = F.lit(0.0)
        for p in _PARAMS:
            loss = loss + (F.col(p) - F.lit(m[p])) * (F.col(p) - F.lit(m[p]))
        return pool.withColumn("prediction", -loss)

    return score


def _draw(p: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(concat_ws('|', t::VARCHAR, '{p}', '{seed}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


_TRIALS = f"""m AS (SELECT avg(l_quantity) AS qm, avg(l_tax) AS tm, min(l_quantity) * 0.95 AS ql, max(l_quantity) * 1.05 AS qh, min(l_tax) * 0.95 AS tl, max(l_tax) * 1.05 AS th FROM lineitem),
  n AS (SELECT count(*) AS n FROM part),
  c AS (SELECT t AS trial_number, ql + {_draw('l_quantity')} * (qh - ql) AS l_quantity, tl + {_draw('l_tax')} * (th - tl) AS l_tax, qm, tm FROM (SELECT unnest(range(n)) AS t FROM n), m),
  trials AS (SELECT trial_number, l_quantity, l_tax, -(pow(l_quantity - qm, 2) + pow(l_tax - tm, 2)) AS value FROM c WHERE l_quantity + l_tax < 40)"""


def _search(spark, d, maximize=True, rounds=1):
    bounds = O.bounds_dict(O.bounds_from_data(lineitem(spark, d), _PARAMS))
    n = table(spark, d, "part").count()
    return O.search_setpoints(spark, bounds, _scorer(spark, d), n, maximize=maximize, rounds=rounds, constraints=["l_quantity + l_tax < 40"])


@query(f"WITH {_TRIALS} SELECT trial_number, {R('l_quantity')} AS l_quantity, {R('l_tax')} AS l_tax, {R('value', 4)} AS value FROM trials".replace(R("l_quantity"), R("l_quantity", 4)).replace(R("l_tax"), R("l_tax", 4)), digits=4)
def search_setpoints(spark, d):
    """As many candidates as there are parts, within the data's bounds and a constraint."""
    return _search(spark, d)


@query(f"WITH {_TRIALS} SELECT trial_number, {R('value', 4)} AS value, {R('l_quantity', 4)} AS l_quantity, {R('l_tax', 4)} AS l_tax FROM trials ORDER BY trials.value DESC, trial_number LIMIT 5", digits=4)
def recommendations(spark, d):
    best = O.recommendations(_search(spark, d), _PARAMS, 5)
    return best.select("trial_number", "value", *[F.col("params")[p].alias(p) for p in _PARAMS])


@query(f"WITH {_TRIALS} SELECT trial_number, {R('value', 4)} AS value FROM trials ORDER BY trials.value, trial_number LIMIT 3", digits=4)
def recommendations_minimum(spark, d):
    return O.recommendations(_search(spark, d, maximize=False), _PARAMS, 3, maximize=False).drop("params")


@query(f"WITH {_TRIALS} SELECT trial_number, {R('value', 4)} AS value, {R('max(value) OVER (ORDER BY trial_number)', 4)} AS best_value FROM trials", digits=4)
def search_history(spark, d):
    return O.search_history(_search(spark, d), block=100)


@query(f"WITH {_TRIALS} SELECT 'l_quantity' AS param, {R('abs(corr(l_quantity, value))')} AS effect FROM trials UNION ALL SELECT 'l_tax', {R('abs(corr(l_tax, value))')} FROM trials")
def param_effects(spark, d):
    return O.param_effects(_search(spark, d), _PARAMS)


@query(f"WITH {_TRIALS} SELECT trial_number::INT AS trial_number, {R('value', 4)} AS value, TIMESTAMP '2025-07-14 10:00:00' AS datetime_start, TIMESTAMP '2025-07-14 10:00:05' AS datetime_complete, "
       f"{R('l_quantity', 4)} AS param_l_quantity, {R('l_tax', 4)} AS param_l_tax FROM trials", digits=4)
def trials_export(spark, d):
    return O.trials_export(_search(spark, d), _PARAMS, "2025-07-14 10:00:00", "2025-07-14 10:00:05")


def _rounds_sql(rounds: int = 3) -> str:
    """Candidates of each round within the range of the best tenth of the round before."""
    parts = [f"WITH m AS (SELECT avg(l_quantity) AS qm, avg(l_tax) AS tm FROM lineitem), n AS (SELECT count(*) AS n FROM part), "
             "b0 AS (SELECT min(l_quantity) * 0.95 AS ql, max(l_quantity) * 1.05 AS qh, min(l_tax) * 0.95 AS tl, max(l_tax) * 1.05 AS th FROM lineitem)"]
    for r in range(rounds):
        parts.append(f"c{r} AS (SELECT t, ql + {_draw('l_quantity', 42 + r)} * (qh - ql) AS q, tl + {_draw('l_tax', 42 + r)} * (th - tl) AS x FROM (SELECT unnest(range(n)) AS t FROM n), b{r})")
        parts.append(f"s{r} AS (SELECT t + {r} * n AS trial_number, q, x, -(pow(q - qm, 2) + pow(x - tm, 2)) AS value FROM c{r}, m, n WHERE q + x < 40)")
        parts.append(f"b{r + 1} AS (SELECT min(q) AS ql, max(q) AS qh, min(x) AS tl, max(x) AS th FROM (SELECT *, row_number() OVER (ORDER BY value DESC, trial_number) AS r FROM s{r}), n WHERE r <= greatest(2, (n * 0.1)::BIGINT))")
    every = " UNION ALL ".join(f"SELECT * FROM s{r}" for r in range(rounds))
    return ", ".join(parts) + f" SELECT trial_number, {R('value', 4)} AS value FROM ({every}) z ORDER BY z.value DESC, trial_number LIMIT 5"


@query(_rounds_sql(), digits=4)
def search_in_rounds(spark, d):
    """Bounds shrink around the best tenth between rounds."""
    return O.recommendations(_search(spark, d, rounds=3), _PARAMS, 5).drop("params")


def search_with(spark, d, model):
    """As many candidates as there are parts, scored by a trained model: the five lowest predictions."""
    bounds = O.bounds_dict(O.bounds_from_data(lineitem(spark, d), FEATURES))
    trials = O.search_setpoints(spark, bounds, lambda pool: M.predict_batch(model, pool), table(spark, d, "part").count(), maximize=False)
    return O.recommendations(trials, FEATURES, 5, maximize=False).drop("params")


def search_model(spark, d):
    """All rounds, no early stop."""
    return _boosted(spark, d, early_stop=False)[0]


@query(digits=3)
def search_with_model(spark, d):
    """Candidates scored by a model that is trained first."""
    return search_with(spark, d, search_model(spark, d))
