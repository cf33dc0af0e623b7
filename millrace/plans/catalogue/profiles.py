"""Profiles, data quality, correlation, regression, moments and binning."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import binning as B
from millrace.operators import quality as Q
from millrace.operators import stats as S
from millrace.operators.quantiles import exact_quantiles
from millrace.plans.catalogue.base import MEASURES, TYPES, W, R, RN, events, lineitem, query, table, wide, work_folder
from millrace.sources import sinks

M4 = MEASURES


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@query(_union([
    f'SELECT \'{c}\' AS "column", count({c}) AS n, {R(f"avg({c})", 3)} AS mean, {R(f"stddev_samp({c})", 3)} AS std, {R(f"min({c})", 3)} AS min, '
    f'{R(f"quantile_cont({c}, 0.25)", 3)} AS q25, {R(f"quantile_cont({c}, 0.5)", 3)} AS q50, {R(f"quantile_cont({c}, 0.75)", 3)} AS q75, {R(f"max({c})", 3)} AS max FROM lineitem'
    for c in M4]), digits=3)
def describe_numeric(spark, d):
    return Q.describe_numeric(lineitem(spark, d), M4)


@query(f"WITH {W} " + _union([
    f'SELECT \'{t}\' AS "column", count(*) AS n_rows, count({t}) AS n_present, count(*) - count({t}) AS n_missing, {R(f"(count(*) - count({t})) / count(*)::DOUBLE")} AS missing_rate FROM w' for t in TYPES]))
def missing_rates(spark, d):
    return Q.missing_rates(wide(spark, d), TYPES)


@query("SELECT (o_orderkey % 3 + 1)::INT AS shift, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, d):
    return Q.value_counts(table(spark, d, "orders").select((F.col("o_orderkey") % 3 + 1).cast("int").alias("shift")), "shift")


@query("SELECT count(*) AS n_groups, min(n) AS min_n, max(n) AS max_n, min(n) = max(n) AS balanced FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def balance_check(spark, d):
    return Q.balance_check(table(spark, d, "orders"), "o_orderstatus")


@query("SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT ts::DATE) AS n_days FROM events")
def time_coverage(spark, d):
    return Q.time_coverage(events(spark, d), "ts")


@query(f"SELECT count(*) AS rows_before, count(*) FILTER (l_quantity > 10 AND l_discount < 0.05) AS rows_after, count(*) - count(*) FILTER (l_quantity > 10 AND l_discount < 0.05) AS rows_removed, "
       f"{R('(count(*) - count(*) FILTER (l_quantity > 10 AND l_discount < 0.05)) / count(*)::DOUBLE')} AS removed_rate FROM lineitem")
def removed_rows_report(spark, d):
    return Q.removed_rows_report(lineitem(spark, d), (F.col("l_quantity") > 10) & (F.col("l_discount") < 0.05))


@query("""SELECT p.tag_id, count(l.tag_id) AS n_rows, count(l.tag_id) - count(DISTINCT l.ts) AS n_duplicates, min(l.ts) AS first_ts, max(l.ts) AS last_ts, count(l.tag_id) = 0 AS delivered_nothing
      FROM (SELECT DISTINCT user_id AS tag_id FROM events UNION SELECT DISTINCT user_id + 100000 FROM events WHERE user_id < 3) p
      LEFT JOIN (SELECT user_id AS tag_id, date_trunc('hour', ts) AS ts FROM events) l USING (tag_id) GROUP BY 1""")
def load_report(spark, d):
    """Times truncated to the hour make duplicates; a few tags of the dimension deliver nothing."""
    log = events(spark, d).select(F.col("user_id").alias("tag_id"), F.date_trunc("hour", "ts").alias("ts"))
    users = log.select("tag_id").distinct()
    dim = users.unionByName(users.filter("tag_id < 3").select((F.col("tag_id") + 100000).alias("tag_id")))
    return Q.load_report(log, dim)


@query("SELECT c_custkey AS tag_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_tags(spark, d):
    dim = table(spark, d, "customer").select(F.col("c_custkey").alias("tag_id"))
    return Q.missing_tags(table(spark, d, "orders").select(F.col("o_custkey").alias("tag_id")), dim)


@query(f"""WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
      b AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 30))::INT, 29) AS bin, count(*) AS n FROM lineitem, r GROUP BY 1)
      SELECT k::INT AS bin, {R('lo + k * ((hi - lo) / 30)', 3)} AS lower, {R('lo + (k + 1) * ((hi - lo) / 30)', 3)} AS upper, coalesce(n, 0) AS n
      FROM range(30) t(k) CROSS JOIN r LEFT JOIN b ON b.bin = k""", digits=3)
def histogram(spark, d):
    return Q.histogram(lineitem(spark, d), "l_extendedprice", 30)


@query(f"SELECT count(value) AS n_trials, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std, {R('min(value)')} AS min, {R('max(value)')} AS max FROM events")
def trial_stats(spark, d):
    return Q.trial_stats(events(spark, d), "value")


# --- correlation and regression -------------------------------------------------------------------------------------


@query(f"WITH {W} " + _union([f"SELECT '{a}' AS a, '{b}' AS b, {RN(f'corr({a}, {b})')} AS corr FROM w" for a in TYPES for b in TYPES]))
def corr_matrix(spark, d):
    """Each pair over its own complete hours."""
    return S.corr_matrix(wide(spark, d), TYPES)


@query(_union([f"SELECT '{c}' AS feature, {RN(f'corr({c}, l_extendedprice)')} AS corr FROM lineitem" for c in M4 if c != "l_extendedprice"]))
def target_corr(spark, d):
    return S.target_corr(lineitem(spark, d), "l_extendedprice", M4)


@query(f"WITH {W} " + _union([
    f"SELECT '{c}' AS feature, count(*) AS n, {R(f'corr(click, {c})')} AS r, {R(f'corr(click, {c}) * corr(click, {c})')} AS r2, {R(f'regr_slope(click, {c})')} AS slope, "
    f"{R(f'regr_intercept(click, {c})')} AS intercept FROM w WHERE click IS NOT NULL AND {c} IS NOT NULL" for c in TYPES[1:]]))
def pair_regression(spark, d):
    return S.pair_regression(wide(spark, d), "click", TYPES[1:])


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


_CORRS = ", ".join(f"{RN(f'corr({a}, {b})', 5)} AS corr_{a}_{b}" for a, b in _pairs(TYPES))


@query(f"""WITH m AS (SELECT ts, {', '.join(f"value * CASE WHEN event_type = '{t}' THEN 1 END AS {t}_raw" for t in TYPES)} FROM events),
      h AS (SELECT time_bucket(INTERVAL 20 MINUTE, ts) AS ts, {', '.join(f'avg({t}_raw) AS {t}' for t in TYPES)} FROM m GROUP BY 1),
      c AS (SELECT time_bucket(INTERVAL 8 HOUR, ts) AS ts, {_CORRS} FROM h GROUP BY 1 HAVING count(*) >= 10)
      SELECT * FROM c WHERE {' OR '.join(f'corr_{a}_{b} IS NOT NULL' for a, b in _pairs(TYPES))}""", digits=5)
def windowed_corr(spark, d):
    """Twenty-minute means, correlations per eight hours."""
    return S.windowed_corr(wide(spark, d, "20 minutes"), "ts", TYPES, "8 hours", 10)


@query("SELECT l_linenumber::INT AS regime, count(*) AS n_samples, " + ", ".join(
    f"{RN(f'corr(l_extendedprice, {c})')} AS corr_{c}" for c in ["l_quantity", "l_discount", "l_tax"]) + " FROM lineitem GROUP BY 1")
def regime_corr(spark, d):
    li = lineitem(spark, d).withColumn("regime", F.col("l_linenumber"))
    return S.regime_corr(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


def _spearman_sql() -> str:
    ranks = ", ".join(f"rank() OVER (PARTITION BY l_linenumber ORDER BY {c}) + (count(*) OVER (PARTITION BY l_linenumber, {c}) - 1) / 2.0 AS r_{c}" for c in M4)
    return (f"WITH r AS (SELECT l_linenumber, {ranks} FROM lineitem) SELECT l_linenumber::INT AS regime, count(*) AS n_samples, " + ", ".join(
        f"{RN(f'corr(r_l_extendedprice, r_{c})')} AS corr_{c}" for c in ["l_quantity", "l_discount", "l_tax"]) + " FROM r GROUP BY 1")


@query(_spearman_sql())
def regime_corr_spearman(spark, d):
    li = lineitem(spark, d).withColumn("regime", F.col("l_linenumber"))
    return S.regime_corr(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "spearman")


@query(f"""SELECT event_type, {R('greatest(0, 1 - sse / sst)')} AS r2 FROM (SELECT event_type, sum((value - m) * (value - m)) AS sse, sum((value - g) * (value - g)) AS sst FROM (
      SELECT event_type, value, avg(value) OVER (PARTITION BY event_type, ts::DATE) AS m, avg(value) OVER (PARTITION BY event_type) AS g FROM events) GROUP BY 1)""")
def segment_r2(spark, d):
    """Segments are days."""
    e = events(spark, d).withColumn("regime", F.to_date("ts"))
    return S.segment_r2(e, "value", by=["event_type"])


_PROBS = [0.05, 0.33, 0.5, 0.67, 0.95]


@query(_union([f'SELECT \'{c}\' AS "column", {p}::DOUBLE AS prob, {R(f"quantile_cont({c}, {p})", 4)} AS value FROM lineitem' for c in M4 for p in _PROBS]), digits=4)
def quantiles(spark, d):
    return S.quantiles(lineitem(spark, d), M4, _PROBS)


@query(_union([f'SELECT \'{c}\' AS "column", {p}::DOUBLE AS prob, {R(f"quantile_cont({c}, {p})", 4)} AS value FROM lineitem' for c in M4 for p in _PROBS]), digits=4)
def quantiles_bracketed(spark, d):
    """The way for columns that do not fit one buffer: rounds of exact counting."""
    return exact_quantiles(lineitem(spark, d), M4, _PROBS, direct_rows=20_000)


@query(_union([f'SELECT \'{c}\' AS "column", count({c}) AS n, {R(f"skewness({c})", 5)} AS skew, {R(f"kurtosis({c})", 5)} AS kurtosis FROM lineitem' for c in M4]), digits=5)
def skew_kurt(spark, d):
    return S.skew_kurt(lineitem(spark, d), M4)


# --- binning --------------------------------------------------------------------------------------------------------

_BINNED = ["l_quantity", "l_extendedprice", "l_discount"]
_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _number(c: str, inner: list[str], lo: str, hi: str) -> str:
    return f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN ({' + '.join(f'({c} > {e})::INT' for e in inner)})::INT END"


def _edge_rows(c: str, method: str, edges: str, src: str = "lineitem") -> str:
    """One row per distinct edge."""
    return f"SELECT DISTINCT '{c}' AS feature, '{method}' AS method, {R('e')} AS edge FROM (SELECT unnest({edges}) AS e FROM {src})"


def _info(spark, d, method, target=None):
    li = lineitem(spark, d).select(*_BINNED, "l_tax")
    edges = B.bin_edges(li, _BINNED, 5, method, target)
    return B.bin_info(li, edges, method).select("feature", "method", F.explode("bins").alias("edge"))


@query(_union([_edge_rows(c, "quantile", "[" + ", ".join(f"quantile_cont({c}, {k / 5})" for k in range(6)) + "]") for c in _BINNED]))
def bins_quantile(spark, d):
    return _info(spark, d, "quantile")


@query(_union([_edge_rows(c, "equal_width", "[" + ", ".join(f"min({c}) + {k} * ((max({c}) - min({c})) / 5)" for k in range(5)) + f", max({c})]") for c in _BINNED]))
def bins_equal_width(spark, d):
    return _info(spark, d, "equal_width")


def _supervised_edges(c: str) -> str:
    picks = ", ".join(f"max({c}) FILTER (r = (n * {i}) // 5)" for i in range(1, 5))
    ranked = f"(SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n FROM lineitem)"
    return _edge_rows(c, "entropy", f"[min({c}), {picks}, max({c})]", ranked)


@query(_union([_supervised_edges(c) for c in _BINNED]))
def bins_supervised(spark, d):
    return _info(spark, d, "entropy", "l_tax")


def _kmeans_sql(n: int = 5) -> str:
    """Lloyd rounds over the distinct values of each feature and their counts."""
    parts, ends = [], []
    for c in _BINNED:
        low, high = "CASE WHEN k = 1 THEN '-inf'::DOUBLE ELSE (m[k - 1] + m[k]) / 2 END", f"CASE WHEN k = {n} THEN 'inf'::DOUBLE ELSE (m[k] + m[k + 1]) / 2 END"
        inside = f"p.x > {low} AND p.x <= {high}"
        mean = f"list_sum(list_transform(v, lambda p: CASE WHEN {inside} THEN p.x * p.n ELSE 0 END)) / nullif(list_sum(list_transform(v, lambda p: CASE WHEN {inside} THEN p.n ELSE 0 END)), 0)"
        starts = ", ".join(f"quantile_cont({c}, {(k + 0.5) / n})" for k in range(n))
        even = ", ".join(f"min({c}) + (max({c}) - min({c})) * {(k + 0.5) / n}" for k in range(n))
        parts.append(f"v_{c} AS (SELECT list({{'x': x, 'n': n}}) AS v, min(x) AS a, max(x) AS b FROM (SELECT {c}::DOUBLE AS x, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1))")
        parts.append(f"k_{c} AS (SELECT 0 AS r, CASE WHEN len(list_distinct([{starts}])) < {n} THEN [{even}] ELSE [{starts}] END::DOUBLE[] AS m, var_pop({c}) AS s, false AS done FROM lineitem "
                     f"UNION ALL SELECT r + 1, u, s, list_sum(list_transform(list_zip(u, m), lambda z: pow(z[1] - z[2], 2))) <= 1e-4 * s "
                     f"FROM (SELECT r, m, s, list_sort(list_transform(range(1, {n + 1}), lambda k: coalesce({mean}, m[k]))) AS u FROM k_{c}, v_{c} WHERE NOT done AND r < 100))")
        ends.append(f"SELECT DISTINCT '{c}' AS feature, 'kmeans' AS method, {R('edge')} AS edge FROM (SELECT unnest([a, b] || list_transform(range(1, {n}), lambda k: (m[k] + m[k + 1]) / 2)) AS edge "
                    f"FROM (SELECT * FROM k_{c} ORDER BY r DESC LIMIT 1), v_{c})")
    return "WITH RECURSIVE " + ", ".join(parts) + " " + " UNION ALL ".join(ends)


@query(_kmeans_sql())
def bins_kmeans(spark, d):
    return _info(spark, d, "kmeans")


_QSQL = "q AS (SELECT " + ", ".join(f"quantile_cont({c}, {k / 5}) AS {c}_{k}" for c in _BINNED for k in range(6)) + " FROM lineitem)"


def _assigned(c: str) -> str:
    return _number(c, [f"{c}_{k}" for k in range(1, 5)], f"{c}_0", f"{c}_5")


@query(f"WITH {_QSQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, " + ", ".join(f"{_assigned(c)} AS {c}" for c in _BINNED) + " FROM lineitem, q")
def smart_binning(spark, d):
    binned, _ = B.smart_binning(lineitem(spark, d).select(*_KEYS, *_BINNED, "l_tax"), 5, "quantile", "l_tax", _BINNED)
    return binned.select(*_KEYS, *_BINNED)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, " + _number("l_quantity", ["10", "25", "40"], "5", "45") + " AS l_quantity FROM lineitem")
def apply_bins(spark, d):
    """Stored edges on new data: values on an edge belong to the lower bin, values outside to none."""
    return B.apply_bins(lineitem(spark, d).select(*_KEYS, "l_quantity"), {"l_quantity": [5, 10, 25, 40, 45], "absent": [0, 1]})


def _quality_sql(c: str, number: str, src: str) -> str:
    return f"""SELECT '{c}' AS feature, count(*) AS unique_bins, min(n) AS min_bin_size, max(n) AS max_bin_size,
      {R('1 - stddev_pop(n) / (sum(n) / count(*)::DOUBLE)')} AS balance_score, any_value(k) AS information_retention FROM (
        SELECT b, count(*) AS n, any_value(k) AS k FROM (SELECT b, {R('corr(x, m) OVER ()')} AS k FROM (
          SELECT b, x, avg(x) OVER (PARTITION BY b) AS m FROM (SELECT {c} AS x, {number} AS b FROM {src}) WHERE b IS NOT NULL)) GROUP BY 1)"""


@query("WITH e AS (SELECT " + ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in _BINNED) + " FROM lineitem) " + _union([
    _quality_sql(c, _number(c, [f"{c}_lo + {k} * (({c}_hi - {c}_lo) / 5)" for k in range(1, 5)], f"{c}_lo", f"{c}_hi"), "lineitem, e") for c in _BINNED]), digits=6)
def binning_quality(spark, d):
    li = lineitem(spark, d).select(*_BINNED)
    return B.binning_quality(li, B.bins_equal_width(li, _BINNED, 5))


@query()
def compare_binnings(spark, d):
    return B.compare_binnings(lineitem(spark, d).select(*_BINNED, "l_tax"), _BINNED, 5, "l_tax")


@query(_union([f"""SELECT '{c}' AS feature, b::INT AS bin, n AS bin_count FROM (SELECT {_number(c, [f'lo + {k} * ((hi - lo) / 5)' for k in range(1, 5)], 'lo', 'hi')} AS b, count(*) AS n
      FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1)""" for c in _BINNED]))
def write_bin_info(spark, d):
    """The bin table through its file."""
    _, info = B.smart_binning(lineitem(spark, d).select(*_BINNED), 5, "equal_width")
    path = work_folder(spark, "bins")
    sinks.write_bin_info(info, path)
    return sinks.read_bin_info(spark, path).select("feature", F.posexplode("bin_counts").alias("bin", "bin_count"))
