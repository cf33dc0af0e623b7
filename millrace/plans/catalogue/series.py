"""Rolling and recursive filters, shifts, peaks, ranks, lags."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import grid as G
from millrace.operators import lags as L
from millrace.operators import peaks as P
from millrace.operators import quantiles as K
from millrace.operators import windows as V
from millrace.operators.chunks import prefix_sums as prefix_sums_of
from millrace.operators.chunks import row_index as number_rows
from millrace.plans.catalogue import recursion as S
from millrace.plans.catalogue.base import FU, GU, HU, TYPES, W, R, events, hourly_by_user, query, wide

USER = ["user_id"]
STEP = {"step": "1 hour"}


def gappy(spark, d):
    return G.reindex_grid(hourly_by_user(spark, d), USER, "ts", "1 hour")


def filled(spark, d):
    return G.fill_gaps(gappy(spark, d), USER, "ts", ["value"], "both", step="1 hour")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_index, count(*) OVER (PARTITION BY user_id) AS n_rows FROM events")
def row_index(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ts")
    return number_rows(e, USER, "ts", tie_cols=["event_id"], total="n_rows").drop("ts")


@query(f"SELECT event_id, event_type, row_number() OVER w - 1 AS row_index, count(*) OVER (PARTITION BY event_type) AS n_rows, {R('coalesce(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)', 4)} AS before "
       "FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)", digits=4)
def prefix_sums(spark, d):
    e = events(spark, d).select("event_id", "event_type", "ts", "value")
    return prefix_sums_of(e, ["event_type"], "ts", {"before": F.col("value")}, tie_cols=["event_id"]).drop("ts", "value")


def _frame(agg: str, before: int, after: int, src: str = "value") -> str:
    return f"{agg}({src}) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"


@query(f"WITH {GU} SELECT user_id, ts, {R(_frame('avg', 7, 7))} AS smooth FROM gu")
def rolling_mean(spark, d):
    return V.rolling_mean(gappy(spark, d), USER, "ts", ["value"], 15, **STEP).select("user_id", "ts", F.col("value_roll").alias("smooth"))


@query(f"SELECT event_id, user_id, {R('avg(value) OVER w')} AS smooth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)")
def rolling_mean_by_row(spark, d):
    """Rows as they come, not on a grid."""
    e = events(spark, d).select("event_id", "user_id", "ts", "value")
    out = V.rolling_mean(e, USER, "ts", ["value"], 15, tie_cols=["event_id"], rows_per_chunk=40)
    return out.select("event_id", "user_id", F.col("value_roll").alias("smooth"))


@query(f"WITH {GU} SELECT user_id, ts, {R(_frame('median', 2, 2))} AS smooth FROM gu")
def rolling_median(spark, d):
    return V.rolling_median(gappy(spark, d), USER, "ts", ["value"], 5, **STEP).select("user_id", "ts", F.col("value_roll").alias("smooth"))


@query(f"WITH {FU} SELECT user_id, ts, CASE WHEN {_frame('count', 15, 14)} >= 30 THEN {R(_frame('avg', 15, 14))} END AS smooth FROM fu")
def rolling_mean_even_full(spark, d):
    """An even centred frame reaches one row further back; incomplete frames are NULL."""
    return V.rolling(filled(spark, d), USER, "ts", ["value"], 30, **STEP).select("user_id", "ts", F.col("value_roll").alias("smooth"))


_REACH = 104  # weights below 1e-18 for alpha 0.3 lie beyond this many rows


@query(f"""WITH {FU}, pairs AS (SELECT a.user_id, a.ts, b.value, pow(0.7, a.i - b.i) * CASE WHEN b.i = 0 THEN 1.0 ELSE 0.3 END AS wt
      FROM fu a JOIN fu b ON a.user_id = b.user_id AND b.i BETWEEN a.i - {_REACH} AND a.i)
      SELECT user_id, ts, {R('sum(value * wt)', 5)} AS smooth FROM pairs GROUP BY 1, 2""", digits=5)
def ewm_recursive(spark, d):
    return V.ewm_recursive(filled(spark, d), USER, "ts", ["value"], 0.3, gaps=False).select("user_id", "ts", F.col("value_ewm").alias("smooth"))


@query(f"""WITH {FU}, pairs AS (SELECT a.user_id, a.ts, b.value, pow(1 - 2.0 / 16, a.i - b.i) AS wt FROM fu a JOIN fu b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 250 AND a.i)
      SELECT user_id, ts, {R('sum(value * wt) / sum(wt)', 5)} AS smooth FROM pairs GROUP BY 1, 2""", digits=5)
def ewm_span(spark, d):
    return V.ewm_span(filled(spark, d), USER, "ts", ["value"], 15, gaps=False).select("user_id", "ts", F.col("value_ewm").alias("smooth"))


def _savgol_sql(width: int = 11, poly: int = 2) -> str:
    """Least squares on the moments of the window, written out for a parabola centred on the window."""
    h = width // 2
    # the fitted window: centred for inner rows, the first or last full one at the ends
    s0, s2, s4 = width, sum(k**2 for k in range(-h, h + 1)), sum(k**4 for k in range(-h, h + 1))
    det = s0 * s4 - s2 * s2
    return f"""WITH {FU}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM fu),
      c AS (SELECT user_id, ts, i, greatest({h}, least(n - 1 - {h}, i)) AS mid FROM n WHERE n >= {width}),
      m AS (SELECT c.user_id, c.ts, c.i - c.mid AS x, sum(f.value) AS t0, sum(f.value * (f.i - c.mid)) AS t1, sum(f.value * (f.i - c.mid) * (f.i - c.mid)) AS t2
        FROM c JOIN fu f ON f.user_id = c.user_id AND f.i BETWEEN c.mid - {h} AND c.mid + {h} GROUP BY 1, 2, 3)
      SELECT user_id, ts, {R(f"({s4} * t0 - {s2} * t2) / {det}::DOUBLE + t1 / {s2}::DOUBLE * x + ({s0} * t2 - {s2} * t0) / {det}::DOUBLE * x * x")} AS smooth FROM m"""


@query(_savgol_sql())
def savgol(spark, d):
    """Parabola over 11 rows; every user's grid is longer than the window."""
    return V.savgol(filled(spark, d), USER, "ts", ["value"], 11, 2, **STEP).select("user_id", "ts", F.col("value_smooth").alias("smooth"))


def _lowess_sql(frac: float = 0.1, rounds: int = 3) -> str:
    """Every fit from the rows of its own neighbourhood; each round weighs rows by the residuals of the one before."""
    cells = " UNION ALL ".join(f"SELECT '{t}' AS event_type, ts, coalesce(last_value({t} IGNORE NULLS) OVER (ORDER BY ts), "
                               f"first_value({t} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM w" for t in TYPES)
    out = (f"WITH {W}, x AS ({cells}), b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM x), "
           f"k AS (SELECT *, greatest(floor(n * {frac} + 1e-10), 2)::BIGINT AS k FROM b), l AS (SELECT *, least(greatest(i - k // 2, 0), n - k) AS l FROM k), "
           "p0 AS (SELECT *, greatest(i - l, l + k - 1 - i) AS h, 1.0::DOUBLE AS r FROM l)")
    for k in range(rounds + 1):
        out += (f", j{k} AS (SELECT p.event_type, p.i, (q.i - p.i)::DOUBLE AS d, q.y, q.r * CASE WHEN abs(q.i - p.i) <= 0.001 * p.h THEN 1 WHEN abs(q.i - p.i) < 0.999 * p.h THEN pow(1 - pow(abs(q.i - p.i) / p.h::DOUBLE, 3), 3) ELSE 0 END AS w "
                f"FROM p{k} p JOIN p{k} q ON q.event_type = p.event_type AND q.i BETWEEN p.l AND p.l + p.k - 1), "
                f"s{k} AS (SELECT event_type, i, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1 FROM j{k} GROUP BY ALL), "
                f"f{k} AS (SELECT event_type, i, t0 / s0 - coalesce(CASE WHEN s2 - s1 * s1 / s0 > 1e-12 THEN (t1 - s1 * t0 / s0) / (s2 - s1 * s1 / s0) END * s1 / s0, 0) AS fit FROM s{k})")
        if k < rounds:
            out += (f", e{k} AS (SELECT p.*, abs(y - fit) AS e FROM p{k} p JOIN f{k} USING (event_type, i)), m{k} AS (SELECT *, median(e) OVER (PARTITION BY event_type) AS m FROM e{k}), "
                    f"p{k + 1} AS (SELECT event_type, ts, y, i, n, k, l, h, CASE WHEN m = 0 THEN (e = 0)::INT WHEN e < 6 * m THEN pow(1 - pow(e / (6 * m), 2), 2) ELSE 0 END AS r FROM m{k})")
    return out + f" SELECT event_type, ts, {R('y')} AS value, {R('fit')} AS value_lowess FROM p{rounds} JOIN f{rounds} USING (event_type, i)"


@query(_lowess_sql())
def lowess(spark, d):
    h = G.fill_gaps(wide(spark, d), [], "ts", TYPES, "both")
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("event_type"), F.col(t).alias("value")) for t in TYPES]))
    long = h.select("ts", cells.alias("c")).select("c.event_type", "ts", "c.value")
    return V.lowess(long, ["event_type"], "ts", "value", 0.1)


@query(f"WITH {GU} SELECT user_id, ts, {R('value - ' + _frame('avg', 59, 0))} AS value_detrended FROM gu")
def detrend(spark, d):
    return V.detrend(gappy(spark, d), USER, "ts", ["value"], 60, **STEP).drop("value")


_Z = f"abs((value - {_frame('avg', 15, 14)}) / nullif({_frame('stddev_samp', 15, 14)}, 0))"


@query(f"WITH {FU} SELECT user_id, ts, CASE WHEN {_frame('count', 15, 14)} >= 30 THEN {R(_Z, 5)} END AS score FROM fu", digits=5)
def rolling_zscore(spark, d):
    return V.rolling_zscore(filled(spark, d), USER, "ts", ["value"], 30, **STEP).select("user_id", "ts", F.col("value_z").alias("score"))


@query(f"SELECT event_id, {R('(value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type)')} AS value_z FROM events")
def zscore(spark, d):
    return V.zscore(events(spark, d).select("event_id", "event_type", "value"), ["value"], by=["event_type"]).select("event_id", "value_z")


@query(f"WITH {FU} SELECT user_id, ts, {R('lag(value, 12) OVER (PARTITION BY user_id ORDER BY ts)')} AS value FROM fu")
def shift_rows(spark, d):
    return V.shift_rows(filled(spark, d), USER, "ts", {"value": 12}, **STEP)


@query(f"""WITH {W}, s AS (SELECT ts, lag(click, 5) OVER (ORDER BY ts) AS click, lead(view, 3) OVER (ORDER BY ts) AS view,
      row_number() OVER (ORDER BY ts) AS r, count(*) OVER () AS n FROM w)
      SELECT ts, {R('click')} AS click, {R('view')} AS view FROM s WHERE r > 5 AND r <= n - 3 AND click IS NOT NULL AND view IS NOT NULL""")
def shift_feature_trim(spark, d):
    w = wide(spark, d).select("ts", "click", "view")
    return V.shift_rows(w, [], "ts", {"click": 5, "view": -3}, trim=True)


@query(f"SELECT event_id, user_id, {R('value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS step_change FROM events")
def diff_prev(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ts", "value")
    return V.diff_prev(e, USER, "ts", "value", "step_change", tie_cols=["event_id"]).drop("ts", "value")


@query(f"""SELECT event_type, event_id, {R("rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0")} AS value_rank FROM events""")
def average_rank(spark, d):
    e = events(spark, d).select("event_type", "event_id", "value")
    return K.average_rank(e, ["event_type"], "value", "value_rank").drop("value")


_TOPS = f"""WITH {FU}, runs AS (SELECT *, sum(CASE WHEN value = p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS run
      FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY i) AS p FROM fu)),
    flat AS (SELECT user_id, run, min(i) AS a, max(i) AS b, any_value(value) AS value FROM runs GROUP BY 1, 2),
    around AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY a) AS l, lead(value) OVER (PARTITION BY user_id ORDER BY a) AS r FROM flat)
    SELECT user_id, ((a + b) // 2)::BIGINT AS row_index, {R('value')} AS value FROM around WHERE value > l AND value > r"""


@query(_TOPS)
def local_maxima(spark, d):
    """Peaks of the filled series, flat tops by their middle row."""
    numbered = number_rows(filled(spark, d), USER, "ts")
    return P.local_maxima(numbered, USER, "row_index", "value")


@query(f"WITH RECURSIVE {FU}, v0 AS (SELECT user_id, i, value AS v FROM fu), {S.tops('v0', 'user_id')}, t2 AS (SELECT * FROM tp WHERE v >= 30), "
       f"{S.thinned('t2', 'user_id', 15)} SELECT user_id, i AS row_index, {R('v')} AS value FROM th")
def find_peaks(spark, d):
    """Peaks of at least 30, at least 15 rows apart, the higher ones first."""
    numbered = number_rows(filled(spark, d), USER, "ts")
    return P.find_peaks(numbered, USER, "row_index", "value", height=30.0, distance=15)


# --- lags -----------------------------------------------------------------------------------------------------------

_FEATURES = ["error", "purchase", "view"]


def _ccf_sql(max_lag: int, detrend: int | None) -> str:
    parts = []
    for f in _FEATURES:
        value = (lambda c: f"{c} - avg({c}) OVER (ORDER BY ts ROWS BETWEEN {detrend - 1} PRECEDING AND CURRENT ROW)") if detrend else (lambda c: c)
        parts.append(f"SELECT '{f}' AS feature, row_number() OVER (ORDER BY ts) AS i, {value(f)} AS x, {value('click')} AS y FROM w WHERE {f} IS NOT NULL AND click IS NOT NULL")
    return f"""{W}, p AS ({' UNION ALL '.join(parts)}),
      c AS (SELECT a.feature, l.lag::INT AS lag, count(*) AS n, nullif(corr(a.y, b.x), 'nan'::DOUBLE) AS corr FROM p a JOIN range(-{max_lag}, {max_lag + 1}) l(lag) ON true
        JOIN p b ON b.feature = a.feature AND b.i = a.i - l.lag GROUP BY 1, 2)"""


@query(f"WITH {_ccf_sql(24, 60)} SELECT feature, lag, n, {R('corr', 5)} AS corr FROM c", digits=5)
def ccf_table(spark, d):
    return L.ccf_table(wide(spark, d), [], "ts", "click", _FEATURES, max_lag=24, rows_per_chunk=100)


@query(f"""WITH {_ccf_sql(48, None)}, r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(corr) DESC NULLS LAST, lag) AS r FROM c)
      SELECT feature, lag AS best_lag, {R('corr', 5)} AS best_corr FROM r WHERE r = 1""", digits=5)
def estimate_lag_ccf(spark, d):
    return L.estimate_lag_ccf(wide(spark, d), [], "ts", "click", _FEATURES, max_lag=48, detrend_rows=None)


@query(f"""WITH {_ccf_sql(24, 60)}, r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(corr) DESC NULLS LAST, lag) AS r FROM c),
      k AS (SELECT max(lag) FILTER (feature = 'error') AS ke, max(lag) FILTER (feature = 'purchase') AS kp, max(lag) FILTER (feature = 'view') AS kv FROM r WHERE r = 1),
      u AS (SELECT *, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM w WHERE click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL AND view IS NOT NULL)
      SELECT u.ts, {R('u.click')} AS click, {R('e.error')} AS error, {R('p.purchase')} AS purchase, {R('v.view')} AS view FROM u, k
      JOIN u e ON e.i = u.i - ke JOIN u p ON p.i = u.i - kp JOIN u v ON v.i = u.i - kv""")
def align_by_best_lag(spark, d):
    """Each feature moved by its own best lag to the target."""
    w = wide(spark, d).select("ts", "click", *_FEATURES)
    return L.align_by_best_lag(w, "ts", "click", _FEATURES, max_lag=24)
