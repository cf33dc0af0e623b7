"""Change points, segments and regime summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import dedup as D
from millrace.operators import regimes as C
from millrace.operators.chunks import row_index
from millrace.plans.catalogue import recursion as S
from millrace.plans.catalogue.base import HT, HU, TYPES, W, R, events, hourly_by_type, hourly_by_user, query, wide
from millrace.plans.regime_run import regime_study as study

USER = ["user_id"]
FEATURES = ["error", "purchase", "signup"]


def hourly_users(spark, d):
    return hourly_by_user(spark, d)


def _filled(c: str) -> str:
    return (f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY ts), first_value({c} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


_BY_USER = f"{HU}, f AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM hu), {S.points('f', 'user_id', ['value'], 1, 'value')}"
_ROWS = f"{W}, f AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, ts, click, {', '.join(_filled(c) + f' AS {c}' for c in FEATURES)} FROM w)"


def _wide_points(jump: int) -> str:
    return f"{_ROWS}, {S.points('f', '', FEATURES, jump, 'click')}"


@query(f"WITH RECURSIVE {_BY_USER}, {S.exact('user_id', ['value'], 4, [2000.0])} {S.timed('f', 'user_id')}")
def detect_pelt(spark, d):
    """Exact segmentation of every user's hourly means."""
    return C.detect_regimes(hourly_users(spark, d), USER, "ts", ["value"], method="pelt", min_size=4, jump=1, pen=2000.0)


@query(f"WITH RECURSIVE {_wide_points(2)}, {S.exact('', FEATURES, 12, [400.0, 3200.0])} SELECT * FROM sg")
def detect_pelt_in_blocks(spark, d):
    """The exact search of one long series in blocks of 100 rows, two penalties together."""
    points = C.change_table(C.settled_features(wide(spark, d), [], "ts", FEATURES), [], "ts", FEATURES, 2)
    return C.detect_pelt(points, [], [400.0, 3200.0], 12, block=100)


@query(f"WITH RECURSIVE {_BY_USER}, {S.binary('user_id', ['value'], 4, [2000.0])} {S.timed('f', 'user_id')}")
def detect_binseg(spark, d):
    return C.detect_regimes(hourly_users(spark, d), USER, "ts", ["value"], method="binseg", min_size=4, jump=1, pen=2000.0)


@query(f"WITH RECURSIVE {_wide_points(2)}, {S.binary_count(FEATURES, 24, 5)} {S.timed('f', '')}")
def detect_binseg_count(spark, d):
    """A fixed number of changes in one long series of several features."""
    return C.detect_regimes(wide(spark, d), [], "ts", FEATURES, method="binseg", min_size=24, jump=2, n_bkps=5)


def _window_gain_sql(width: int, jump: int) -> str:
    h = width // 2
    terms = " + ".join(
        f"{h / 2} * pow(avg({c}) OVER (ORDER BY i ROWS BETWEEN {h} PRECEDING AND 1 PRECEDING) - avg({c}) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING), 2)" for c in FEATURES)
    return f"g AS (SELECT i, n, {terms} AS gain FROM (SELECT *, count(*) OVER () AS n FROM f)), wg AS (SELECT i AS row_index, n AS n_rows, gain FROM g WHERE i >= {h} AND i < n - {h} AND i % {jump} = 0)"


@query(f"WITH RECURSIVE {_wide_points(2)}, {_window_gain_sql(36, 2)}, {S.window('wg', FEATURES, 12, 2, 36, [300.0])} {S.timed('f', '')}")
def detect_window(spark, d):
    return C.detect_regimes(wide(spark, d), [], "ts", FEATURES, method="window", min_size=12, jump=2, pen=300.0)


@query(f"WITH {_ROWS}, {_window_gain_sql(36, 2)} SELECT row_index, n_rows, {R('gain', 4)} AS gain FROM wg", digits=4)
def window_gain(spark, d):
    """Cost saved by a change at each admissible hour."""
    return C.window_gain(C.settled_features(wide(spark, d), [], "ts", FEATURES), [], "ts", FEATURES, 36, 2)


_TRIED = [200.0, 400.0, 800.0, 1600.0, 3200.0]
_TUNING = f"SELECT penalty, n_regimes, {R('avg_seg_len')} AS avg_seg_len, {R('r2_target')} AS r2_target FROM tn"


@query(f"WITH RECURSIVE {_wide_points(2)}, {S.exact('', FEATURES, 12, _TRIED)}, {S.measures('')} {_TUNING}")
def tune_penalty(spark, d):
    return C.tune_penalty(wide(spark, d), [], "ts", FEATURES, _TRIED, min_size=12, jump=2, target="click")


@query(f"WITH RECURSIVE {_wide_points(2)}, {S.binary('', FEATURES, 12, _TRIED)}, {S.measures('')} {_TUNING}")
def tune_penalty_binseg(spark, d):
    """One tree of greedy splits for all penalties; the SQL runs a search for each."""
    return C.tune_penalty(wide(spark, d), [], "ts", FEATURES, _TRIED, method="binseg", min_size=12, jump=2, target="click")


@query(f"WITH RECURSIVE {_wide_points(2)}, {_window_gain_sql(36, 2)}, {S.window('wg', FEATURES, 12, 2, 36, _TRIED)}, {S.measures('')} {_TUNING}")
def tune_penalty_window(spark, d):
    return C.tune_penalty(wide(spark, d), [], "ts", FEATURES, _TRIED, method="window", min_size=12, jump=2, target="click")


_PICKED = [500.0, 1000.0, 2000.0, 4000.0]


@query(f"WITH RECURSIVE {_BY_USER}, {S.exact('user_id', ['value'], 4, _PICKED)}, {S.measures('user_id')}, {S.picked('user_id', 3, 12, 5)} SELECT * FROM ch")
def pick_penalty(spark, d):
    tuning = C.tune_penalty(hourly_users(spark, d).withColumn("target", F.col("value")), USER, "ts", ["value"], _PICKED, min_size=4, jump=1, target="target")
    return C.pick_penalty(tuning, USER, min_regimes=3, max_regimes=12, min_avg_len=5)


def _weekly(spark, d):
    w = wide(spark, d)
    return w.withColumn("regime", F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).cast("int"))


@query(f"""WITH {W}, s AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', ts) // 7 AS regime, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n_samples,
      (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 AS duration_min, avg(click) AS cm, stddev_pop(click) AS cs, avg(error) AS em, avg(view) AS vm FROM w GROUP BY 1)
      SELECT regime::INT AS regime, start_time, end_time, n_samples, {R('duration_min')} AS duration_min, {R('cm')} AS click_mean, {R('cs')} AS click_std, {R('em')} AS error_mean, {R('vm')} AS view_mean,
      {R('cm - lag(cm) OVER (ORDER BY start_time)')} AS delta FROM s""")
def summarize_segments(spark, d):
    """Regimes are calendar weeks."""
    return C.summarize_segments(_weekly(spark, d), [], "ts", target="click", features=["error", "view"], delta_name="delta")


@query(f"WITH {W} SELECT ts, {R('click')} AS click, (date_diff('day', TIMESTAMP '2024-01-01', ts) // 7)::INT AS regime, {R('''avg(click) OVER (PARTITION BY date_diff('day', TIMESTAMP '2024-01-01', ts) // 7)''')} AS click_segment_mean FROM w")
def segment_mean_overlay(spark, d):
    return C.segment_mean_overlay(_weekly(spark, d).select("ts", "click", "regime"), ["click"], ["regime"])


@query(f"""WITH {W}, s AS (SELECT ts::DATE AS day, avg(click) AS m FROM w GROUP BY 1), j AS (SELECT day, m - lag(m) OVER (ORDER BY day) AS jump FROM s)
      SELECT day::VARCHAR AS day, {R('jump')} AS jump FROM j ORDER BY abs(jump) DESC NULLS LAST, day LIMIT 10""")
def largest_jumps(spark, d):
    """Ten largest changes between consecutive segments, here days."""
    daily = C.summarize_segments(wide(spark, d).withColumn("regime", F.to_date("ts")), [], "ts", target="click", features=[], delta_name="jump")
    return D.top_k(daily.select(F.col("regime").cast("string").alias("day"), "jump"), 10, [F.abs(F.col("jump")).desc_nulls_last(), "day"])


def _z(value: str, key: str, rows: str, width: int) -> str:
    frame = f"OVER ({f'PARTITION BY {key}' if key else ''} ORDER BY i ROWS BETWEEN {width - 1 - (width - 1) // 2} PRECEDING AND {(width - 1) // 2} FOLLOWING)"
    return (f"z AS (SELECT {key + ', ' if key else ''}ts, i, {value} AS value, CASE WHEN count({value}) {frame} >= {width} THEN abs(({value} - avg({value}) {frame}) / nullif(stddev_samp({value}) {frame}, 0)) END AS v FROM {rows})")


@query(f"WITH RECURSIVE {_BY_USER}, {_z('value', 'user_id', 'f', 10)}, {S.tops('z', 'user_id')}, t2 AS (SELECT * FROM tp WHERE v >= 1.5), {S.thinned('t2', 'user_id', 5)} "
       f"SELECT user_id, i AS row_index, {R('th.v')} AS score, z.ts FROM th JOIN z USING (user_id, i)")
def detect_rolling_z(spark, d):
    return C.detect_rolling_z(hourly_users(spark, d), USER, "ts", "value", window=10, threshold=1.5)


_MARKS = f"""{HU}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM hu),
      b AS (SELECT user_id, i AS a, lead(i) OVER (PARTITION BY user_id ORDER BY i) AS z FROM n WHERE i % 20 = 0 OR i = n - 1),
      s AS (SELECT b.user_id, b.a AS start_idx, b.z AS end_idx, min(ts) AS start_time, max(ts) AS end_time, avg(value) AS mean_value, stddev_samp(value) AS std_value, count(*) AS sample_count
        FROM b JOIN n ON n.user_id = b.user_id AND n.i BETWEEN b.a AND b.z WHERE b.z IS NOT NULL GROUP BY 1, 2, 3),
      k AS (SELECT *, (epoch_us(end_time) - epoch_us(start_time)) / 3600e6 AS h FROM s)"""


@query(f"WITH {_MARKS} SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY start_idx) - 1)::INT AS regime_id, start_time, end_time, start_idx, end_idx, {R('h')} AS duration_hours, "
       f"{R('mean_value')} AS mean_value, {R('std_value')} AS std_value, sample_count FROM k WHERE h >= 48")
def extract_regimes(spark, d):
    """Boundaries at every twentieth row; neighbours share their boundary row; only regimes of two days or more."""
    h = hourly_users(spark, d)
    marks = row_index(h, USER, "ts").filter((F.col("row_index") % 20 == 0) & (F.col("row_index") > 0)).select("user_id", "row_index")
    return C.extract_regimes(h, marks, USER, "ts", "value", min_minutes=48 * 60)


_LONG = (f"{W}, c AS (SELECT * FROM w WHERE {' AND '.join(f'{t} IS NOT NULL' for t in TYPES)}), "
         f"l AS ({' UNION ALL '.join(f"SELECT '{t}' AS feature, ts, {t} AS value, row_number() OVER (ORDER BY ts) - 1 AS i FROM c" for t in TYPES)})")


@query(f"""WITH RECURSIVE {_LONG}, {_z('value', 'feature', 'l', 30)}, {S.tops('z', 'feature')}, t2 AS (SELECT * FROM tp WHERE v >= 2.0), {S.thinned('t2', 'feature', 15)},
      m AS (SELECT feature, i FROM th UNION SELECT feature, unnest([0, max(i)]) FROM z GROUP BY feature),
      b AS (SELECT * FROM (SELECT feature, i AS x, lead(i) OVER (PARTITION BY feature ORDER BY i) AS y FROM m) WHERE y IS NOT NULL),
      s AS (SELECT b.feature, x AS start_idx, y AS end_idx, min(ts) AS start_time, max(ts) AS end_time, avg(value) AS mv, stddev_samp(value) AS sv, count(*) AS sample_count
        FROM b JOIN z ON z.feature = b.feature AND z.i BETWEEN x AND y GROUP BY ALL),
      k AS (SELECT *, (epoch_us(end_time) - epoch_us(start_time)) / 3600e6 AS h FROM s)
      SELECT feature, (row_number() OVER (PARTITION BY feature ORDER BY start_idx) - 1)::INT AS regime_id, start_time, end_time, start_idx, end_idx, {R('h')} AS duration_hours,
      {R('mv')} AS mean_value, {R('sv')} AS std_value, sample_count FROM k WHERE h >= 3""")
def regime_summary_all(spark, d):
    return C.regime_summary_all(wide(spark, d), [], "ts", TYPES, window=30, threshold=2.0, min_minutes=180)


def _study_rows(key: str = "", rows: str = "f") -> str:
    """lb: rows with the regime of the picked penalty."""
    on = f"AND sg.{key} = r.{key} AND ch.{key} = r.{key}" if key else ""
    return f"lb AS (SELECT r.*, regime FROM {rows} r JOIN sg ON r.i >= start_idx AND r.i < end_idx JOIN ch ON ch.penalty = sg.penalty {on})"


def _summary(target: str, key: str = "") -> str:
    lead = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    return (f"SELECT {lead}regime, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n_samples, {R('(epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6')} AS duration_min, {R(f'avg({target})')} AS {target}_mean, "
            f"{R(f'stddev_pop({target})')} AS {target}_std, {R(f'avg({target}) - lag(avg({target})) OVER ({part} ORDER BY min(ts))')} AS psi200_delta_vs_prev FROM lb GROUP BY {lead}regime")


_STUDIED = [200.0, 400.0, 800.0, 1600.0]


@query(f"WITH RECURSIVE {_wide_points(2)}, {S.exact('', FEATURES, 12, [*_STUDIED, 600.0])}, {S.measures('')}, {S.picked('', 3, 40, 10, '(SELECT * FROM tn WHERE penalty <> 600)')}, {_study_rows()} {_summary('click')}")
def regime_study(spark, d):
    """Sweep, pick, segment, label, summarise: the summary."""
    s = study(wide(spark, d), "ts", features=FEATURES, target="click", penalties=_STUDIED, min_size=12, jump=2,
              step="1 hour", min_regimes=3, max_regimes=40, min_avg_minutes=600)
    return s.summary


def _ranked(c: str) -> str:
    """Ranks of the complete pairs of a feature and the target in each regime."""
    def rank(value: str, name: str) -> str:
        return (f"CASE WHEN {value} IS NOT NULL THEN rank() OVER (PARTITION BY regime, {value} IS NULL ORDER BY {value}) "
                f"+ (count(*) OVER (PARTITION BY regime, {value}) - 1) / 2.0 END AS {name}_{c}")

    return f"{rank(f'(CASE WHEN click IS NOT NULL THEN {c} END)', 'x')}, {rank(f'(CASE WHEN {c} IS NOT NULL THEN click END)', 'y')}"


@query(f"WITH RECURSIVE {_wide_points(2)}, {S.exact('', FEATURES, 24, [400.0, 1600.0])}, {S.measures('')}, {S.picked('', 2, 40, 10)}, {_study_rows(rows='wr')}".replace(
           "dp AS (", "wr AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i FROM w), dp AS (", 1)
       + f", rk AS (SELECT regime, {', '.join(_ranked(c) for c in FEATURES)} FROM (SELECT regime, click, {', '.join(FEATURES)} FROM lb)) "
       + f"SELECT regime, count(*) AS n_samples, {', '.join(R(f'corr(x_{c}, y_{c})') + f' AS corr_{c}' for c in FEATURES)} FROM rk GROUP BY regime")
def regime_study_correlations(spark, d):
    s = study(wide(spark, d), "ts", features=FEATURES, target="click", penalties=[400.0, 1600.0], min_size=24, jump=2, step="1 hour",
              min_regimes=2, max_regimes=40, min_avg_minutes=600, corr_method="spearman")
    return s.correlations


_BY_TYPE = (f"{HT}, f AS (SELECT event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i FROM ht), "
            f"{S.points('f', 'event_type', ['value'], 2, 'value')}")
_PER_TYPE = [100.0, 300.0, 900.0, 2700.0]


@query(f"WITH RECURSIVE {_BY_TYPE}, {S.exact('event_type', ['value'], 12, _PER_TYPE)}, {S.measures('event_type')}, {S.picked('event_type', 3, 40, 10)}, "
       f"{_study_rows('event_type')} {_summary('value', 'event_type')}")
def regime_study_by_type(spark, d):
    """Several series at once: each has its own penalty and regimes."""
    s = study(hourly_by_type(spark, d), "ts", series_cols=["event_type"], features=["value"], target="value",
              penalties=_PER_TYPE, min_size=12, jump=2, step="1 hour", min_regimes=3, max_regimes=40, min_avg_minutes=600)
    return s.summary
