"""Time grids, resampling, gap filling, reshaping and joins along time."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.columns import floor_time
from millrace.operators import grid as G
from millrace.operators import joins as J
from millrace.plans.catalogue.base import (
    FU, GU, HT, HU, TYPES, W, R, events, hourly_by_type, hourly_by_user, query, table, wide, wide_sql,
)

BY_USER = ["user_id"]


@query(f"WITH {W} SELECT ts, " + ", ".join(f"{R(t)} AS {t}" for t in TYPES) + " FROM w")
def pivot_tags(spark, d):
    h = hourly_by_type(spark, d)
    return G.pivot_tags(h, ["ts"], "event_type", "value", TYPES)


@query("SELECT user_id, " + ", ".join(
    f"{R(f'''arg_max(value, {{'a': ts, 'b': event_id}}) FILTER (event_type = '{t}')''')} AS {t}" for t in TYPES) + " FROM events GROUP BY 1")
def pivot_tags_last(spark, d):
    """Latest value per user and event type."""
    return G.pivot_tags(events(spark, d), BY_USER, "event_type", "value", TYPES, order=["ts", "event_id"])


@query(f"WITH {GU} SELECT user_id, ts, {R('value')} AS value FROM gu")
def resample_mean(spark, d):
    """Hourly mean per user, hours without events kept as NULL."""
    return G.resample_mean(events(spark, d), BY_USER, "ts", ["value"], "1 hour")


@query(f"SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, {R('median(value)')} AS value FROM events GROUP BY 1, 2")
def resample_median(spark, d):
    return G.resample_median(events(spark, d), ["event_type"], "ts", ["value"], "5 minutes")


@query(f"SELECT user_id, time_bucket(INTERVAL 8 HOUR, ts) AS ts, {R('avg(value)')} AS value FROM events GROUP BY 1, 2")
def resample_agg(spark, d):
    return G.resample_agg(events(spark, d), BY_USER, "ts", "8 hours", "mean", ["value"])


@query(f"SELECT event_type, date_trunc('day', ts) AS ts, {R('max(value)')} AS value, count(event_id) AS event_id, {R('stddev_samp(user_id)', 4)} AS user_id "
       "FROM events GROUP BY 1, 2", digits=4)
def resample_agg_by_column(spark, d):
    return G.resample_agg(events(spark, d), ["event_type"], "ts", "1 day", {"value": "max", "event_id": "count", "user_id": "std"})


@query(f"WITH {HU} SELECT g.user_id, g.ts, {R('hu.value')} AS value FROM (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTE)) AS ts "
       "FROM hu GROUP BY 1) g LEFT JOIN hu ON hu.user_id = g.user_id AND hu.ts = g.ts")
def reindex_grid(spark, d):
    return G.reindex_grid(hourly_by_user(spark, d), BY_USER, "ts", "30 minutes")


def _gappy(spark, d):
    return G.reindex_grid(hourly_by_user(spark, d), BY_USER, "ts", "1 hour")


_PREV = "last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts)"
_NEXT = "first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(f"WITH {GU} SELECT user_id, ts, {R(_PREV)} AS value FROM gu")
def ffill(spark, d):
    return G.ffill(_gappy(spark, d), BY_USER, "ts", ["value"])


@query(f"WITH {GU} SELECT user_id, ts, {R(_NEXT)} AS value FROM gu")
def bfill(spark, d):
    return G.bfill(_gappy(spark, d), BY_USER, "ts", ["value"])


TRUNC5 = "time_bucket(INTERVAL 5 MINUTE, ts)"


def _wide_fill_sql() -> str:
    cells = ", ".join(
        R(f"coalesce(last_value({t} IGNORE NULLS) OVER (ORDER BY ts), first_value({t} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))") + f" AS {t}"
        for t in TYPES)
    return f"WITH {wide_sql(TRUNC5, 'w5')} SELECT ts, {cells} FROM w5"


@query(_wide_fill_sql())
def fill_both(spark, d):
    """Forward then backward fill of several columns of one long series (no series key)."""
    return G.fill_gaps(wide(spark, d, "5 minutes"), [], "ts", TYPES, "both")


def _interpolated(x: str, table_name: str) -> str:
    return f"""p AS (SELECT *, CASE WHEN value IS NOT NULL THEN {x} END AS vx FROM {table_name}),
      q AS (SELECT *, last_value(value IGNORE NULLS) OVER up AS v0, last_value(vx IGNORE NULLS) OVER up AS x0,
        first_value(value IGNORE NULLS) OVER dn AS v1, first_value(vx IGNORE NULLS) OVER dn AS x1
        FROM p WINDOW up AS (PARTITION BY user_id ORDER BY ts), dn AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      SELECT user_id, ts, {R(f"coalesce(value, v0 + (v1 - v0) * ({x} - x0) / nullif(x1 - x0, 0)::DOUBLE, v0)")} AS value FROM q"""


@query(f"WITH {GU}, " + _interpolated("i", "gu"))
def interpolate_linear(spark, d):
    return G.interpolate_linear(_gappy(spark, d), BY_USER, "ts", ["value"], step="1 hour")


# every user's events themselves, values of 'view' events missing: irregular in time
_IRREG = "ir AS (SELECT user_id, ts, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM events)"


def _irregular(spark, d):
    return events(spark, d).select("user_id", "ts", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))


@query(f"WITH {_IRREG}, " + _interpolated("i", "ir"))
def interpolate_linear_by_row(spark, d):
    """Position is the row number: rows are not evenly spaced in time."""
    return G.interpolate_linear(_irregular(spark, d), BY_USER, "ts", ["value"])


@query(f"WITH {_IRREG}, " + _interpolated("epoch_us(ts)", "ir"))
def interpolate_time(spark, d):
    return G.interpolate_time(_irregular(spark, d), BY_USER, "ts", ["value"])


@query(f"""WITH {HT}, n AS (SELECT event_type, ts, value, lead(ts) OVER (PARTITION BY event_type ORDER BY ts) AS nx FROM ht)
    SELECT event_type, unnest(CASE WHEN nx IS NULL THEN [ts] ELSE generate_series(ts, nx - INTERVAL 10 MINUTE, INTERVAL 10 MINUTE) END) AS ts, {R('value')} AS value FROM n""")
def resample_step(spark, d):
    """Hourly values held on a ten-minute grid."""
    return G.resample_step(hourly_by_type(spark, d), ["event_type"], "ts", ["value"], "10 minutes")


@query("SELECT event_id, ts + INTERVAL 2 HOUR AS ts FROM events")
def shift_time(spark, d):
    return G.shift_time(events(spark, d).select("event_id", "ts"), "ts", "2 hours")


@query(f"WITH {W} SELECT ts, " + ", ".join(R(f"coalesce({t}, avg({t}) OVER ())") + f" AS {t}" for t in TYPES) + " FROM w")
def impute_mean(spark, d):
    return G.impute_mean(wide(spark, d), TYPES)


@query("SELECT event_id, ts, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour FROM events")
def calendar_parts(spark, d):
    return G.calendar_parts(events(spark, d).select("event_id", "ts"), "ts")


@query("SELECT hour(l_shipdate + (l_linenumber * INTERVAL 3 HOUR))::INT AS hour, " + ", ".join(
    R(f"avg(l_extendedprice) FILTER (month(l_shipdate + (l_linenumber * INTERVAL 3 HOUR)) = {m})", 3) + f" AS m{m}" for m in range(1, 13)) + " FROM lineitem GROUP BY 1", digits=3)
def heatmap_pivot(spark, d):
    at = F.col("l_shipdate").cast("timestamp") + F.make_interval(hours=F.col("l_linenumber") * 3)
    return G.heatmap_pivot(table(spark, d, "lineitem").select(at.alias("ts"), "l_extendedprice"), "ts", "l_extendedprice")


@query(f"""SELECT user_id, {R('median(g)')} AS step_seconds FROM (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts)) / 1e6 AS g FROM events)
    WHERE g IS NOT NULL GROUP BY 1""")
def infer_step(spark, d):
    return G.infer_step(events(spark, d).select("user_id", "ts"), BY_USER, "ts")


@query(f"""WITH {GU}, p AS (SELECT *, CASE WHEN value IS NOT NULL THEN i END AS vx FROM gu),
      q AS (SELECT *, last_value(value IGNORE NULLS) OVER up AS v0, last_value(vx IGNORE NULLS) OVER up AS x0,
        first_value(value IGNORE NULLS) OVER dn AS v1, first_value(vx IGNORE NULLS) OVER dn AS x1
        FROM p WINDOW up AS (PARTITION BY user_id ORDER BY ts), dn AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
      f AS (SELECT user_id, ts, coalesce(value, v0 + (v1 - v0) * (i - x0) / nullif(x1 - x0, 0)::DOUBLE, v0) AS value FROM q)
      SELECT user_id, ts, {R('avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)')} AS value FROM f""")
def process_series(spark, d):
    """Mean per hour, linear fill, centred mean of 15."""
    return G.process_series(events(spark, d), BY_USER, "ts", ["value"], step="1 hour", order=["event_id"])


@query(f"""WITH {GU}, {_IRREG} SELECT user_id, ts, {R('value')} AS value FROM gu""", name="resample_mean_daily_chunks")
def resample_mean_daily_chunks(spark, d):
    """The same result whatever the chunk length."""
    return G.resample_mean(events(spark, d), BY_USER, "ts", ["value"], "1 hour", chunk="7 hours")


# --- joins ----------------------------------------------------------------------------------------------------------

# tags are users; a tag feeds up to two (feature, mill) pairs
_DIM = """dim AS (SELECT DISTINCT 'F' || (user_id % 5) AS feature, 'M' || (user_id % 12) AS mill, user_id AS tag_id FROM events
  UNION SELECT DISTINCT 'G', 'M' || (user_id % 4), user_id FROM events WHERE user_id % 3 = 0)"""


def tag_dim(spark, d):
    users = events(spark, d).select(F.col("user_id").alias("tag_id")).distinct()
    first = users.select(F.concat(F.lit("F"), F.col("tag_id") % 5).alias("feature"), F.concat(F.lit("M"), F.col("tag_id") % 12).alias("mill"), "tag_id")
    second = users.filter("tag_id % 3 = 0").select(F.lit("G").alias("feature"), F.concat(F.lit("M"), F.col("tag_id") % 4).alias("mill"), "tag_id")
    return first.unionByName(second)


@query(f"WITH {_DIM} SELECT event_id, ts, feature, mill, {R('value')} AS value FROM events JOIN dim ON user_id = tag_id")
def join_tag_dim(spark, d):
    log = events(spark, d).select("event_id", "ts", F.col("user_id").alias("tag_id"), "value")
    return J.join_tag_dim(log, tag_dim(spark, d)).drop("tag_id")


@query(f"WITH {HU}, plant AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS fe FROM events GROUP BY 1) SELECT user_id, ts, {R('value')} AS value, {R('fe')} AS fe FROM hu JOIN plant USING (ts)")
def broadcast_global_feature(spark, d):
    plant = events(spark, d).groupBy(floor_time("ts", "1 hour").alias("ts")).agg(F.avg("value").alias("fe"))
    return J.broadcast_global_feature(hourly_by_user(spark, d), plant, "ts")


@query(f"WITH {W} SELECT ts, " + ", ".join(f"{R(t)} AS {t}" for t in TYPES) + " FROM w WHERE " + " AND ".join(f"{t} IS NOT NULL" for t in TYPES))
def align_features(spark, d):
    return J.align_features(hourly_by_type(spark, d), ["ts"], "event_type", "value", TYPES)


@query(f"WITH {HT} SELECT a.ts, {R('a.value')} AS click, {R('b.value')} AS view FROM ht a JOIN ht b ON a.ts = b.ts AND a.event_type = 'click' AND b.event_type = 'view'")
def join_on_time(spark, d):
    h = hourly_by_type(spark, d)
    a = h.filter("event_type = 'click'").select("ts", F.col("value").alias("click"))
    b = h.filter("event_type = 'view'").select("ts", F.col("value").alias("view"))
    return J.join_on_time(a, b, ["ts"], check=True)


@query(f"WITH {HU} SELECT user_id, ts, {R('value')} AS value, n FROM hu JOIN (SELECT user_id, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2) USING (user_id, ts)")
def join_identical_index(spark, d):
    counts = events(spark, d).groupBy("user_id", floor_time("ts", "1 hour").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return J.join_identical_index(hourly_by_user(spark, d), counts, ["user_id", "ts"])


_ASOF = "(SELECT * FROM events WHERE event_type <> 'purchase') l ASOF LEFT JOIN (SELECT ts, user_id, value AS lab FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts"


def _sides(spark, d):
    e = events(spark, d)
    left = e.filter("event_type <> 'purchase'").select("user_id", "ts", "event_id")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("lab"))
    return left, right


@query(f"SELECT l.user_id, l.ts, l.event_id, {R('r.lab')} AS lab, r.ts AS lab_ts FROM {_ASOF}")
def asof_join(spark, d):
    left, right = _sides(spark, d)
    return J.asof_join(left, right, BY_USER, "ts", ["lab"], right_time="lab_ts")


@query(f"SELECT l.user_id, l.ts, l.event_id, CASE WHEN l.ts - r.ts <= INTERVAL 6 HOUR THEN {R('r.lab')} END AS lab FROM {_ASOF}")
def asof_join_tolerance(spark, d):
    left, right = _sides(spark, d)
    return J.asof_join(left, right, BY_USER, "ts", ["lab"], tolerance="6 hours", chunk="5 hours")


_STORED = "stored AS (SELECT user_id, max(ts) AS m FROM events WHERE ts < TIMESTAMP '2024-01-20' AND user_id % 10 <> 3 GROUP BY 1)"


@query(f"WITH {_STORED} SELECT event_id, user_id, ts FROM events LEFT JOIN stored USING (user_id) WHERE m IS NULL OR ts > m")
def semi_new_rows(spark, d):
    """Rows newer than the stored maximum of their series; series that are not stored come whole."""
    e = events(spark, d).select("event_id", "user_id", "ts")
    stored = e.filter("ts < '2024-01-20' AND user_id % 10 <> 3").groupBy("user_id").agg(F.max("ts").alias("max_ts"))
    return J.semi_new_rows(e, stored, BY_USER, "ts")


@query("SELECT event_id, user_id, ts FROM events WHERE NOT (ts < TIMESTAMP '2024-01-20' AND event_type <> 'signup')")
def late_rows(spark, d):
    """Rows that are not stored yet, old ones included."""
    e = events(spark, d).select("event_id", "user_id", "ts", "event_type")
    stored = e.filter("ts < '2024-01-20' AND event_type <> 'signup'")
    return J.late_rows(e, stored, ["event_id"]).drop("event_type")


@query("SELECT event_id, user_id, ts, date_diff('week', TIMESTAMP '2024-01-01', ts)::INT AS regime FROM events")
def attach_labels(spark, d):
    """Segments are calendar weeks per user, each starting at its first event."""
    e = events(spark, d).select("event_id", "user_id", "ts")
    week = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).cast("int")
    segments = e.groupBy("user_id", week.alias("regime")).agg(F.min("ts").alias("start_time"))
    return J.attach_labels(e, segments, BY_USER, "ts")


@query("SELECT c_custkey, id, CASE WHEN n_name IS NULL THEN id::VARCHAR ELSE n_name || ' (' || r_name || ')' END AS label FROM "
       "(SELECT c_custkey, c_nationkey + (c_custkey % 2)::INT * 100 AS id FROM customer) LEFT JOIN nation ON n_nationkey = id LEFT JOIN region ON r_regionkey = n_regionkey")
def label_lookup(spark, d):
    names = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("unit"))
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") + (F.col("c_custkey") % 2).cast("int") * 100).alias("id"))
    return J.label_lookup(c, names, "id")
