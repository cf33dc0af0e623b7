"""Whole flows: mill tables, increments, shift reports, combined frames, streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.operators import modelling as M
from millrace.operators.grid import fill_gaps, resample_mean
from millrace.plans import combined, mill_tables, shift_reports
from millrace.plans.catalogue.base import TYPES, R, events, query, table, work_folder
from millrace.sources import logs, tables
from millrace.streaming import streams

MILLS, FEATURES = ["M1", "M2"], ["A", "B", "FE"]
DIM = [("A", "M1", "click"), ("A", "M2", "view"), ("B", "M1", "error"), ("B", "M2", "purchase"), ("FE", "M1", "signup"), ("FE", "M2", "signup")]


def flagship(spark, d):
    """Sensor log to a regular wide table: hourly means per tag, gaps filled, one column per tag."""
    hourly = resample_mean(events(spark, d), ["event_type"], "ts", ["value"], "1 hour")
    filled = fill_gaps(hourly, ["event_type"], "ts", ["value"], "both", step="1 hour")
    return filled.groupBy("ts").pivot("event_type", TYPES).agg(F.max("value")).orderBy("ts")


_FLAG = """g AS (SELECT event_type, unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS ts FROM events GROUP BY 1),
  h AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2),
  f AS (SELECT event_type, ts, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts),
    first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM g LEFT JOIN h USING (event_type, ts))"""


@query(f"WITH {_FLAG} SELECT ts, " + ", ".join(f"{R(f'''max(value) FILTER (event_type = '{t}')''')} AS {t}" for t in TYPES) + " FROM f GROUP BY 1")
def wide_tag_table(spark, d):
    return flagship(spark, d)


def _log(spark, d, until=None):
    e = table(spark, d, "events")
    if until:
        e = e.filter(F.col("ts") < until)
    live, archive = e.filter("ts >= '2024-01-15'"), e.filter("ts < '2024-01-20'")
    return logs.scan_log_archives([live, archive], whole=True, time_col="ts", tag_col="event_type", value_col="value")


def _dim(spark):
    return spark.createDataFrame(DIM, "feature string, mill string, tag_id string")


def _mill_sql() -> str:
    dim = ", ".join(f"('{f}', '{m}', '{t}')" for f, m, t in DIM)

    def both(c: str, part: str) -> str:
        return (f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY ts), first_value({c} IGNORE NULLS) OVER "
                f"(PARTITION BY {part} ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}")

    return f"""dim(feature, mill, tag) AS (VALUES {dim}),
      log AS (SELECT *, 0 AS prio FROM events WHERE ts >= TIMESTAMP '2024-01-15' UNION ALL SELECT *, 1 AS prio FROM events WHERE ts < TIMESTAMP '2024-01-20'),
      piv AS (SELECT feature, prio, ts, max(value) FILTER (mill = 'M1') AS M1, max(value) FILTER (mill = 'M2') AS M2 FROM log JOIN dim ON event_type = tag GROUP BY 1, 2, 3),
      held AS (SELECT feature, prio, ts, {both('M1', 'feature, prio')}, {both('M2', 'feature, prio')} FROM piv),
      means AS (SELECT feature, prio, date_trunc('hour', ts) AS ts, avg(M1) AS M1, avg(M2) AS M2 FROM held GROUP BY 1, 2, 3),
      grid AS (SELECT feature, prio, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM means GROUP BY 1, 2),
      mins AS (SELECT * FROM grid LEFT JOIN means USING (feature, prio, ts)),
      merged AS (SELECT feature, ts + INTERVAL 2 HOUR AS ts, M1, M2 FROM mins QUALIFY row_number() OVER (PARTITION BY feature, ts ORDER BY prio) = 1),
      comp AS (SELECT feature, ts, {both('M1', 'feature')}, {both('M2', 'feature')} FROM merged),
      long AS (SELECT feature, ts, 'M1' AS mill, M1 AS value FROM comp UNION ALL SELECT feature, ts, 'M2', M2 FROM comp),
      mill_table AS (SELECT mill, ts, max(value) FILTER (feature = 'A') AS A, max(value) FILTER (feature = 'B') AS B, max(value) FILTER (feature = 'FE') AS FE FROM long
        WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 3)"""


@query(f"WITH {_mill_sql()} SELECT feature, ts, {R('M1')} AS M1, {R('M2')} AS M2 FROM comp")
def compose_feature(spark, d):
    """Two overlapping sources, held values, hourly means, clock offset, all features at once."""
    return mill_tables.compose_features(_log(spark, d), _dim(spark), MILLS, step="1 hour")


@query(f"WITH {_mill_sql()} SELECT mill, ts, {R('A')} AS \"A\", {R('B')} AS \"B\", {R('FE')} AS \"FE\" FROM mill_table")
def build_mill_table(spark, d):
    return mill_tables.build_mill_table(_log(spark, d), _dim(spark), mills=MILLS, features=FEATURES, step="1 hour")


@query(f"WITH {_mill_sql()} SELECT mill, ts, {R('A')} AS \"A\", {R('B')} AS \"B\", {R('FE')} AS \"FE\" FROM mill_table")
def incremental_load(spark, d):
    """Three runs as the log grows give the table of one full build."""
    path = work_folder(spark, "mills")
    for until in ("2024-01-10", "2024-01-22 05:00:00", None):
        mill_tables.incremental_load(_log(spark, d, until), _dim(spark), path, mills=MILLS, features=FEATURES, step="1 hour", overlap="5 days")
    return spark.read.parquet(path).select("mill", "ts", *FEATURES)


@query(f"SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS ts, {R('median(value)')} AS value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-27' "
       "GROUP BY 1, 2 HAVING median(value) BETWEEN 20 AND 60")
def load_clean(spark, d):
    return mill_tables.load_clean(events(spark, d), "ts", ["value", "absent"], series_cols=["event_type"], start="2024-01-03", end="2024-01-27",
                                  freq="6 hours", bounds={"value": (20, 60)})


_COMBINED = """s0 AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2),
  g AS (SELECT g.event_type, g.ts, s0.value, row_number() OVER (PARTITION BY g.event_type ORDER BY g.ts) AS i FROM
    (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM s0 GROUP BY 1) g LEFT JOIN s0 ON s0.event_type = g.event_type AND s0.ts = g.ts),
  q AS (SELECT *, last_value(value IGNORE NULLS) OVER up AS v0, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER up AS x0,
    first_value(value IGNORE NULLS) OVER dn AS v1, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER dn AS x1 FROM g
    WINDOW up AS (PARTITION BY event_type ORDER BY ts), dn AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  f AS (SELECT event_type, ts, coalesce(value, v0 + (v1 - v0) * (i - x0) / nullif(x1 - x0, 0)::DOUBLE, v0) AS value FROM q),
  sm AS (SELECT event_type AS mill, ts, avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS value FROM f),
  lab AS (SELECT time_bucket(INTERVAL 8 HOUR, ts) + INTERVAL 6 HOUR AS ts, avg(value) AS lab FROM events WHERE event_type = 'purchase' GROUP BY 1),
  held AS (SELECT unnest(CASE WHEN nx IS NULL THEN [ts] ELSE generate_series(ts, nx - INTERVAL 1 HOUR, INTERVAL 1 HOUR) END) AS ts, lab FROM (SELECT *, lead(ts) OVER (ORDER BY ts) AS nx FROM lab))"""


@query(f"WITH {_COMBINED} SELECT mill, ts, {R('value')} AS value, {R('lab')} AS lab FROM sm JOIN held USING (ts)")
def combine_mill_and_lab(spark, d):
    """Smoothed series joined to held laboratory values, which come every eight hours."""
    e = events(spark, d)
    mill = e.select(F.col("event_type").alias("mill"), "ts", "value", "event_id")
    us = F.unix_micros("ts")
    shift = F.timestamp_micros(us - F.pmod(us, F.lit(8 * 3_600_000_000)) + F.lit(6 * 3_600_000_000))
    lab = e.filter("event_type = 'purchase'").groupBy(shift.alias("ts")).agg(F.avg("value").alias("lab"))
    return combined.combine_mill_and_lab(mill, lab, "ts", ["value"], ["lab"], step="1 hour", mill_order=["event_id"])


# --- shift reports: a sheet per month, a file per year, rows made from orders ---------------------------------------

_MONTHS = list(fixed.MONTH_NUMBERS)


def sheet_rows(spark, d):
    """Sheets with the day on its first row only, total rows, an invalid shift and decimal commas.

    The day written is the day after the order's, so month ends carry days that do not exist.
    """
    o = table(spark, d, "orders")
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    sheet = F.element_at(F.array(*[F.lit(m) for m in _MONTHS]), month)
    w = W.partitionBy(year, month).orderBy("o_orderdate", "o_orderkey")
    new_day = F.coalesce(F.lag("o_orderdate").over(w) != F.col("o_orderdate"), F.lit(True))
    n = F.col("o_orderkey") % 5
    return o.select(
        F.concat(F.lit("/landed/report_"), year, F.lit(".csv")).alias("file"), sheet.alias("sheet"), F.row_number().over(w).alias("row_no"),
        F.when(new_day, (F.dayofmonth("o_orderdate") + 1).cast("string")).alias("Дата"),
        F.when(n == 0, "Общо").otherwise(n.cast("string")).alias("Смяна"),
        F.regexp_replace(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), r"\.", ",").alias("Класа \n+15,0мм."),
        F.col("o_custkey").cast("string").alias("Грано\nдиорити"), F.col("o_orderkey").cast("string").alias("key"))


def _file_year():
    """Orders start before 2000, which the rule for file names does not cover."""
    return F.regexp_extract("file", r"(\d{4})", 1).cast("int")


_VALID = "o_orderkey % 5 BETWEEN 1 AND 3 AND month(o_orderdate + INTERVAL 1 DAY) = month(o_orderdate)"
_SHIFT = "(o_orderkey % 5)::INT"
_AT = "CASE o_orderkey % 5 WHEN 1 THEN 6 WHEN 2 THEN 14 ELSE 22 END"


@query(f"SELECT strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS date, {_SHIFT} AS shift, o_orderdate + INTERVAL 1 DAY + INTERVAL 1 HOUR * ({_AT}) AS \"TimeStamp\", "
       f"{R('o_totalprice', 2)} AS class_15, {R('o_custkey::DOUBLE', 2)} AS grano FROM orders WHERE {_VALID}", digits=2)
def assemble_shift_report(spark, d):
    report, _ = shift_reports.assemble_shift_report(sheet_rows(spark, d), year=_file_year())
    return report.select(F.col("date").cast("string").alias("date"), "shift", "TimeStamp", "class_15", "grano")


@query("SELECT year(o_orderdate)::INT AS year, (day(o_orderdate) + 1)::INT AS day, (o_orderkey % 5)::INT AS shift, 'no such day' AS reject_reason FROM orders "
       "WHERE o_orderkey % 5 BETWEEN 1 AND 3 AND month(o_orderdate + INTERVAL 1 DAY) <> month(o_orderdate)")
def shift_report_rejects(spark, d):
    _, rejected = shift_reports.assemble_shift_report(sheet_rows(spark, d), year=_file_year())
    return rejected.select(_file_year().alias("year"), "day", "shift", "reject_reason")


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 5 AS s, date_trunc('month', o_orderdate) AS m, row_number() OVER (PARTITION BY date_trunc('month', o_orderdate), o_orderkey % 5 ORDER BY o_orderdate, o_orderkey) AS n
      FROM orders WHERE o_orderkey % 5 BETWEEN 1 AND 3),
    c AS (SELECT m, least(count(*) FILTER (s = 1), count(*) FILTER (s = 2), count(*) FILTER (s = 3)) AS k FROM r GROUP BY 1)
    SELECT o_orderkey::VARCHAR AS key, s::INT AS shift, m + INTERVAL 1 DAY * (n - 1) + INTERVAL 1 HOUR * (CASE s WHEN 1 THEN 6 WHEN 2 THEN 14 ELSE 22 END) AS "TimeStamp",
      strftime(m + INTERVAL 1 DAY * (n - 1), '%d.%m.%Y') AS date_text FROM r JOIN c USING (m)
    WHERE n <= k AND n <= day(last_day(m)) AND (m <> DATE '2001-07-01' OR n <= 10)""")
def assemble_shift_ordinal(spark, d):
    """The n-th row of a shift is the n-th day; the month of the as-of date ends at its day."""
    out = shift_reports.assemble_shift_ordinal(sheet_rows(spark, d), year=_file_year(), as_of="2001-07-10")
    return out.select("key", "shift", "TimeStamp", "date_text")


@query("SELECT sheet_year AS file_year, count(*) AS n_rows, count(*) FILTER (o_orderkey % 5 = 0) AS n_totals FROM (SELECT year(o_orderdate)::INT AS sheet_year, o_orderkey FROM orders) GROUP BY 1")
def scan_sheets(spark, d):
    """Landed sheet files of several years in one scan; the year is in the file's name."""
    rows = sheet_rows(spark, d).withColumnRenamed("Класа \n+15,0мм.", "class").withColumnRenamed("Грано\nдиорити", "grano")
    folder = work_folder(spark, "sheets")
    # a folder per year stands for a file per year
    rows.withColumn("report", F.regexp_extract("file", r"(\d{4})", 1)).drop("file").write.partitionBy("report").option("header", True).csv(folder)
    landed = tables.scan_sheets(spark, f"{folder}/report=*").withColumn("file_year", F.regexp_extract("file", r"report=(\d{4})", 1).cast("int"))
    return landed.groupBy("file_year").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("Смяна") == "Общо").alias("n_totals"))


@query("SELECT year(o_orderdate)::INT AS year, o_orderkey, o_totalprice_text, CASE WHEN year(o_orderdate) >= 1998 THEN o_orderstatus END AS status FROM "
       "(SELECT *, o_orderkey::VARCHAR AS o_totalprice_text FROM orders)")
def union_sheets(spark, d):
    """Sheets with different columns under each other; a column a sheet lacks is NULL."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", F.col("o_orderkey").cast("string").alias("o_totalprice_text"),
                                         F.col("o_orderstatus").alias("status"))
    return shift_reports.union_sheets([o.filter("year >= 1998"), o.filter("year < 1998").drop("status")])


# --- streams --------------------------------------------------------------------------------------------------------

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark, d):
    return streams.read_log_stream(spark, f"{d}/events*.parquet", EVENT_SCHEMA, "ts")


def _drain(stream, spark, label):
    out, mark = work_folder(spark, label), work_folder(spark, f"{label}-progress")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query(f"SELECT event_type, date_trunc('minute', ts) AS ts, {R('avg(value)')} AS value, count(value) AS n FROM events GROUP BY 1, 2 "
       "HAVING date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 6 HOUR FROM events)")
def stream_resample(spark, d):
    """Minutes the watermark has passed; the last six hours are still open."""
    return _drain(streams.stream_resample(_stream(spark, d), ["event_type"], "ts", "value"), spark, "stream-minutes")


@query("SELECT user_id, date_trunc('hour', ts) AS ts, 1::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_dedup(spark, d):
    """Hours make duplicates; one row per user and hour leaves."""
    hourly = _stream(spark, d).select("user_id", F.date_trunc("hour", "ts").alias("ts"))
    return _drain(streams.stream_dedup(hourly, ["user_id", "ts"], "ts"), spark, "stream-dedup").groupBy("user_id", "ts").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, user_id, ts, {R('value')} AS value FROM events")
def stream_incremental(spark, d):
    """Two runs over a folder that grows: only rows newer than their user's stored maximum are appended."""
    source, path = work_folder(spark, "landing"), work_folder(spark, "stored")
    late, mark = work_folder(spark, "late"), work_folder(spark, "progress")
    e = events(spark, d).select("event_id", "user_id", "ts", "value")
    for part in (e.filter("ts < '2024-01-18'"), e.filter("ts >= '2024-01-18'")):
        part.write.mode("append").parquet(source)
        stream = streams.read_log_stream(spark, source, "event_id bigint, user_id bigint, ts timestamp, value double", "ts")
        streams.stream_incremental(stream, path, late, mark, ["user_id"], "ts").awaitTermination()
    return spark.read.parquet(path)


@query(f"SELECT event_type, ts, event_id AS seq, {R('''last_value(CASE WHEN event_id % 7 <> 0 THEN value END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id)''')} AS value FROM events")
def stream_step_fill(spark, d):
    """Missing values take the tag's last one, across batches."""
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    rows = _stream(spark, d).select("event_type", "ts", F.col("event_id").alias("seq"), value.alias("value"))
    with_store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(with_store, None)
    spark.conf.set(with_store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _drain(streams.stream_step_fill(rows, ["event_type"]), spark, "stream-fill")
    finally:
        spark.conf.set(with_store, before) if before else spark.conf.unset(with_store)


@query("WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem) "
       f"SELECT l_orderkey, l_linenumber, l_partkey, {R('i + s * l_quantity', 3)} AS prediction FROM lineitem, f", digits=3)
def stream_score(spark, d):
    """A batch-trained model scores rows as they arrive."""
    li = table(spark, d, "lineitem")
    model = M.train_linear(li, ["l_quantity"], "l_extendedprice")
    rows = spark.readStream.schema(li.schema).parquet(f"{d}/lineitem*.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return _drain(streams.stream_score(rows, model).drop("l_quantity"), spark, "stream-score")
