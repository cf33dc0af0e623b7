"""Sources, sinks, projections, filters, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import fixed_values as fixed
from millrace.functions.columns import month_from_sheet, year_from_name
from millrace.operators import dedup as D
from millrace.operators import select as S
from millrace.plans.catalogue.base import (
    HT, HU, TYPES, W, R, events, hourly_by_type, hourly_by_user, lineitem, query, table, wide, work_folder,
)
from millrace.session import cut_lineage
from millrace.sources import logs, sinks, tables

LOG = {"time_col": "ts", "tag_col": "event_type", "value_col": "value", "extra": ["event_id"]}


@query("SELECT ts, event_type AS tag_id, " + R("value") + """ AS value, event_id FROM events
        WHERE event_type IN ('view', 'click') AND ts > TIMESTAMP '2024-01-10 00:00:00'""")
def scan_log(spark, d):
    return logs.scan_log(table(spark, d, "events"), ["view", "click"], since="2024-01-10 00:00:00", **LOG)


@query("SELECT ts, event_type AS tag_id, " + R("value") + """ AS value, event_id FROM events
        WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""")
def scan_log_recent(spark, d):
    return logs.scan_log(table(spark, d, "events"), as_of="2024-01-31 00:00:00", **LOG)


@query("SELECT ts, event_type AS tag_id, " + R("value") + """ AS value, event_id, src_priority FROM (
          SELECT *, 0 AS src_priority FROM events WHERE ts >= TIMESTAMP '2024-01-15'
          UNION ALL SELECT *, 1 AS src_priority FROM events WHERE ts < TIMESTAMP '2024-01-20')""")
def scan_log_archives(spark, d):
    e = table(spark, d, "events")
    live, archive = e.filter("ts >= '2024-01-15'"), e.filter("ts < '2024-01-20'")
    return logs.scan_log_archives([live, archive], whole=True, **LOG)


@query("SELECT event_id, ts, event_type, " + R("value") + """ AS value FROM events WHERE event_type = 'view'
        AND ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-19 18:30:00'""")
def scan_series_range(spark, d):
    e = events(spark, d).select("event_id", "ts", "event_type", "value")
    return logs.scan_series_range(e, "ts", "2024-01-05 06:00:00", "2024-01-19 18:30:00", series={"event_type": "view"})


@query("SELECT o_orderkey, " + R("o_totalprice", 2) + " AS o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'", digits=2)
def scan_table(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return tables.scan_table(spark, "orders", ["o_orderkey", "o_totalprice"], "o_totalprice > 100000 AND o_orderstatus = 'F'")


@query("SELECT o_orderstatus, count(*) AS n, " + R("avg(o_totalprice)", 2) + " AS mean_price FROM orders GROUP BY 1", digits=2)
def run_sql(spark, d):
    return tables.run_sql(spark, "SELECT o_orderstatus, count(*) AS n, avg(o_totalprice) AS mean_price FROM run_sql_orders GROUP BY 1",
                          run_sql_orders=table(spark, d, "orders"))


@query("""SELECT 'events' AS table_name, count(*) AS n_rows, max(ts) AS max_ts, 6 AS n_columns FROM events
          UNION ALL SELECT 'lineitem', count(*), NULL, 11 FROM lineitem
          UNION ALL SELECT 'orders', count(*), NULL, 6 FROM orders""")
def catalog_profile(spark, d):
    names = ["events", "lineitem", "orders"]
    for n in names:
        table(spark, d, n).createOrReplaceTempView(n)
    return tables.catalog_profile(spark, names, "ts").select("table_name", "n_rows", "max_ts", F.size("columns").alias("n_columns"))


@query("SELECT event_id, ts, event_type, " + R("value") + " AS value FROM events")
def scan_csv_series(spark, d):
    path = work_folder(spark, "csv")
    sinks.write_csv(events(spark, d).select("event_id", "ts", "event_type", "value"), path)
    return logs.scan_csv_series(spark, path, "event_id bigint, ts timestamp, event_type string, value double")


@query("SELECT event_type, ts, " + R("value", 4) + f" AS value FROM (WITH {HT} SELECT * FROM ht)", digits=4)
def write_csv(spark, d):
    path = work_folder(spark, "results")
    sinks.write_csv(hourly_by_type(spark, d), path)
    return logs.scan_csv_series(spark, path, "event_type string, ts timestamp, value double")


@query("SELECT user_id, ts, " + R("value") + f" AS value FROM (WITH {HU} SELECT * FROM hu)")
def write_replace(spark, d):
    path = work_folder(spark, "replace")
    h = hourly_by_user(spark, d)
    sinks.write_replace(h.limit(0), path, ["user_id"])
    sinks.write_replace(h, path, [])
    return spark.read.parquet(path)


@query("SELECT event_type, ts, " + R("value") + f" AS value FROM (WITH {HT} SELECT * FROM ht)")
def write_append_new(spark, d):
    """A table filled up to a date and then appended to equals the table written at once."""
    path = work_folder(spark, "append")
    h = hourly_by_type(spark, d)
    sinks.write_append_new(h.filter("ts < '2024-01-12 07:00:00'"), path, ["event_type"], "ts", ["event_type"])
    sinks.write_append_new(h, path, ["event_type"], "ts", ["event_type"])
    return spark.read.parquet(path).select("event_type", "ts", "value")


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS "Date", (o_orderkey % 5)::INT AS "Shift", o_orderdate AS "TimeStamp",
          """ + R("o_totalprice", 2) + """ AS "Class_15" FROM orders WHERE o_orderkey % 5 > 0""", digits=2)
def write_typed(spark, d):
    """Text cells become typed; rows whose shift cannot be read go to the rejected table."""
    o = table(spark, d, "orders")
    n = F.col("o_orderkey") % 5
    text = o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.when(n == 0, "Общо").otherwise(n.cast("string")).alias("Shift"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("TimeStamp"),
        F.regexp_replace(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), r"\.", ",").alias("Class_15"))
    schema = T.StructType([f for f in sinks.ORE_QUALITY_SCHEMA.fields if f.name in text.columns])
    good, bad = work_folder(spark, "typed"), work_folder(spark, "rejected")
    sinks.write_typed(text, good, bad, schema)
    return spark.read.parquet(good).withColumn("Date", F.col("Date").cast("string"))


@query("SELECT user_id, count(*) AS n_before, 0::BIGINT AS n_after FROM events GROUP BY 1")
def truncate_tables(spark, d):
    """A named table is emptied and keeps its schema."""
    e = events(spark, d).select("user_id", "value")
    path = work_folder(spark, "truncate")
    spark.sql("DROP TABLE IF EXISTS millrace_truncated")
    e.write.option("path", path).saveAsTable("millrace_truncated")
    counted = spark.table("millrace_truncated").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_before"))
    before = cut_lineage(counted)
    sinks.truncate_tables(spark, ["millrace_truncated"])
    after = spark.table("millrace_truncated").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return before.join(after, "user_id", "left").select("user_id", "n_before", F.coalesce("n", F.lit(0)).cast("long").alias("n_after"))


# --- projections and filters ----------------------------------------------------------------------------------------


@query("SELECT l_tax, l_quantity FROM (SELECT " + R("l_tax") + " AS l_tax, " + R("l_quantity") + " AS l_quantity FROM lineitem)")
def select_existing(spark, d):
    return S.select_existing(lineitem(spark, d), ["l_tax", "no_such_column", "l_quantity"])


@query("SELECT l_linenumber, l_suppkey, " + ", ".join(R(c) + f" AS {c}" for c in ["l_quantity", "l_extendedprice", "l_discount"]) + " FROM lineitem")
def select_numeric(spark, d):
    return S.select_numeric(lineitem(spark, d), ["l_tax", "l_orderkey", "l_partkey"])


@query("SELECT p_partkey AS part, p_size AS size, " + R("p_retailprice") + " AS price FROM part")
def rename_columns(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return S.rename_columns(p, {"p_partkey": "part", "p_size": "size", "p_retailprice": "price"})


@query("SELECT p_partkey AS part, " + R("p_retailprice") + " AS price FROM part")
def rename_normalized(spark, d):
    """Headers with line breaks are matched by their plain text; the unmatched column goes."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias(" Key\n of part "), F.col("p_retailprice").alias("Price\r\n"), "p_size")
    return S.rename_normalized(p, {"Key of part": "part", "Price": "price"})


@query("""SELECT l_orderkey, l_linenumber, l_quantity::VARCHAR::DOUBLE::INT AS class_15, l_suppkey::INT AS class_12, l_partkey::INT AS grano,
          NULL::INT AS daiki, NULL::INT AS shisti FROM lineitem""")
def match_columns_fuzzy(spark, d):
    """Headers are recognised by ordered substring rules; absent measures are NULL."""
    li = lineitem(spark, d).select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("Класа \n+15,0мм."), F.col("l_suppkey").alias("Класа +12"),
        F.col("l_partkey").alias("Грано\nдиорити"), "l_tax")
    out = S.match_columns_fuzzy(li, ["l_orderkey", "l_linenumber"])
    return out.withColumns({c: F.col(c).cast("int") for c in ["class_15", "class_12", "grano", "daiki", "shisti"]})


@query("SELECT o_orderdate AS ts, o_orderkey, o_orderstatus FROM orders")
def reorder_columns(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").alias("ts"))
    return S.drop_columns(S.reorder_columns(o, ["ts"]), ["o_totalprice"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN NULL ELSE " + R("l_discount") + " END AS l_discount FROM lineitem")
def to_numeric(spark, d):
    """Decimal commas are read, other text is NULL."""
    text = F.when(F.col("l_returnflag") == "A", "n/a").otherwise(F.regexp_replace(F.col("l_discount").cast("string"), r"\.", ","))
    li = lineitem(spark, d).select("l_orderkey", "l_linenumber", text.alias("l_discount"))
    return S.to_numeric(li, ["l_discount"])


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-21 12:00:00'")
def filter_time_range(spark, d):
    return S.filter_time_range(events(spark, d).select("event_id", "ts"), "ts", "2024-01-08", "2024-01-21 12:00:00")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 AND l_discount BETWEEN 0.02 AND 0.08")
def filter_bounds(spark, d):
    return S.filter_bounds(lineitem(spark, d), {"l_quantity": (10, 40), "l_discount": (0.02, 0.08), "absent": (0, 1)}).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity < 40 AND l_tax > 0.02")
def filter_bounds_strict(spark, d):
    return S.filter_bounds_strict(lineitem(spark, d), {"l_quantity": (10, 40), "l_tax": (0.02, None)}).select("l_orderkey", "l_linenumber")


_INSIDE = "l_quantity BETWEEN 10 AND 40 AND l_discount BETWEEN 0.02 AND 0.08"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN {_INSIDE} THEN {R('l_quantity')} END AS l_quantity, "
       f"CASE WHEN {_INSIDE} THEN {R('l_discount')} END AS l_discount FROM lineitem")
def mask_bounds(spark, d):
    li = lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return S.mask_bounds(li, {"l_quantity": (10, 40), "l_discount": (0.02, 0.08)})


@query(f"WITH {W} SELECT 'any' AS how, count(*) AS n FROM w WHERE click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL "
       "AND signup IS NOT NULL AND view IS NOT NULL "
       "UNION ALL SELECT 'subset', count(*) FROM w WHERE click IS NOT NULL AND view IS NOT NULL "
       "UNION ALL SELECT 'all', count(*) FROM w WHERE coalesce(click, error, purchase, signup, view) IS NOT NULL")
def drop_nulls(spark, d):
    w = wide(spark, d)
    kinds = [("any", S.drop_nulls(w, "any")), ("subset", S.drop_nulls(w, "any", ["click", "view"])), ("all", S.drop_nulls(w, "all", TYPES))]
    out = None
    for how, part in kinds:
        row = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(how).alias("how"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _shift_text():
    return F.when(F.col("o_orderkey") % 5 == 4, "Общо за деня").otherwise((F.col("o_orderkey") % 5).cast("string"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 4")
def drop_total_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", _shift_text().alias("Смяна"))
    return S.drop_total_rows(o).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 2, 3) THEN (o_orderkey % 5)::INT END AS shift FROM orders")
def valid_shift(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.valid_shift(_shift_text()).alias("shift"))


_MONTHS = list(fixed.MONTH_NUMBERS)


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE month(o_orderdate)::INT END AS month "
       "FROM orders WHERE year(o_orderdate) >= 2000 UNION ALL SELECT o_orderkey, NULL, CASE WHEN o_orderkey % 7 = 0 THEN NULL "
       "ELSE month(o_orderdate)::INT END FROM orders WHERE year(o_orderdate) < 2000")
def year_and_month(spark, d):
    """Year from a file name, month from a sheet name; unknown ones are NULL."""
    names = F.element_at(F.array(*[F.lit(m) for m in _MONTHS]), F.month("o_orderdate"))
    o = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("/data/2031/report_"), F.year("o_orderdate"), F.lit(".csv")).alias("file"),
        F.when(F.col("o_orderkey") % 7 == 0, "Sheet1").otherwise(names).alias("sheet"))
    return o.select("o_orderkey", year_from_name("file").alias("year"), month_from_sheet("sheet").alias("month"))


# --- dedup, top-k, sampling -----------------------------------------------------------------------------------------

_KEYED = "SELECT user_id, event_type, event_id, {v} AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {o}, event_id {o}) AS r FROM events) WHERE r = 1"


@query(_KEYED.format(v=R("value"), o="DESC"))
def dedup_keep_last(spark, d):
    return D.dedup_keep_last(events(spark, d).select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(_KEYED.format(v=R("value"), o="ASC"))
def dedup_keep_first(spark, d):
    return D.dedup_keep_first(events(spark, d).select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT m AS month, s AS shift, o_orderkey FROM (SELECT month(o_orderdate)::INT AS m, (o_orderkey % 3 + 1)::INT AS s, o_orderkey, "
       "row_number() OVER (PARTITION BY month(o_orderdate), o_orderkey % 3 ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_per_group(spark, d):
    o = table(spark, d, "orders").select(
        F.month("o_orderdate").alias("month"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("shift"), "o_orderkey", "o_orderdate")
    return D.first_per_group(o, ["month", "shift"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT o_orderdate, o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey")
def sort_rows(spark, d):
    return D.sort_rows(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), "o_orderdate", "o_orderkey")


@query("SELECT event_id, " + R("value") + " AS value FROM events ORDER BY value DESC, event_id LIMIT 10")
def top_k(spark, d):
    return D.top_k(events(spark, d).select("event_id", "value"), 10, [F.col("value").desc(), "event_id"])


@query("SELECT event_type, event_id, " + R("value") + " AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5")
def top_k_per_group(spark, d):
    return D.top_k(events(spark, d).select("event_type", "event_id", "value"), 5, [F.col("value").desc(), "event_id"], by=["event_type"])


@query("SELECT event_id, ts FROM events ORDER BY sha256(concat_ws('|', event_id::VARCHAR, '42')), event_id LIMIT 200")
def sample_ordered(spark, d):
    return D.sample_ordered(events(spark, d).select("event_id", "ts"), 200, ["event_id"], "ts", seed=42)
