"""Mill tables, increments, shift reports, sinks and streams."""

import re
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.functions.columns import month_from_sheet, year_from_name
from millrace.operators.joins import join_identical_index, join_on_time, parameter_labels, tag_dimension
from millrace.operators.select import match_columns
from millrace.plans import mill_tables as MT
from millrace.plans import shift_reports as SR
from millrace.plans.combined import combine_mill_and_lab
from millrace.sources import logs, sinks
from millrace.streaming import streams

T0 = pd.Timestamp("2024-06-01")
D0 = T0.to_pydatetime()
DIM = [("Ore", "Mill01", 1), ("Ore", "Mill02", 2), ("Power", "Mill01", 3), ("Power", "Mill02", 4), ("FE", "Mill01", 9), ("FE", "Mill02", 9)]
MILLS, FEATURES = ["Mill01", "Mill02"], ["Ore", "Power", "FE"]


def sensor_log(hours=30, seed=3):
    """Irregular samples, several per minute, with a gap, and one tag that reports twice at one time."""
    rng = np.random.default_rng(seed)
    rows = []
    for tag in (1, 2, 3, 4, 9):
        at = np.sort(rng.choice(hours * 3600, hours * 90, replace=False))
        if tag == 3:
            at = at[(at < 9 * 3600) | (at > 9 * 3600 + 1500)]
        rows.append(pd.DataFrame({"ts": T0 + pd.to_timedelta(at, unit="s"), "tag_id": tag, "value": rng.normal(tag * 10, 1, len(at)).round(3)}))
    return pd.concat(rows, ignore_index=True)


def pandas_mill_table(parts):
    """The same steps on one machine."""
    frames = {}
    for feature in FEATURES:
        tags = {t: m for f, m, t in DIM if f == feature}
        made = []
        for part in parts:
            rows = part[part["tag_id"].isin(tags)].drop_duplicates(["ts", "tag_id"], keep="last")
            wide = rows.pivot(index="ts", columns="tag_id", values="value").ffill().bfill().resample("1min").mean()
            made.append(wide)
        df = pd.concat(made).sort_index(kind="stable")
        df = df[~df.index.duplicated(keep="first")].shift(2, freq="h").ffill().bfill()
        frames[feature] = df
    out = []
    for mill in MILLS:
        cols = {}
        for feature in FEATURES:
            tag = next(t for f, m, t in DIM if f == feature and m == mill)
            cols[feature] = frames[feature][tag]
        out.append(pd.concat(cols, axis=1, join="inner").assign(mill=mill).reset_index(names="ts"))
    return pd.concat(out).sort_values(["mill", "ts"]).reset_index(drop=True)


def dim(spark):
    return spark.createDataFrame(DIM, "feature string, mill string, tag_id int")


def test_mill_table_of_two_sources(spark):
    log = sensor_log(12)
    live, archive = log[log["ts"] >= T0 + pd.Timedelta("5h")], log[log["ts"] < T0 + pd.Timedelta("7h")].copy()
    archive["value"] += 0.5
    parts = [spark.createDataFrame(p).withColumn("src_priority", F.lit(k)) for k, p in enumerate((live, archive))]
    both = parts[0].unionByName(parts[1]).repartition(9)
    for chunk in ("53 minutes", "1 day"):
        got = MT.build_mill_table(both, dim(spark), mills=MILLS, features=FEATURES, chunk=chunk).toPandas().sort_values(["mill", "ts"]).reset_index(drop=True)
        want = pandas_mill_table([live, archive])
        assert len(got) == len(want) and (got["ts"] == want["ts"]).all()
        np.testing.assert_allclose(got[FEATURES], want[FEATURES], rtol=1e-9)


def test_increments_equal_one_build(spark, tmp_path):
    log = spark.createDataFrame(sensor_log(30)).repartition(4)
    path = str(tmp_path / "mills")
    for until in ("2024-06-01 06:30:00", "2024-06-01 19:00:00", "2024-06-01 19:00:00", "2024-06-03"):
        MT.incremental_load(log.filter(F.col("ts") < until), dim(spark), path, mills=MILLS, features=FEATURES)
    got = spark.read.parquet(path).toPandas().sort_values(["mill", "ts"]).reset_index(drop=True)
    want = MT.build_mill_table(log, dim(spark), mills=MILLS, features=FEATURES).toPandas().sort_values(["mill", "ts"]).reset_index(drop=True)
    assert len(got) == len(want) and not got.duplicated(["mill", "ts"]).any()
    np.testing.assert_allclose(got[FEATURES], want[FEATURES], rtol=1e-9)


def test_increments_do_not_read_old_months(spark, tmp_path):
    """A mill that stopped in May does not widen what is read of the others, and months before a mark are not read at all."""
    log = sensor_log(60)
    old = log.copy()
    old["ts"] = old["ts"] - pd.Timedelta("31 days")
    stopped = set(dim(spark).filter("mill = 'Mill02' AND feature <> 'FE'").toPandas()["tag_id"])
    whole = pd.concat([old, log[~log["tag_id"].isin(stopped)]])
    path, settings = tmp_path / "mills", {"mills": MILLS, "features": FEATURES}
    df = spark.createDataFrame(whole).repartition(4)
    MT.incremental_load(df.filter("ts < '2024-06-01 20:00:00'"), dim(spark), str(path), **settings)
    limits = {r["mill"]: r["max_ts"] for r in sinks.stored_limits(spark, str(path), ["mill"], "ts").collect()}
    assert limits == {r["mill"]: r["m"] for r in spark.read.parquet(str(path)).groupBy("mill").agg(F.max("ts").alias("m")).collect()}
    months = {m.name for m in (path / "mill=Mill01").iterdir()}
    assert "month=2024-06" in months and len(months) > 1
    stored = spark.read.parquet(str(path))
    beyond = sinks.stored_since(stored, sinks.known_marks(spark, str(path), ["mill"]), ["mill"], "ts")
    assert beyond.count() == 0
    scan = next(x for x in beyond._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in x)
    filters = scan[scan.index("PartitionFilters"):]
    assert re.search(r"month#\d+ >= 2024-06", filters) and "Mill01" in filters
    # each mill from the month of its own mark on: one that stopped in January does not open January for the other
    marks = spark.createDataFrame([("Mill01", D0 + timedelta(hours=8)), ("Mill02", D0 - timedelta(days=150))], "mill string, max_ts timestamp")
    apart = sinks.stored_since(stored, marks, ["mill"], "ts")
    got = {(r["mill"], r["month"]) for r in apart.select("mill", "month").distinct().collect()}
    assert {m for k, m in got if k == "Mill01"} == {"2024-06"} and {m for k, m in got if k == "Mill02"} == {p.name[6:] for p in (path / "mill=Mill02").iterdir()}
    spark.createDataFrame([("x",)], "bad string").coalesce(1).write.text(str(tmp_path / "junk"))
    for month in months - {"month=2024-06"}:  # a file that cannot be read lies in every older month, and nobody opens it
        junk = next((tmp_path / "junk").glob("part-*.txt"))
        (path / "mill=Mill01" / month / "part-99999-junk.parquet").write_bytes(junk.read_bytes())
    assert apart.sparkSession.read.schema(stored.schema).parquet(str(path)).transform(lambda t: sinks.stored_since(t, marks, ["mill"], "ts")).count() == apart.count()
    for month in months - {"month=2024-06"}:
        (path / "mill=Mill01" / month / "part-99999-junk.parquet").unlink()
    MT.incremental_load(df, dim(spark), str(path), **settings)
    got = spark.read.parquet(str(path)).filter("mill = 'Mill01' AND month = '2024-06'").toPandas()
    assert got["ts"].max() > pd.Timestamp("2024-06-02") and not got.duplicated("ts").any()
    since = MT.log_since(df, dim(spark), {"Mill01": pd.Timestamp("2024-06-02"), "Mill02": pd.Timestamp("2024-05-01")}, "6 hours")
    shared = {r["tag_id"] for r in dim(spark).filter("feature = 'FE'").collect()}
    assert {r["tag_id"] for r in since.filter("ts < '2024-06-01 12:00:00'").select("tag_id").distinct().collect()} <= stopped | shared


def test_a_run_that_did_not_note_its_marks(spark, tmp_path):
    rows = [("a", "2024-05-30 10:00:00", 1), ("b", "2024-06-01 00:00:00", 2)]
    table = lambda rows: spark.createDataFrame(rows, "mill string, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "t")
    sinks.write_append_new(table(rows), path, ["mill"], "ts")
    # rows beyond the marks, and a series that has none
    table([("a", "2024-05-31 10:00:00", 3), ("c", "2024-01-01 00:00:00", 4)]).write.mode("append").partitionBy("mill").parquet(path)
    sinks.write_append_new(table([("a", "2024-05-31 10:00:00", 5), ("a", "2024-05-31 11:00:00", 6), ("c", "2023-12-31 00:00:00", 7), ("c", "2024-01-02 00:00:00", 8),
                            ("b", "2024-06-01 00:00:00", 9), ("d", "2020-01-01 00:00:00", 10)]), path, ["mill"], "ts")
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 6, 8, 10]
    sinks.write_append_new(table(rows), path, ["mill"], "ts")
    assert spark.read.parquet(path).count() == 7
    assert not sinks.path_has_data(spark, str(tmp_path / "nowhere")) and not sinks.path_has_data(spark, str(tmp_path / "t" / "mill=a" / "nothing"))


def test_one_sample_per_time_of_a_feature(spark):
    rows = [("2024-06-01 00:00:10", 1, 5.0), ("2024-06-01 00:00:10", 2, 7.0), ("2024-06-01 00:00:40", 1, 6.0), ("2024-06-01 00:01:20", 2, 9.0)]
    log = spark.createDataFrame(rows, "ts string, tag_id int, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    ore = dim(spark).filter("feature = 'Ore'")
    by_tag = MT.compose_features(log, ore, MILLS).orderBy("ts").collect()
    assert (by_tag[0]["Mill01"], by_tag[0]["Mill02"]) == (5.5, 7.0)
    by_time = MT.compose_features(log, ore, MILLS, dedup_keys=("ts",)).orderBy("ts").collect()
    assert (by_time[0]["Mill01"], by_time[0]["Mill02"]) == (6.0, 7.0)
    assert by_time[0]["ts"] == pd.Timestamp("2024-06-01 02:00:00")


def test_tag_dimension(spark):
    d = tag_dimension(spark)
    assert d.count() == 13 * 12 and d.filter("feature = 'FE'").select("tag_id").distinct().count() == 1
    assert parameter_labels(spark).count() == 15 and set(fixed.SUMMARY_FEATURES) <= set(fixed.FEATURE_TAGS)


def test_combined_ends_with_the_laboratory_or_holds(spark):
    mill = spark.createDataFrame(pd.DataFrame({"mill": "m", "ts": pd.date_range(T0, periods=300, freq="min"), "Ore": np.arange(300.0)}))
    lab = spark.createDataFrame(pd.DataFrame({"ts": [T0 + pd.Timedelta(minutes=m) for m in (30, 150)], "Shisti": [1.0, 2.0]}))
    cut = combine_mill_and_lab(mill, lab, "ts", ["Ore"], ["Shisti"])
    assert cut.count() == 121 and cut.filter("Shisti = 2.0").count() == 1
    held = combine_mill_and_lab(mill, lab, "ts", ["Ore"], ["Shisti"], hold_past_end=True)
    assert held.count() == 270 and held.filter("Shisti = 2.0").count() == 150


def test_join_checks(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "ts int, a string")
    b = spark.createDataFrame([(3, "z")], "ts int, b string")
    with pytest.raises(ValueError, match="no common"):
        join_on_time(a, b, ["ts"], check=True)
    with pytest.raises(ValueError, match="duplicate"):
        join_on_time(a, b.union(b).union(a), ["ts"], check=True)
    with pytest.raises(ValueError, match="different"):
        join_identical_index(a, b, ["ts"])


SHEETS = [
    # file, sheet, row, day, shift, class 15, dikes
    ("/x/Report_2024.csv", "Февруари", 1, "29", "1", "1,5", "2"), ("/x/Report_2024.csv", "Февруари", 2, None, "2", "bad", "3"),
    ("/x/Report_2024.csv", "Февруари", 3, None, "Общо", "9", "9"), ("/x/Report_2024.csv", "Февруари", 4, "30", "1", "1", "1"),
    ("/x/Report_2024.csv", "Февруари", 5, "x", "3", "4", None), ("/x/Report_2024.csv", "Февруари", 6, "1", "4", "4", "4"),
    ("/x/Report_2024.csv", "Март", 1, None, "1", "7", "7"), ("/x/Report_2024.csv", "Март", 2, "5.0", "3.0", "7.25", "8"),
    ("/x/Report.csv", "Март", 1, "1", "1", "1", "1"), ("/x/Report_2024.csv", "Sheet9", 1, "1", "1", "1", "1"),
]


def sheets(spark):
    return spark.createDataFrame(SHEETS, "file string, sheet string, row_no int, `Дата` string, `Смяна` string, `Класа \n+15,0мм.` string, `Дайки` string").repartition(5)


def test_shift_report_rules(spark):
    report, rejected = SR.assemble_shift_report(sheets(spark))
    got = [(str(r["date"]), r["shift"], str(r["TimeStamp"]), r["class_15"], r["daiki"], r["grano"]) for r in report.orderBy("date", "shift").collect()]
    assert got == [
        ("2024-02-29", 1, "2024-02-29 06:00:00", 1.5, 2.0, None), ("2024-02-29", 2, "2024-02-29 14:00:00", None, 3.0, None),
        ("2024-03-05", 3, "2024-03-05 22:00:00", 7.25, 8.0, None)]
    why = sorted((r["sheet"], r["row_no"], r["reject_reason"]) for r in rejected.collect())
    assert why == [("Sheet9", 1, "unknown month"), ("Март", 1, "unknown year"), ("Февруари", 4, "no such day"), ("Февруари", 5, "no such day")]


def test_shift_ordinal_rules(spark):
    rows = [("/x/R_2024.csv", "Февруари", n, None, s, "1", "1") for n, s in enumerate(["1", "2", "3", "Общо", "1", "2", "3", "1", "3"], start=1)]
    rows += [("/x/R_2024.csv", "3", n, None, s, "1", "1") for n, s in enumerate(["1", "2", "3"] * 40, start=1)]
    df = spark.createDataFrame(rows, sheets(spark).schema)
    out = SR.assemble_shift_ordinal(df, as_of="2024-02-02")
    feb = sorted((r["date_text"], r["shift"], r["row_no"]) for r in out.filter("OriginalSheet = 'Февруари'").collect())
    assert feb == [("01.02.2024", 1, 1), ("01.02.2024", 2, 2), ("01.02.2024", 3, 3), ("02.02.2024", 1, 5), ("02.02.2024", 2, 6), ("02.02.2024", 3, 7)]
    assert out.filter("OriginalSheet = '3'").count() == 93
    assert SR.assemble_shift_ordinal(df, as_of="2024-02-01").filter("OriginalSheet = 'Февруари'").count() == 3


def test_names(spark):
    df = spark.createDataFrame([("/a/2019/b_2024.csv", "Юни"), ("plain.csv", "15"), ("x2099y2001", "zero")], "p string, s string")
    got = df.select(year_from_name("p").alias("y"), month_from_sheet("s").alias("m"), month_from_sheet("s", True).alias("n")).collect()
    assert [tuple(r) for r in got] == [(2024, 6, 6), (None, None, 12), (2099, None, 1)]
    assert match_columns(["A +12", "Класа +15", "b +12,5 +15", "ШИСТИ"]) == {"class_12": "A +12", "class_15": "b +12,5 +15", "shisti": "ШИСТИ"}


def test_append_and_typed_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", D0, 1.0), ("b", D0, 1.0)], "mill string, ts timestamp, v double")
    later = D0 + timedelta(minutes=1)
    second = spark.createDataFrame([("a", D0, 5.0), ("a", later, 2.0), ("c", D0, 3.0)], "mill string, ts timestamp, v double")
    sinks.write_append_new(first, path, ["mill"], "ts")
    sinks.write_append_new(second, path, ["mill"], "ts")
    assert sorted((r["mill"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1.0), ("a", 2.0), ("b", 1.0), ("c", 3.0)]
    text = spark.createDataFrame([("2024-01-05", "1", "2024-01-05 06:00:00", "1,5"), ("2024-02-30", "2", "x", "2"), ("2024-01-05", "Общо", "2024-01-05 06:00:00", "1")],
                                 "Date string, Shift string, TimeStamp string, Class_15 string")
    schema = type(sinks.ORE_QUALITY_SCHEMA)([f for f in sinks.ORE_QUALITY_SCHEMA.fields if f.name in text.columns])
    good, bad = sinks.typed_rows(text, schema)
    assert [tuple(map(str, r)) for r in good.collect()] == [("2024-01-05", "1", "2024-01-05 06:00:00", "1.5")]
    assert sorted(tuple(r["unreadable"]) for r in bad.collect()) == [("Date", "TimeStamp"), ("Shift",)]


def test_scan_filters_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame(sensor_log(3)).select(F.col("ts").alias("IndexTime"), F.col("tag_id").alias("LoggerTagID"), F.col("value").alias("Value"),
                                                F.lit("x").alias("unused")).write.parquet(path)
    df = logs.scan_log(spark.read.parquet(path), [1, 3], since="2024-06-01 01:00:00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(IndexTime" in plan and "In(LoggerTagID" in plan and "unused" not in plan
    assert df.filter("ts <= '2024-06-01 01:00:00' or tag_id not in (1, 3)").count() == 0


def test_stream_keeps_late_rows_aside(spark, tmp_path):
    source, path, late, mark = (str(tmp_path / n) for n in ("in", "out", "late", "mark"))
    schema = "tag string, ts timestamp, value double"
    for batch in ([("a", D0, 1.0), ("b", D0, 1.0)], [("a", D0 - timedelta(hours=1), 9.0), ("a", D0 + timedelta(hours=1), 2.0), ("c", D0, 4.0)], []):
        if batch:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_log_stream(spark, source, schema, "ts")
        streams.stream_incremental(stream, path, late, mark, ["tag"], "ts").awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(path).collect()) == [1.0, 1.0, 2.0, 4.0]
    assert [r["value"] for r in spark.read.parquet(late).collect()] == [9.0]


def test_stream_fill_across_batches(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "tag string, ts timestamp, seq bigint, value double"
    minute = timedelta(minutes=1)
    batches = [[("a", D0, 1, 5.0), ("a", D0 + minute, 2, None), ("b", D0, 3, None)], [("a", D0 + 2 * minute, 4, None), ("b", D0 + minute, 5, 7.0), ("b", D0 + 2 * minute, 6, None)],
               # a late value and rows on both sides of the held one
               [("b", D0 + timedelta(seconds=30), 7, 1.0), ("b", D0 + timedelta(seconds=40), 8, None), ("b", D0 + 3 * minute, 9, None)]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        filled = streams.stream_step_fill(spark.readStream.schema(schema).parquet(source), ["tag"])
        filled.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    got = {r["seq"]: r["value"] for r in spark.read.parquet(out).collect()}
    assert got == {1: 5.0, 2: 5.0, 3: None, 4: 5.0, 5: 7.0, 6: 7.0, 7: 1.0, 8: 1.0, 9: 7.0}


def test_stream_fill_in_time_order(spark, tmp_path):
    """Rows leave when the watermark has passed them: out of order within a batch and across batches, a backlog at once, and rows that are too late."""
    schema = "tag string, ts timestamp, seq bigint, value double"
    rng = np.random.default_rng(5)
    rows = []
    for tag in ("a", "b"):
        for i in range(240):  # one every ten seconds
            rows.append((tag, D0 + timedelta(seconds=10 * i), len(rows), None if rng.random() < 0.7 else float(i)))
    moved = [rows[i] for i in sorted(range(len(rows)), key=lambda i: rows[i][1] + timedelta(seconds=float(rng.uniform(0, 150))))]
    end = max(r[1] for r in rows)

    def run(name, batches, **options):
        source, out, mark = (str(tmp_path / f"{name}-{n}") for n in ("in", "out", "mark"))
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
            filled = streams.stream_step_fill(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), ["tag"], late="3 minutes", **options)
            filled.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).toPandas()

    whole = pd.DataFrame(rows, columns=["tag", "ts", "seq", "value"]).sort_values(["tag", "ts"])
    whole["value"] = whole.groupby("tag")["value"].ffill()
    due = whole[whole["ts"] < pd.Timestamp(end - timedelta(minutes=3)).floor("1min")]
    stale = [("a", D0 - timedelta(hours=1), 9001, 77.0), ("b", D0, 9002, 88.0)]
    thirds = [moved[:160], moved[160:320], moved[320:], [*stale, ("c", end, 9003, 1.0)]]
    for name, batches in (("one", [moved, [("c", end, 9003, 1.0)]]), ("many", thirds)):
        got = run(name, batches).sort_values(["tag", "ts"]).reset_index(drop=True)
        assert list(got["seq"]) == list(due["seq"])
        np.testing.assert_allclose(got["value"].to_numpy(dtype=float), due["value"].to_numpy(dtype=float))
    with pytest.raises(ValueError, match="late or ttl"):
        streams.stream_step_fill(spark.createDataFrame(rows[:1], schema), ["tag"], ttl_ms=5, late="1 minute")


def test_a_replayed_batch_leaves_no_late_rows(spark, tmp_path):
    path, late = str(tmp_path / "out"), str(tmp_path / "late")
    write = streams.insert_only_newer(path, late, ["tag"], "ts")
    schema = "tag string, ts timestamp, value double"
    first = spark.createDataFrame([("a", D0, 1.0), ("b", D0 + timedelta(hours=2), None)], schema)
    second = spark.createDataFrame([("a", D0 + timedelta(hours=1), 2.0), ("b", D0 + timedelta(hours=1), 3.0), ("a", D0 - timedelta(hours=3), 4.0)], schema)
    write(first, 0)
    for _ in range(2):
        write(second, 1)
    assert sorted(str(r["value"]) for r in spark.read.parquet(path).collect()) == ["1.0", "2.0", "None"]
    assert {r["value"] for r in spark.read.parquet(late).collect()} == {3.0, 4.0}
