"""Order-dependent operators against pandas, whatever the chunk length, partitioning and input order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.columns import unordered_mean
from millrace.operators import grid as G
from millrace.operators import windows as V
from millrace.operators.chunks import grid_chunk, prefix_sums, row_index
from millrace.operators.joins import asof_join
from millrace.operators.peaks import find_peaks
from millrace.plans.catalogue import QUERIES


def sample(n=400, gaps=0.4, seed=1, irregular=False):
    rng = np.random.default_rng(seed)
    frames = []
    for key, size in (("hot", n), ("cold", 37), ("one", 1)):
        minutes = np.sort(rng.choice(size * 5, size, replace=False)) if irregular else np.arange(size)
        v = rng.normal(50, 10, size).round(3)
        v[rng.random(size) < gaps] = np.nan
        frames.append(pd.DataFrame({"k": key, "ts": pd.Timestamp("2024-03-01") + pd.to_timedelta(minutes, unit="min"), "v": v}))
    return pd.concat(frames, ignore_index=True)


def frame(spark, pdf, partitions=5):
    shuffled = pdf.sample(frac=1.0, random_state=7)
    df = spark.createDataFrame(shuffled).repartition(partitions)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def back(df, cols=("k", "ts")):
    return df.toPandas().sort_values(list(cols)).reset_index(drop=True)


CHUNKS = ["11 minutes", "1 hour", "30 days"]


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("method", ["ffill", "bfill", "both", "linear", "time"])
def test_fill(spark, chunk, method):
    pdf = sample(irregular=method in ("linear", "time"))
    got = back(G.fill_gaps(frame(spark, pdf), ["k"], "ts", ["v"], method, chunk=chunk, leading="null" if method in ("linear", "time") else "bfill"))
    want = []
    for _, g in pdf.groupby("k", sort=True):
        s = g.sort_values("ts").set_index("ts")["v"]
        want.append({"ffill": s.ffill, "bfill": s.bfill, "both": lambda: s.ffill().bfill(), "linear": lambda: s.interpolate("linear"),
                     "time": lambda: s.interpolate("time")}[method]().to_numpy())
    np.testing.assert_allclose(got["v"].to_numpy(dtype=float), np.concatenate(want), rtol=1e-9)


def test_all_null_and_constant(spark):
    pdf = pd.DataFrame({"k": "a", "ts": pd.date_range("2024-01-01", periods=50, freq="min"), "v": np.nan})
    df = frame(spark, pdf)
    assert G.fill_gaps(df, ["k"], "ts", ["v"], "both", chunk="7 minutes").filter("v is not null").count() == 0
    flat = df.withColumn("v", F.lit(4.0))
    z = V.rolling_zscore(flat, ["k"], "ts", ["v"], 10)
    assert z.filter("v_z is not null").count() == 0
    assert {r["v_z"] for r in V.zscore(flat, ["v"]).select("v_z").distinct().collect()} == {0.0}


@pytest.mark.parametrize("chunk,rows", [("11 minutes", 20), ("30 days", 100_000)])
@pytest.mark.parametrize("width,center,min_periods", [(15, True, 1), (30, True, None), (60, False, 1), (7, True, 3)])
def test_rolling(spark, chunk, rows, width, center, min_periods):
    pdf = sample()
    for agg in ("mean", "median", "std"):
        got = back(V.rolling(frame(spark, pdf), ["k"], "ts", ["v"], width, agg, center=center, min_periods=min_periods, chunk=chunk, rows_per_chunk=rows))
        want = np.concatenate([
            getattr(g.sort_values("ts")["v"].rolling(width, center=center, min_periods=min_periods), agg)().to_numpy() for _, g in pdf.groupby("k", sort=True)])
        np.testing.assert_allclose(got["v_roll"].to_numpy(dtype=float), want, rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("rows", [150, 100_000])
@pytest.mark.parametrize("adjust", [True, False])
def test_ewm(spark, rows, adjust):
    for gaps in (0.0, 0.5):
        pdf = sample(600, gaps)
        got = back(V.ewm(frame(spark, pdf), ["k"], "ts", ["v"], alpha=0.3, adjust=adjust, rows_per_chunk=rows, chunk="1 hour"))
        want = np.concatenate([g.sort_values("ts")["v"].ewm(alpha=0.3, adjust=adjust).mean().to_numpy() for _, g in pdf.groupby("k", sort=True)])
        np.testing.assert_allclose(got["v_ewm"].to_numpy(dtype=float), want, rtol=1e-9)


@pytest.mark.parametrize("rows", [25, 100_000])
def test_savgol(spark, rows):
    pdf = sample(300, 0.0)
    pdf = pdf[pdf["k"] != "one"]
    got = back(V.savgol(frame(spark, pdf), ["k"], "ts", ["v"], 12, 3, rows_per_chunk=rows, chunk="1 hour"))
    want = []
    for _, g in pdf.groupby("k", sort=True):
        y, half = g.sort_values("ts")["v"].to_numpy(), 5
        for i in range(len(y)):
            mid = min(max(i, half), len(y) - 1 - half)
            fit = np.polyfit(np.arange(-half, half + 1), y[mid - half:mid + half + 1], 3)
            want.append(np.polyval(fit, i - mid))
    np.testing.assert_allclose(got["v_smooth"], want, rtol=1e-8)
    short = pdf.groupby("k").head(10)
    some = back(V.savgol(frame(spark, short), ["k"], "ts", ["v"], 101, 2, rows_per_chunk=rows, chunk="1 hour"))
    for k, g in some.groupby("k"):  # ten rows: a window of nine
        y = g["v"].to_numpy(dtype=float)
        first, last = np.polyfit(np.arange(9), y[:9], 2), np.polyfit(np.arange(9), y[1:], 2)
        np.testing.assert_allclose(g["v_smooth"].to_numpy(dtype=float), [*np.polyval(first, np.arange(5)), *np.polyval(last, np.arange(4, 9))], rtol=1e-8)


def test_savgol_on_a_grid_needs_no_python_and_one_exchange(spark):
    pdf = sample(300, 0.0)
    df = frame(spark, pdf[pdf["k"] != "one"])
    by_step = V.savgol(df, ["k"], "ts", ["v"], 11, 2, step="1 minute", chunk="1 hour")
    got, want = back(by_step), back(V.savgol(df, ["k"], "ts", ["v"], 11, 2, rows_per_chunk=50))
    np.testing.assert_allclose(got["v_smooth"], want["v_smooth"], rtol=1e-12)
    plan = by_step.select("*")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("InPandas", "InArrow", "EvalPython")) and plan.count("Exchange hashpartitioning") == 1


def direct_lowess(y, frac, iterations):
    n, x = len(y), np.arange(len(y), dtype=float)
    k = max(int(frac * n + 1e-10), 2)
    robust, fit = np.ones(n), np.zeros(n)
    for r in range(iterations + 1):
        for i in range(n):
            order = sorted(range(n), key=lambda j: (abs(j - i), j))[:k]
            lo, hi = min(order), max(order)
            h = max(i - lo, hi - i)
            idx = np.arange(lo, hi + 1)
            u = np.abs(idx - i) / h
            w = np.where(u <= 0.001, 1, np.where(u < 0.999, (1 - np.minimum(u, 1) ** 3) ** 3, 0)) * robust[idx]
            mx, my = np.average(idx, weights=w), np.average(y[idx], weights=w)
            var = np.sum(w * (idx - mx) ** 2)
            b = np.sum(w * (idx - mx) * (y[idx] - my)) / var if var > 1e-12 else 0.0
            fit[i] = my + b * (i - mx)
        if r < iterations:
            res = np.abs(y - fit)
            u = res / (6 * np.median(res))
            robust = np.where(u < 1, (1 - u**2) ** 2, 0)
    return fit


@pytest.mark.parametrize("block", [16, 4096])
@pytest.mark.parametrize("iterations", [0, 2])
def test_lowess(spark, block, iterations):
    pdf = sample(90, 0.0)
    pdf = pdf[pdf["k"] != "one"]
    got = back(V.lowess(frame(spark, pdf), ["k"], "ts", "v", 0.3, iterations=iterations, block=block, chunk="20 minutes"))
    want = np.concatenate([direct_lowess(g.sort_values("ts")["v"].to_numpy(), 0.3, iterations) for _, g in pdf.groupby("k", sort=True)])
    np.testing.assert_allclose(got["v_lowess"], want, rtol=1e-7)


@pytest.mark.parametrize(("frac", "block"), [(0.3, 16), (0.05, 16), (0.9, 50), (0.31, 333)])
def test_lowess_by_moments(spark, frac, block):
    rng = np.random.default_rng(2)
    parts = [pd.DataFrame({"k": k, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="min"),
                           "v": 1000 * level + 50 * np.sin(np.arange(n) / 90) + rng.normal(0, 3, n) + 40 * (rng.random(n) < 0.02)})
             for k, n, level in (("a", 1500, 1), ("b", 700, -3))]
    pdf = pd.concat(parts)
    got = back(V.lowess(frame(spark, pdf), ["k"], "ts", "v", frac, iterations=2, block=block, chunk="3 hours"))
    want = np.concatenate([direct_lowess(g["v"].to_numpy(), frac, 2) for _, g in pdf.groupby("k", sort=True)])
    np.testing.assert_allclose(got["v_lowess"], want, rtol=1e-6, atol=1e-6)


def test_lowess_sends_each_row_to_few_blocks():
    n, block = 1_000_000, 1024
    for k in (3 * block, n // 10, n // 3):
        needs = V._needed_blocks(n, k, block, max(k // 2, block))
        assert len(needs) <= 20 * (n / block + 1)
        assert len({(t, s) for t, s, _, kind in needs if kind == 0}) <= 8 * (n / block + 1)


def test_row_index_and_prefix_sums(spark):
    pdf = sample(irregular=True)
    for chunk in CHUNKS:
        got = back(prefix_sums(frame(spark, pdf, 16), ["k"], "ts", {"s": F.col("v")}, chunk=chunk))
        again = back(row_index(frame(spark, pdf, 1), ["k"], "ts", total="n", chunk=chunk))
        for k, g in pdf.sort_values("ts").groupby("k"):
            mine = got[got["k"] == k]
            assert list(mine["row_index"]) == list(range(len(g))) and set(mine["n_rows"]) == {len(g)}
            np.testing.assert_allclose(mine["s"], np.concatenate([[0], g["v"].fillna(0).cumsum().to_numpy()[:-1]]), atol=1e-9)
            assert list(again[again["k"] == k]["row_index"]) == list(range(len(g)))


def test_asof_against_pandas(spark):
    left, right = sample(irregular=True), sample(200, 0.3, seed=9, irregular=True).rename(columns={"v": "lab"})
    right_df = spark.createDataFrame(right).withColumn("lab", F.when(~F.isnan("lab"), F.col("lab")))
    for chunk in CHUNKS:
        for tolerance in (None, "4 minutes"):
            got = back(asof_join(frame(spark, left), right_df, ["k"], "ts", ["lab"], tolerance=tolerance, chunk=chunk))
            want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="k", tolerance=pd.Timedelta(tolerance) if tolerance else None)
            want = want.sort_values(["k", "ts"])["lab"].to_numpy(dtype=float)
            np.testing.assert_allclose(got["lab"].to_numpy(dtype=float), want)


def direct_peaks(y, height, distance):
    tops, i, n = [], 1, len(y)
    while i < n - 1:
        if y[i - 1] < y[i]:
            j = i
            while j < n - 1 and y[j + 1] == y[i]:
                j += 1
            if j < n - 1 and y[j + 1] < y[i]:
                tops.append((i + j) // 2)
            i = j
        i += 1
    tops = [t for t in tops if y[t] >= height]
    keep = []
    for t in sorted(tops, key=lambda t: (y[t], t), reverse=True):
        if all(abs(t - u) >= distance for u in keep):
            keep.append(t)
    return sorted(keep)


@pytest.mark.parametrize("rows", [13, 100_000])
@pytest.mark.parametrize("kind", ["noise", "steps", "slope"])
def test_find_peaks(spark, kind, rows):
    rng = np.random.default_rng(3)
    y = {"noise": rng.normal(0, 1, 300), "steps": rng.integers(0, 3, 300).astype(float),
         # every second row a peak, each higher than the one before: the longest chain of decisions
         "slope": np.where(np.arange(300) % 2, np.arange(300), 0).astype(float)}[kind]
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": np.arange(len(y)), "y": y})).repartition(4)
    got = sorted(r["i"] for r in find_peaks(df, ["k"], "i", "y", height=0.5, distance=7, rows_per_chunk=rows).collect())
    assert got == direct_peaks(y, 0.5, 7)


def test_shift_trim(spark):
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=40, freq="min"), "a": np.arange(40.0), "b": np.arange(40.0) * 10})
    got = V.shift_rows(spark.createDataFrame(pdf), [], "ts", {"a": 3, "b": -2}, trim=True, rows_per_chunk=6, chunk="9 minutes").toPandas().sort_values("ts")
    assert len(got) == 35 and list(got["a"]) == list(np.arange(35.0)) and list(got["b"]) == list((np.arange(35.0) + 5) * 10)


def test_step_hold_like_the_two_hour_example(spark):
    pdf = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:00:30", "2024-01-01 02:00:00", "2024-01-01 02:00:20", "2024-01-01 04:00:10"]), "x": [1.0, np.nan, 3.0, 4.0]})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = back(G.resample_step(df, [], "ts", ["x"], "1 minute"), ["ts"]).set_index("ts")["x"]
    want = pdf.set_index("ts")["x"].resample("1min").ffill().ffill().bfill()
    pd.testing.assert_series_equal(got, want, check_freq=False, check_index_type=False, check_names=False)
    longer = G.resample_step(df, [], "ts", ["x"], "1 minute", hold_until="2024-01-01 05:00:00")
    assert longer.agg(F.max("ts")).first()[0] == pd.Timestamp("2024-01-01 05:00:00")


def test_no_series_frame_keeps_data_rows_out_of_one_task(spark):
    """Without a series key only summary rows of chunks may meet in a single partition."""
    pdf = sample()[["ts", "v"]].drop_duplicates("ts")
    df = G.fill_gaps(frame(spark, pdf), [], "ts", ["v"], "both", chunk="1 hour")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("Exchange SinglePartition")[1:]:
        below = part[:600]
        assert "Aggregate" in below, below
    assert "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan


def test_grid_matches_no_points_by_shuffle_and_sums_up_chunks_by_hash(spark):
    """Points without a row come from a set per chunk: rows on the grid keep their copies, rows off it are left out."""
    rows = [("a", "2024-02-01 22:00:00", 1.0), ("a", "2024-02-01 22:00:00", 2.0), ("a", "2024-02-01 23:10:00", 3.0), ("a", "2024-02-02 02:00:00", None),
            ("b", "2023-12-31 23:00:00", 5.0), ("b", "2024-01-01 01:00:00", 6.0)]
    df = spark.createDataFrame(rows, "k string, t string, v double").select("k", F.to_timestamp("t").alias("ts"), "v")
    grid = G.reindex_grid(df, ["k"], "ts", "1 hour")
    got = sorted((r["k"], str(r["ts"])[5:13], -1.0 if r["v"] is None else r["v"]) for r in grid.collect())
    assert got == [("a", "02-01 22", 1.0), ("a", "02-01 22", 2.0), ("a", "02-01 23", -1.0), ("a", "02-02 00", -1.0), ("a", "02-02 01", -1.0), ("a", "02-02 02", -1.0),
                   ("b", "01-01 00", -1.0), ("b", "01-01 01", 6.0), ("b", "12-31 23", 5.0)]
    joins = [line for line in grid._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("ts#" in line for line in joins)
    filled = G.fill_gaps(grid, ["k"], "ts", ["v"], "both")
    assert "SortAggregate" not in filled._jdf.queryExecution().executedPlan().toString()
    assert {(r["k"], r["n"]) for r in filled.filter("v is null").groupBy("k").agg(F.count("*").alias("n")).collect()} == set()


@pytest.mark.parametrize("order", [(0.1, 0.2, 0.3), (0.3, 0.2, 0.1)])
def test_flat_top_does_not_depend_on_the_order_of_addition(spark, tmp_path, order):
    """Hours with means 0.1, 0.2, 0.2 (of three values), 0.1: added in the first order the three give a mean above 0.2."""
    rows = [(0, 0.1), (1, 0.2), *[(2, v) for v in order], (3, 0.1)]
    pdf = pd.DataFrame([(i, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h, minutes=i), 7, v) for i, (h, v) in enumerate(rows)],
                       columns=["event_id", "ts", "user_id", "value"])
    spark.createDataFrame(pdf).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["local_maxima"](spark, str(tmp_path)).collect()
    assert [(r["row_index"], r["value"]) for r in got] == [(1, 0.2)]


def test_mean_of_values_beyond_decimals(spark):
    df = spark.createDataFrame([("a", 1e300), ("a", 3e300), ("b", 1e-30), ("b", 3e-30), ("c", None), ("d", 2.0), ("d", None)], "k string, x double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(unordered_mean("x").alias("m")).collect()}
    assert got == {"a": 2e300, "b": 2e-30, "c": None, "d": 2.0}


def test_fill_from_both_sides_sorts_rows_once(spark):
    pdf = sample(gaps=0.6)
    pdf.loc[pdf.index[:30], "v"] = np.nan
    df = spark.createDataFrame(pdf).repartition(5)
    want = pdf.sort_values(["k", "ts"]).groupby("k")["v"].transform(lambda v: v.ffill().bfill()).to_numpy()
    for chunk in ("1 day", "11 minutes"):
        filled = G.fill_gaps(df, ["k"], "ts", ["v"], "both", step="1 minute", chunk=chunk)
        assert np.allclose(filled.toPandas().sort_values(["k", "ts"])["v"].to_numpy(dtype=float), want, equal_nan=True)
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 3  # over the rows once, over the chunk summary up and down


def test_default_chunk_of_a_grid_is_not_a_few_rows():
    assert grid_chunk("1 minute") == "1 day" and grid_chunk("1 hour", "2 days") == "2 days"
    assert pd.Timedelta(grid_chunk("1 hour")) == pd.Timedelta("1000 hours")
