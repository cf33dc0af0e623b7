"""Quantiles, binning, statistics and quality on awkward inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import binning as B
from millrace.operators import quality as Q
from millrace.operators import quantiles
from millrace.operators import stats as S
from millrace.operators.dedup import top_k
from millrace.operators.quantiles import average_rank, average_ranks, cumulative_counts, exact_quantiles, grouped_quantile, order_statistics


def values(kind, n=3000):
    rng = np.random.default_rng(2)
    return {"normal": rng.normal(0, 1e6, n), "ties": rng.integers(0, 4, n).astype(float), "heavy": np.exp(rng.normal(0, 8, n)),
            "hot": np.where(rng.random(n) < 0.6, 7.0, rng.normal(0, 1, n)), "negative": -np.exp(rng.normal(0, 5, n))}[kind]


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "hot", "negative"])
def test_bracketed_quantiles(spark, kind):
    v = values(kind)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": v[::-1] * 2})).repartition(6)
    probs = [0.0, 0.01, 0.33, 0.5, 0.999, 1.0]
    got = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, ["v", "w"], probs, direct_rows=40).collect()}
    for p in probs:
        assert got["v", p] == pytest.approx(np.quantile(v, p), rel=1e-12)
        assert got["w", p] == pytest.approx(np.quantile(v * 2, p), rel=1e-12)
    ranks = [0, 17, 1500, 2999]
    found = order_statistics(df, {"v": ranks}, small=10)
    assert [found["v", r] for r in ranks] == [np.sort(v)[r] for r in ranks]


def test_quantiles_with_infinities_in_both_branches(spark):
    values = [float("-inf")] * 2 + [float(i) for i in range(100)] + [float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    direct, bracketed = (
        {r.prob: r.value for r in exact_quantiles(df, ["v"], [0.0, 0.01, 0.25, 0.5, 1.0], n).collect()} for n in (1000, 5))
    assert direct == bracketed and direct[0.0] == float("-inf") and direct[1.0] == float("inf") and direct[0.5] == 49.0


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    rows = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, ["a", "b"], [0.5]).collect()}
    assert rows == {("a", 0.5): None, ("b", 0.5): 1.0}


def test_bins_follow_right_closed_rule(spark):
    edges = [0.0, 1.0, 2.5, 9.0]
    v = [-0.1, 0.0, 0.5, 1.0, 1.0001, 2.5, 9.0, 9.1, None]
    got = [r["v"] for r in B.apply_bins(spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double"), {"v": edges}).orderBy("i").collect()]
    want = pd.cut(pd.Series(v, dtype=float), edges, labels=False, include_lowest=True)
    assert got == [None if np.isnan(x) else int(x) for x in want]


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "hot"])
def test_quantile_and_supervised_edges(spark, kind):
    v = values(kind, 1000)
    pdf = pd.DataFrame({"v": v, "y": np.arange(1000.0)})
    pdf.loc[::11, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    for rows in (50, 1_000_000):
        quantile = B.bins_quantile(df, ["v"], 5, rows)["v"]
        np.testing.assert_allclose(quantile, np.unique(np.quantile(v, np.linspace(0, 1, 6))))
        s = np.sort(pdf.dropna()["v"].to_numpy())
        want = np.unique([s[0], *[s[int(len(s) * i / 5)] for i in range(1, 5)], s[-1]])
        np.testing.assert_allclose(B.bins_supervised(df, ["v"], 5, "y", rows)["v"], want)


def test_counts_of_a_thousand_rows(spark):
    """A thousand distinct values give the known counts of both methods."""
    df = spark.createDataFrame(pd.DataFrame({"v": np.random.default_rng(0).permutation(1000).astype(float), "target": 1.0}))
    for method, counts in (("quantile", [200] * 5), ("entropy", [201, 200, 200, 200, 199])):
        _, info = B.smart_binning(df, 5, method, "target")
        assert list(info.first()["bin_counts"]) == counts


def test_constant_feature_and_fallbacks(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "v double, target double")
    assert len(B.bins_quantile(df, ["v"], 4)["v"]) == 5
    assert set(B.bins_kmeans(df, ["v"], 4)) == {"v"}
    with pytest.raises(ValueError):
        B.bin_edges(df, ["v"], 3, "magic")


def inertia(v, edges):
    lab = pd.cut(pd.Series(v), edges, labels=False, include_lowest=True)
    return float(sum(((g - g.mean()) ** 2).sum() for _, g in pd.Series(v).groupby(lab)))


def test_kmeans_reaches_the_clusters(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(m, 1, 200) for m in (0, 20, 50, 55)])
    edges = B.bins_kmeans(spark.createDataFrame(pd.DataFrame({"v": v})), ["v"], 4)["v"]
    assert len(edges) == 5
    assert inertia(v, edges) <= 1.02 * inertia(v, [v.min(), 10, 35, 52.5, v.max()])


def test_rank_of_a_large_group(spark):
    v = np.concatenate([np.full(500, 3.0), np.random.default_rng(1).normal(0, 1, 700).round(1), [np.nan] * 5])
    pdf = pd.DataFrame({"g": np.where(np.arange(len(v)) % 5 == 0, "b", "a"), "i": np.arange(len(v)), "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    for by in (["g"], []):
        got = average_rank(df, by, "v", "r", pieces=5).toPandas().sort_values("i")["r"].to_numpy(dtype=float)
        want = (pdf.groupby("g")["v"].rank() if by else pdf["v"].rank()).to_numpy()
        np.testing.assert_allclose(got, want)


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "hot"])
def test_quantile_per_group(spark, kind):
    v = values(kind, 1201)
    pdf = pd.DataFrame({"g": np.where(np.arange(len(v)) % 6 == 0, "b", "a"), "v": v})
    df = spark.createDataFrame(pdf).repartition(5)
    for prob in (0.0, 0.3, 0.5, 1.0):
        got = {r["g"]: r["q"] for r in grouped_quantile(df, ["g"], "v", prob, "q", pieces=7).collect()}
        assert got == pytest.approx(pdf.groupby("g")["v"].quantile(prob).to_dict(), rel=1e-12)
    assert grouped_quantile(df, [], "v", 0.5, "q").first()[0] == pytest.approx(np.median(v))


def test_top_k_of_a_hot_group(spark):
    pdf = pd.DataFrame({"g": ["hot"] * 5000 + ["cold"] * 3, "i": np.arange(5003), "v": np.arange(5003) % 97})
    got = top_k(spark.createDataFrame(pdf), 7, [F.col("v").desc(), "i"], by=["g"]).toPandas()
    want = pdf.sort_values(["v", "i"], ascending=[False, True]).groupby("g").head(7)
    assert set(got["i"]) == set(want["i"])


def test_correlations_of_constant_and_single_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 5.0, 6.0)], "regime string, x double, y double")
    assert {r["corr_y"] for r in S.regime_corr(df, "x", ["y"]).collect()} == {None}
    assert {r["corr_y"] for r in S.regime_corr(df, "x", ["y"], "spearman").collect()} == {None}
    assert S.pair_regression(df.filter("regime = 'a'"), "y", ["x"]).first()["slope"] is None
    assert S.segment_r2(df.withColumn("c", F.lit(1.0)), "c").first()[0] == 0.0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 10, 10]] + [(None,)], "v double")
    h = Q.histogram(df, "v", 5).toPandas().sort_values("bin")
    assert list(h["n"]) == list(np.histogram([0, 1, 2, 3, 10, 10], bins=5)[0])
    assert Q.histogram(df.filter("v > 100"), "v").count() == 0
    assert Q.histogram(df.filter("v = 10"), "v", 3).agg(F.sum("n")).first()[0] == 2


def test_ranges_stay_even_with_a_heavy_tail(spark):
    """One value at 1e12 does not empty the ranges of all others, and a group of most rows is spread over many."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": np.where(rng.random(4000) < 0.9, "hot", "cold"), "v": rng.normal(0, 1, 4000), "w": rng.integers(0, 40, 4000).astype(float)})
    pdf.loc[17, "v"], pdf.loc[18, "v"] = 1e12, -1e300
    df = spark.createDataFrame(pdf).repartition(4)
    table = cumulative_counts(df, ["g"], "v", pieces=16)
    assert table.filter("g = 'hot'").count() == pdf[pdf["g"] == "hot"]["v"].nunique()
    counts = df.groupBy("g", "v").count().repartitionByRange(16, "g", "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) == 16 and max(r["count"] for r in counts) < 3 * 4000 / 16
    both = average_ranks(df, ["g"], {"v": "rv", "w": "rw"}, pieces=9).toPandas()
    for c in ("v", "w"):
        np.testing.assert_allclose(both[f"r{c}"], both.groupby("g")[c].rank())


def test_spearman_takes_few_exchanges(spark):
    pdf = pd.DataFrame({"regime": [0] * 30 + [1] * 30, "a": np.arange(60.0), "y": np.tile(np.arange(30.0), 2)})
    plan = S.regime_corr(spark.createDataFrame(pdf), "y", ["a"], "spearman")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 8


def test_spearman_counts_a_target_once_for_all_features(spark, monkeypatch):
    """Gaps of its own per feature, ties, and rows without a regime; what is written is a row per value, not per value and feature."""
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"regime": rng.choice(["a", "b", "none"], 600), "y": rng.normal(0, 1, 600).round(2), "p": rng.integers(0, 4, 600).astype(float),
                        "q": rng.normal(0, 1, 600), "r": np.where(rng.random(600) < 0.98, 5.0, 6.0)})
    for c in ("y", "p", "q"):
        pdf.loc[rng.random(600) < 0.1, c] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "regime string, y double, p double, q double, r double").repartition(4)
    df = df.withColumn("regime", F.nullif("regime", F.lit("none")))
    written = []
    kept = quantiles.kept_table
    monkeypatch.setattr(quantiles, "kept_table", lambda *a: written.append(kept(*a)) or written[-1])
    got = {r["regime"]: r for r in S.regime_corr(df, "y", ["p", "q", "r"], "spearman").collect()}
    assert set(got) == {"a", "b", None}
    for name, rows in pdf.groupby("regime"):
        own = got[None if name == "none" else name]
        assert own["n_samples"] == len(rows)
        for c in ("p", "q", "r"):
            both = rows[["y", c]].dropna().rank()
            assert own[f"corr_{c}"] == pytest.approx(both["y"].corr(both[c]), abs=1e-12)
    assert written[0].count() == len(pdf.dropna(subset="y").drop_duplicates(["regime", "y"]))


def test_kmeans_says_when_it_has_not_settled(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"v": np.concatenate([rng.normal(0, 1, 300), rng.normal(30, 6, 300)])}))
    with pytest.warns(UserWarning, match="1 rounds: v"):
        B.bins_kmeans(df, ["v"], 5, rounds=1)
