"""Inputs the given tables do not contain: missing labels, odd targets, repeated keys, clashing names, lost folders."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenhand.operators import association as K, audit as A, cleaning as S, labels as L, metrics as M, mitigation as G, models as T
from evenhand.plans import resample as R
from evenhand.plans.longform import group_rates, with_totals
from evenhand.sources import tables as IO, views as V


def test_summary_equals_the_operators_it_counts_with_missing_labels(spark):
    rows = [("a", 1, 1 if i < 5 else None) for i in range(20)] + [("b", 1 if i < 10 else 0, 0 if i < 4 else None) for i in range(20)] + [("c", 0, None)] * 5
    df = spark.createDataFrame(rows, "g string, y_pred int, y int")
    got = M.fairness_summary(df, ["g"], "y", "y_pred").first()
    dp, di, eo = M.demographic_parity(df, ["g"], "y_pred").first(), M.disparate_impact(df, ["g"], "y_pred").first(), M.equalized_odds(df, ["g"], "y", "y_pred").first()
    assert got.dp_violations == int(dp.above_threshold) == 1 and got.di_violations == int(not di.passes) == 1 and got.eo_violations == int(eo.above_threshold)


def test_bootstrap_bins_numeric_attributes_like_the_tests(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=1500), "s": rng.choice(["u", "v"], 1500), "y": rng.integers(0, 2, 1500)}))
    got = {r.attribute: r for r in K.bootstrap_cramers_v(df, ["x", "s"], "y").collect()}
    want = {r.attribute: r.cramers_v for r in K.cramers_v_target(df, ["x", "s"], "y").collect()}
    assert {a: r.point for a, r in got.items()} == want
    assert all(r.ci_lower <= r.ci_upper <= 0.2 for r in got.values())


def test_resampled_cells_are_poisson(spark):
    sizes = {("a", 0): 400, ("a", 1): 100, ("b", 1): 7, ("b", 0): 31, ("c", None): 32, ("c", 1): 1}
    cells = spark.createDataFrame([(g, y, n) for (g, y), n in sizes.items()], "g string, y int, n bigint")
    drawn = R.resampled(cells, ["g", "y"], 4000, 1)
    seen = drawn.groupBy("g", "y").agg(F.collect_list("n").alias("d")).collect()
    for r in seen:
        n, d = sizes[r.g, r.y], np.sort(np.array(r.d))
        assert len(d) == 4000 and abs(d.mean() - n) < 5 * (n / 4000) ** 0.5 and 0.88 * n < d.var() < 1.12 * n
        below, cdf = 0.0, []
        for k in range(n + 1):
            below += math.exp(k * math.log(n) - n - math.lgamma(k + 1))
            cdf.append(below)
        assert max(abs((d <= k).mean() - c) for k, c in enumerate(cdf)) < 0.03  # the whole distribution, not its moments only
    assert sorted(map(repr, drawn.collect())) == sorted(map(repr, R.resampled(cells.repartition(3), ["g", "y"], 4000, 1).collect()))
    assert R.resampled(cells.filter("n > 1000"), ["g", "y"], 5).count() == 0


def test_score_intervals_against_a_resampling_of_rows(spark):
    rng = np.random.default_rng(8)
    n = 900
    g, p = np.repeat(["a", "b"], n // 2), np.round(rng.random(n), 2)
    p[n // 2:] = np.round(p[n // 2:] ** 1.3, 2)
    y = (rng.random(n) < p).astype(float)
    y[::50] = np.nan
    pdf = pd.DataFrame({"g": g, "s": np.where(np.arange(n) < 5, "few", np.where(np.arange(n) % 3 == 0, "u", "v")), "y": y, "p": p})
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y").cast("int")))
    got = {(r.attribute, r.grp, r.metric): r for r in M.bootstrap_score_ci(df, ["g", "s"], "y", "p").collect()}
    base = {r.attribute: r for r in M.wasserstein_prob(df, ["g", "s"], "p").collect()}
    errors = {(r.attribute, r.grp): r for r in M.calibration_error(df, ["g", "s"], "y", "p").collect()}
    assert ("s", None, "wasserstein") not in got and got["g", None, "wasserstein"].point == base["g"].wasserstein
    assert all(got[a, k, "calibration_error"].point == e.calibration_error for (a, k), e in errors.items())
    few = got["s", "few", "calibration_error"]
    assert (few.point, few.ci_lower, few.confidence) == (None, None, "LOW")
    draws = []
    for _ in range(1500):
        w = rng.poisson(1, n)
        a, b = np.sort(np.repeat(p[: n // 2], w[: n // 2])), np.sort(np.repeat(p[n // 2:], w[n // 2:]))
        x = np.unique(p)
        fa, fb = np.searchsorted(a, x, "right") / len(a), np.searchsorted(b, x, "right") / len(b)
        draws.append((np.abs(fa - fb)[:-1] * np.diff(x)).sum())
    lo, hi = np.quantile(draws, [0.025, 0.975])
    r = got["g", None, "wasserstein"]
    assert abs(r.ci_lower - lo) < 0.012 and abs(r.ci_upper - hi) < 0.012
    empty = M.bootstrap_score_ci(df.filter("p > 2"), ["g"], "y", "p")
    assert empty.count() == 0


def test_metric_intervals_hold_the_metrics(spark):
    g = np.repeat(["a", "b"], 2000)
    y = np.tile([0, 1], 2000)
    p = np.concatenate([np.arange(2000) < 1200, np.arange(2000) < 800]).astype(int)  # rates 0.6 and 0.4
    out = {r.metric: r for r in K.bootstrap_metric_ci(spark.createDataFrame(pd.DataFrame({"g": g, "y": y, "p": p})), ["g"], "y", "p").collect()}
    assert out["dp_difference"].ci_lower < 0.2 < out["dp_difference"].ci_upper and out["di_ratio"].ci_lower < 0.4 / 0.6 < out["di_ratio"].ci_upper
    assert 0.04 < out["dp_difference"].ci_width < 0.1 and out["dp_difference"].confidence == "HIGH"


def test_targets_have_to_be_binary(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 2, 2), ("b", None, 1)], "g string, y int, z int")
    assert [r.t for r in S.binarize_target(df, "y", "t").orderBy("g", "y").collect()] == [0, 1, None, 1]
    zero = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (None,)], "y double")
    assert sorted(str(r.t) for r in S.binarize_target(zero, "y", "t").collect()) == ["0", "1", "None", "None"]
    assert [r.t for r in S.binarize_target(zero.filter("y = 1"), "y", "t").collect()] == [1]
    for run in (lambda: A.outcome_distribution(df, ["g"], "y"), lambda: M.group_confusion(df, ["g"], "y", "z"), lambda: M.demographic_parity(df, ["g"], "z")):
        with pytest.raises(Exception, match="is not 0/1"):
            run().collect()
    flags = spark.createDataFrame([("a", True), ("a", False)], "g string, y boolean")
    assert group_rates(flags, ["g"], "y").first().rate == 0.5


def test_split_is_exact_with_repeated_keys(spark):
    rows = [(7, i % 2, i) for i in range(20)] + [(i, i % 2, 100 + i) for i in range(100, 180)]
    got = T.stratified_split(spark.createDataFrame(rows, "k bigint, y int, x int"), "k", "y").groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in got} == {(0, "test"): 15, (1, "test"): 15, (0, "train"): 35, (1, "train"): 35}


def test_profile_and_missing_rates_agree_on_nan(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", None), ("a", 1.0)], "g string, x double")
    for how in ("exact", "approx"):
        r = S.table_profile(df, how).filter("column_name = 'x'").first()
        assert (r.n, r.n_null, r.n_distinct) == (3, 2, 1)
    assert A.missing_by_group(df, ["g"], ["x"]).first().missing_pct == 66.67


def test_every_column_with_nulls_has_a_class(spark):
    rows = [(i % 2, float(i), None, 1.0 if i % 2 else None, 5) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, x double, gone double, tied double, full int").withColumn("g", F.col("g").cast("string"))
    got = {r.column_name: r.mechanism for r in A.missingness_class(df, ["g"], ["gone", "tied", "full"], ["x"]).collect()}
    assert got == {"gone": "MCAR", "tied": "NMAR"}


def test_constrained_training_fills_missing_features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    rows = [(None if i % 7 == 0 else float(v), "ab"[i % 2], int(v + rng.normal() > 0)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, g string, y int")
    out = G.fair_training(df, df, ["x"], "y", "g", rounds=3)
    assert out.count() == 300 and out.filter("y_prob IS NULL OR y_pred IS NULL").count() == 0


def test_one_hot_names_and_many_values(spark):
    df = spark.createDataFrame([("b_c", "x"), ("d", "c")], "a string, a_b string")
    with pytest.raises(ValueError, match="a_b_c"):
        S.one_hot(df, ["a", "a_b"])
    with pytest.raises(ValueError, match="more than 1 values"):
        S.one_hot(df, ["a"], max_values=1)
    out = S.one_hot(df, ["a", "a_b"], max_values=1, many="vector")
    assert out.columns == ["a_vec", "a_b_vec"] and out.count() == 2


def test_oversampling_keeps_every_row(spark):
    rows = [(i, 1 if i % 4 else 0, None if i % 3 == 0 else float(i % 11), float(i % 5)) for i in range(100)] + [(None, 1, 1.0, 1.0), (500, None, 1.0, 2.0)]
    out = G.smote_oversample(spark.createDataFrame(rows, "k bigint, y int, a double, b double"), "k", ["a", "b"], "y", k=3)
    kinds = {(r.y, r.synthetic): r["count"] for r in out.groupBy("y", "synthetic").count().collect()}
    assert kinds == {(1, False): 76, (0, False): 25, (None, False): 1, (0, True): 50} and out.filter("a IS NULL OR b IS NULL").count() == 0


def test_oversampling_asks_for_the_rows_with_copies(spark, monkeypatch):
    asked, search = [], G.nearest
    monkeypatch.setattr(G, "nearest", lambda *a, asking=None, **k: asked.append(asking.count()) or search(*a, asking=asking, **k))
    rows = [(i, 1 if i % 9 > 3 else 0, float(i % 11), float(i % 5)) for i in range(90)]  # 50 and 40 rows: ten copies
    out = G.smote_oversample(spark.createDataFrame(rows, "k bigint, y int, a double, b double"), "k", ["a", "b"], "y", k=3)
    assert out.filter("synthetic AND y = 0").count() == 10 and out.count() == 100 and asked == [10]


def test_forest_rows_are_dealt_to_all_cores(spark, monkeypatch):
    """A table of one file is not grown into trees by one task; a short one stays as it is."""
    seen, fit = [], T.Pipeline.fit
    monkeypatch.setattr(T.Pipeline, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), self.getStages()[-1].getCacheNodeIds())) or fit(self, df))
    df = spark.range(0, 400, 1, 1).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    for least, pieces in ((50, 8), (1000, 1)):
        monkeypatch.setattr(T, "_FOREST_ROWS", (least, 1_000_000))
        model = T.fit_classifier(df, ["a"], "y", trees=3, depth=3)
        assert seen.pop() == (pieces, True) and T.score_table(model, df, ["a"]).filter("y_pred <> y").count() == 0


def test_totals_of_a_key_with_many_groups_need_no_window(spark):
    groups = spark.range(200_000).select(F.lit("attr").alias("attribute"), F.col("id").cast("string").alias("grp"), F.lit(2).alias("n"))
    out = with_totals(groups, ["attribute"], total=F.sum("n"))
    assert out.agg(F.min("total"), F.count("*")).first() == (400_000, 200_000)
    for plan in (out, A.shares(groups), L.label_adjust_weights(groups.withColumn("y", F.lit(1)), "grp", "y")):
        assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()


def test_shared_folder(spark):
    assert IO.shared_base("local[4]", "/x") == "/x" and IO.shared_base("spark://h:7077", "hdfs://x") == "hdfs://x"
    for named in (None, "", "file:/tmp/x"):
        with pytest.raises(RuntimeError):
            IO.shared_base("spark://h:7077", named)
    IO.release(spark)
    df = IO.written(spark.range(5).toDF("x"), "try")
    fs, folder = IO._folder(spark, IO.run_folder(spark))
    assert df.count() == 5 and fs.exists(folder)
    IO.release(spark)
    assert not fs.exists(folder)


def test_a_mounted_folder_serves_a_cluster(spark, monkeypatch):
    folder = spark.sparkContext.getCheckpointDir()
    assert folder.startswith("file:")
    IO.release(spark)
    with monkeypatch.context() as cluster:
        cluster.setattr(spark.sparkContext, "master", "spark://h:7077")
        df = IO.written(spark.range(100), "try")
        assert df.count() == 100 and IO.run_folder(spark).startswith(folder)
        IO.release(spark)
        cluster.setattr(IO, "shared_by_all", lambda session, base: False)  # not mounted elsewhere
        with pytest.raises(RuntimeError):
            IO.written(spark.range(100), "try")


def test_many_models_in_one_job_equal_one_by_one(spark, sf):
    df = V.decisions(spark, sf).withColumn("model_id", F.date_format("decided_at", "yyyy"))
    attrs = ["segment", "region"]
    runs = {
        "summary": lambda d, by: M.fairness_summary(d, attrs, "approved", "y_pred", by=by), "verdict": lambda d, by: M.attribute_verdict(d, attrs, "approved", by=by),
        "intersections": lambda d, by: K.intersectional_tests(d, attrs, "approved", by=by),
    }
    years = ["1996", "1998"]
    for name, run in runs.items():
        every = run(df, ["model_id"])
        for year in years:
            alone = run(df.filter(F.col("model_id") == year), ())
            assert sorted(map(tuple, every.filter(F.col("model_id") == year).drop("model_id").collect()), key=repr) == sorted(map(tuple, alone.collect()), key=repr), name
