"""Operators on edge tables and against plain pandas; planted effects must be found."""

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenhand.operators import (
    association as K, audit as A, cleaning as S, explain as X, labels as L, metrics as M, mitigation as G, models as T, monitoring as N, risk as R,
)
from evenhand.plans import ordered
from evenhand.sources import tables as IO, views as V


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def people(spark):
    """Group b is approved less often, neutral is not tied to the label; some groups are null."""
    rng = np.random.default_rng(5)
    n = 2000
    g = rng.choice(["a", "b"], n, p=[0.7, 0.3])
    neutral = rng.choice(["u", "v", "w"], n)
    score = np.clip(rng.normal(0.6, 0.15, n) - 0.25 * (g == "b"), 0.01, 0.99).round(3)
    y = (rng.random(n) < score).astype(int)
    pdf = pd.DataFrame({
        "id": np.arange(n), "g": np.where(rng.random(n) < 0.02, None, g), "neutral": neutral, "approved": y, "y_prob": score,
        "y_pred": (score > 0.5).astype(int), "x": rng.normal(size=n) - (g == "b"), "z": rng.normal(size=n),
    })
    df = IO.written(spark.createDataFrame(pdf), "people")
    return df, pdf


def test_planted_effect_is_found(people):
    df, _ = people
    tests = {r["attribute"]: r for r in K.chi_square_tests(df, ["g", "neutral"], "approved").collect()}
    assert tests["g"]["significant"] and tests["g"]["strength"] != "WEAK"
    assert not tests["neutral"]["significant"] and tests["neutral"]["strength"] == "WEAK"
    di = {r["attribute"]: r for r in M.disparate_impact(df, ["g", "neutral"], "y_pred").collect()}
    assert not di["g"]["passes"] and di["g"]["min_group"] == "b" and di["neutral"]["passes"]
    flags = {(r["attribute"], r["feature"]): r["flag"] for r in K.point_biserial(df, ["g", "neutral"], ["x", "z"]).collect()}
    assert flags[("g", "x")] == "INVESTIGATE" and flags[("g", "z")] == "OK" and ("neutral", "x") not in flags


def test_numeric_attributes(people):
    """V and proxies use quintiles, correlations the values themselves."""
    df, pdf = people
    tests = {r["attribute"]: r for r in K.chi_square_tests(df, ["x", "g"], "approved").collect()}
    cut = pd.qcut(pdf["x"], 5)
    t = pd.crosstab(cut, pdf["approved"]).to_numpy().astype(float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    assert math.isclose(tests["x"]["cramers_v"], math.sqrt(((t - e) ** 2 / e).sum() / t.sum()), abs_tol=1e-4)
    assert tests["x"]["r"] == pdf["x"].nunique()
    r = {(x["attribute"], x["feature"]): x for x in K.point_biserial(df, ["x", "g"], ["y_prob", "z"]).collect()}
    assert math.isclose(r[("x", "z")]["r"], np.corrcoef(pdf["x"], pdf["z"])[0, 1], abs_tol=1e-4)
    assert set(r) == {(a, f) for a in ("x", "g") for f in ("y_prob", "z")}
    found = K.proxy_detection(df, ["x"], ["z", "neutral"]).collect()
    assert len(found) == 2 and not any(p["is_proxy"] for p in found)


def test_v_collapses_when_the_target_is_cut_into_quantiles(people):
    df, _ = people
    assert {r["cramers_v"] for r in K.chi_square_tests(df, ["g"], "approved", binning="quantile_always").collect()} == {0.0}


def test_partitioning_does_not_matter(people):
    df, _ = people
    for op in (lambda d: M.disparate_impact(d, ["g", "neutral"], "y_pred"), lambda d: K.intersectional_tests(d, ["g", "neutral"], "approved"),
               lambda d: M.wasserstein_prob(d, ["g"], "y_prob"), lambda d: G.group_thresholds(d, "g", "approved", "y_prob"),
               lambda d: T.stratified_split(d, "id", "approved")):
        assert rows(op(df)) == rows(op(df.repartition(7).sortWithinPartitions("z")))


def test_null_group_and_shares(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0), ("b", float("nan"))], "g string, v double")
    got = {r["grp"]: r for r in A.group_representation(df, ["g"]).collect()}
    assert set(got) == {"a", "b"} and math.isclose(sum(r["pct"] for r in got.values()), 100, abs_tol=0.02)
    miss = {(r["grp"], r["column_name"]): r["missing_pct"] for r in A.missing_by_group(df, ["g"], ["v"]).collect()}
    assert miss == {("a", "v"): 50.0, ("b", "v"): 100.0}
    y = df.withColumn("y", F.lit(1)).withColumn("h", F.lit("k"))
    names = {r["grp"] for r in K.intersectional_rates(y, ["g", "h"], "y").collect()}
    assert names == {"a_k", "b_k", "nan_k"}


def test_empty_and_one_sided_tables(spark):
    empty = spark.createDataFrame([], "id long, g string, approved int, y_pred int, y_prob double")
    for df in (A.group_representation(empty, ["g"]), K.chi_square_tests(empty, ["g"], "approved"), M.equalized_odds(empty, ["g"], "approved", "y_pred"),
               M.disparate_impact(empty, ["g"], "y_pred"), M.wasserstein_prob(empty, ["g"], "y_prob"), L.label_disparity(empty, ["g"], "approved")):
        assert df.count() == 0
    equal = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 0, 0), ("b", 1, 1)], "g string, y int, p int")
    assert M.disparate_impact(equal, ["g"], "p").first()["ratio"] == 1.0 and M.demographic_parity(equal, ["g"], "p").first()["gap"] == 0.0
    nobody = equal.withColumn("p", F.lit(0))
    assert M.disparate_impact(nobody, ["g"], "p").first()["ratio"] == 0.0
    with pytest.raises(ValueError):
        A.group_representation(equal, ["missing"])


@pytest.mark.parametrize("piece_rows", [20, 10**6])
def test_wasserstein(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(ordered, "PIECE_ROWS", piece_rows)
    base = [round(0.001 * i * i % 0.5, 4) for i in range(200)]
    for shift in (0.0, 0.2):
        df = spark.createDataFrame([("a", p) for p in base] + [("b", p + shift) for p in base], "g string, p double")
        assert math.isclose(M.wasserstein_prob(df, ["g"], "p").first()["wasserstein"], shift, abs_tol=1e-4)


def test_calibration_status_for_small_groups(spark):
    df = spark.createDataFrame([("a", i % 2, 0.5) for i in range(30)] + [("b", 1, 0.9)] * 5, "g string, y int, p double")
    got = {r["grp"]: r for r in M.calibration_error(df, ["g"], "y", "p").collect()}
    assert got["a"]["status"] == "ok" and got["b"]["status"] == "too few samples" and got["b"]["calibration_error"] is None


@pytest.mark.parametrize("piece_rows", [20, 10**6])
def test_pareto_frontier(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(ordered, "PIECE_ROWS", piece_rows)
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"model_id": rng.choice(["m", "n"], 300), "run_id": range(300), "accuracy": rng.integers(0, 25, 300) / 25, "dp_gap": rng.integers(0, 25, 300) / 25})
    got = {r["run_id"] for r in R.pareto_frontier(spark.createDataFrame(pdf)).collect()}
    want = set()
    for _, a in pdf.iterrows():
        rest = pdf[pdf.model_id == a.model_id]
        worse = (rest.accuracy >= a.accuracy) & (rest.dp_gap <= a.dp_gap) & ((rest.accuracy > a.accuracy) | (rest.dp_gap < a.dp_gap))
        if not worse.any():
            want.add(a.run_id)
    assert got == want


@pytest.mark.parametrize("piece_rows", [20, 10**6])
def test_group_thresholds(people, monkeypatch, piece_rows):
    monkeypatch.setattr(ordered, "PIECE_ROWS", piece_rows)
    df, pdf = people
    got = {r["grp"]: r for r in G.group_thresholds(df, "g", "approved", "y_prob").collect()}
    pdf = pdf.dropna(subset=["g"])
    best = None
    for rate in range(101):
        pick, total = {}, 0
        for g, part in pdf.groupby("g"):
            options = [(int((part.y_prob > t).sum()), t) for t in sorted(set(part.y_prob))] + [(len(part), None)]
            sel, t = max((o for o in options if o[0] * 100 <= rate * len(part)), key=lambda o: o[0])
            chosen = part.y_prob > t if t is not None else part.y_prob > -1
            total += int((chosen == (part.approved == 1)).sum())
            pick[g] = t
        if best is None or total > best[0]:
            best = (total, rate, pick)
    assert {g: r["threshold"] for g, r in got.items()} == best[2]
    assert {round(r["common_rate"] * 100) for r in got.values()} == {best[1]}
    after = G.apply_thresholds(df, G.group_thresholds(df, "g", "approved", "y_prob"), "g", "y_prob")
    assert M.demographic_parity(after, ["g"], "y_pred").first()["gap"] < 3 < M.demographic_parity(df, ["g"], "y_pred").first()["gap"]


def test_cleaning(spark):
    df = spark.createDataFrame([(1, -1, 50, 5.0), (2, 30, 40, -1.0), (3, 30, 2, -2.0), (4, None, 3, None), (5, 40, 1, 9.0)], "id long, age int, employment_years int, income double")
    assert [r["id"] for r in S.inconsistency_removal(df).orderBy("id").collect()] == [4, 5]
    assert dict(map(tuple, S.inconsistency_report(df).collect())) == {"negative age": 1, "employment_years > age": 1, "negative income": 1, "total_removed": 3}
    assert S.inconsistency_report(df.filter("id = 5")).count() == 0
    s = spark.createDataFrame([("x", "1"), ("y", "2"), (None, "3")], "c string, num string")
    hot = S.one_hot(s, ["c"])
    assert hot.columns == ["num", "c_x", "c_y"] and rows(hot) == [("1", 1, 0), ("2", 0, 1), ("3", 0, 0)]
    with pytest.raises(ValueError):
        S.one_hot(s, ["c"], max_values=1)
    assert S.one_hot_vectors(s, ["c"]).columns == ["c", "num", "c_vec"]
    assert [r["target"] for r in S.binarize_target(s, "num").orderBy("num").collect()] == [0, 0, 1]
    assert [r["target"] for r in S.binarize_target(s, "c").orderBy("num").collect()] == [0, 1, None]
    with pytest.raises(ValueError):
        S.binarize_target(spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), "t")
    const = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert rows(S.standard_scale(const, ["a", "b"])) == [(-1.0, 0.0), (1.0, 0.0)]


def test_column_detection(spark):
    df = spark.createDataFrame([(1, "f", 2, 0.5), (2, "m", 3, 0.7), (3, "m", 2, 0.9)], "id long, home_page string, flag int, score double")
    assert [r["column_name"] for r in S.detect_sensitive(df).collect()] == ["home_page"]
    assert S.detect_sensitive(df, match="token").count() == 0
    assert tuple(S.detect_target(df).first())[:2] == ("flag", "binary")
    assert tuple(S.detect_target(df.withColumnRenamed("score", "loan_approved")).first())[:2] == ("loan_approved", "name")
    assert tuple(S.detect_target(df.select("id", "score")).first())[:2] == ("score", "numeric")


def test_missingness_class(spark):
    data = [("a" if i % 2 else "b", None if i % 2 and i % 3 else 1.0, float(i % 7), None if i % 11 == 0 else 2.0) for i in range(600)]
    df = spark.createDataFrame(data, "g string, v double, w double, u double")
    got = dict(map(tuple, A.missingness_class(df, ["g"], ["v", "u", "w"], ["w"]).collect()))
    assert got == {"v": "NMAR", "u": "MCAR"}


def test_proxy_of_a_copy_and_attributions(people):
    df, _ = people
    found = {r["feature"]: r for r in K.proxy_detection(df.withColumn("copy", F.col("g")), ["g"], ["copy", "z", "neutral"]).collect()}
    assert found["copy"]["is_proxy"] and found["copy"]["cramers_v"] > 0.99
    assert not found["z"]["is_proxy"] and not found["neutral"]["is_proxy"]
    assert S.drop_proxies(df.withColumn("copy", F.col("g")), K.proxy_detection(df.withColumn("copy", F.col("g")), ["g"], ["copy"])).columns == df.columns
    coefs = {"x": 2.0, "z": -1.0}
    phi = X.linear_attributions(df, "id", coefs)
    both = phi.groupBy("id").agg(F.sum("phi").alias("s")).join(df, "id")
    means = df.agg(F.avg("x").alias("x"), F.avg("z").alias("z")).first()
    gap = both.select(F.max(F.abs(F.col("s") - (2 * (F.col("x") - means["x"]) - (F.col("z") - means["z"]))))).first()[0]
    assert gap < 1e-9
    top = X.attribution_divergence(X.group_attributions(df, ["g"], coefs)).filter("rank = 1").first()
    assert (top["feature"], top["helps_most"], top["hurts_most"]) == ("x", "a", "b")


def test_sampled_attributions_sum_rule(people):
    df, _ = people
    small = df.limit(60)
    feats = ["x", "z"]
    model = T.fit_classifier(df, feats, "approved", kind="logistic")
    phi = X.sampled_attributions(small, "id", feats, model, pairs=1, background_rows=10)
    score = {r["id"]: r["y_prob"] for r in T.score_table(model, small, feats).collect()}
    for r in phi.groupBy("id").agg(F.sum("phi").alias("s"), F.count("*").alias("k")).collect():
        assert r["k"] == len(feats)
        assert min(abs(score[r["id"]] - r["s"] - b) for b in score.values()) < 1e-9  # some background score


def test_group_attributions_are_within_their_errors_of_exact_shapley_values(spark):
    rng = np.random.default_rng(11)
    n, feats = 240, ["a", "b", "c"]
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=feats).assign(id=np.arange(n), g=np.where(np.arange(n) % 3 == 0, "u", "v"))
    score = lambda x: x[..., 0] * x[..., 1] + x[..., 2] ** 2 * (x[..., 0] > 0)
    df = spark.createDataFrame(pdf)
    formula = F.expr("a * b + c * c * IF(a > 0, 1D, 0D)")
    got = X.group_sampled_attributions(df, "id", feats, formula, ["g"], tolerance=0.02, pairs=4, most_pairs=64, background_rows=40).toPandas()
    order = pdf["id"].map(lambda k: hashlib.md5(f"{k}-bg".encode()).hexdigest()).sort_values().index[:40]
    x, bg = pdf[feats].to_numpy(), pdf.loc[order, feats].to_numpy()
    value = {}
    for on in itertools.product((False, True), repeat=3):
        mixed = np.where(np.array(on), x[:, None, :], bg[None, :, :])
        value[on] = score(mixed).mean(axis=1)
    for i, f in enumerate(feats):
        exact = np.zeros(n)
        for perm in itertools.permutations(range(3)):
            before = tuple(perm.index(j) < perm.index(i) for j in range(3))
            after = tuple(perm.index(j) <= perm.index(i) for j in range(3))
            exact += (value[after] - value[before]) / 6
        for g in ("u", "v"):
            r = got[(got.grp == g) & (got.feature == f)].iloc[0]
            assert abs(r["mean_phi"] - exact[pdf["g"] == g].mean()) < 5 * max(r["std_error"], 0.004) and r["n"] == (pdf["g"] == g).sum()
    assert got["pairs"].nunique() == 1 and 4 < got["pairs"].iloc[0] <= 64  # four are not enough here
    assert (got["settled"] == (got["std_error"] <= 0.02)).all()
    for _, part in got.groupby("grp"):
        assert abs(part["mean_phi"].sum() - (part["mean_score"] - part["mean_reference"]).iloc[0]) < 1e-9
    rows = X.sampled_attributions(df, "id", feats, formula, ["g"], pairs=4, background_rows=40)
    again = X.attributions_by_group(rows, ["g"]).toPandas().set_index(["grp", "feature"])["mean_phi"]
    four = X.group_sampled_attributions(df, "id", feats, formula, ["g"], pairs=4, most_pairs=4, background_rows=40).toPandas().set_index(["grp", "feature"])["mean_phi"]
    assert np.allclose(again.sort_index(), four.sort_index(), atol=1e-12)


def test_attributions_of_one_feature_many_features_and_no_rows(spark):
    one = spark.createDataFrame([(1, 2.0, "u"), (2, None, "u"), (None, 5.0, "v"), (3, 5.0, None)], "id int, a double, g string")
    got = X.group_sampled_attributions(one, "id", ["a"], F.coalesce(F.col("a"), F.lit(0.0)) * 2, ["g"], pairs=2, most_pairs=2).collect()
    assert {(r.grp, r.n) for r in got} == {("u", 2), ("v", 1)}
    assert all(abs(r.mean_phi - (r.mean_score - r.mean_reference)) < 1e-12 for r in got)
    wide = spark.range(30).select("id", F.lit("u").alias("g"), *[(F.col("id") * (i + 1) % 7).cast("double").alias(f"x{i}") for i in range(20)])
    total = sum((F.col(f"x{i}") for i in range(20)), F.lit(0.0))
    out = X.group_sampled_attributions(wide, "id", [f"x{i}" for i in range(20)], total, ["g"], pairs=2, most_pairs=2, background_rows=5).collect()
    assert len(out) == 20 and abs(sum(r.mean_phi for r in out) - (out[0].mean_score - out[0].mean_reference)) < 1e-9
    assert X.group_sampled_attributions(one.filter("id > 9"), "id", ["a"], F.col("a"), ["g"]).count() == 0
    with pytest.raises(ValueError):
        X.sampled_attributions(one, "id", [], F.col("a"))


def test_bootstrap(people):
    df, _ = people
    got = {r["attribute"]: r for r in K.bootstrap_cramers_v(df, ["g", "neutral"], "approved").collect()}
    assert got["g"]["ci_lower"] <= got["g"]["point"] <= got["g"]["ci_upper"] and got["g"]["ci_lower"] > 0.1
    assert rows(K.bootstrap_cramers_v(df, ["g"], "approved")) == rows(K.bootstrap_cramers_v(df.repartition(5), ["g"], "approved"))
    for r in K.bootstrap_rate_ci(df, ["g"], "approved").collect():
        half = 1.96 * math.sqrt(r["point"] * (1 - r["point"]) / r["n"])
        assert 0.6 < r["ci_width"] / (2 * half) < 1.6


def test_pca_and_mca(people, spark):
    df, pdf = people
    num = ["x", "z", "y_prob", "approved"]
    got = K.pca_loadings(df, num, sensitive=["x"]).toPandas()
    cov = np.cov(pdf[num].to_numpy().T)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(-vals)
    assert np.allclose(got.groupby("component")["explained_variance"].first(), (vals[order] / vals.sum()), atol=1e-3)
    pc1 = got[got.component == 1].set_index("feature")["loading"]
    assert np.allclose(pc1[num], np.abs(vecs[:, order[0]]), atol=1e-3)
    assert K.pca_loadings(df, ["x", "z"]).count() == 0
    mca = K.mca_coordinates(df, ["g", "approved"]).toPandas()
    one = mca[mca["dim"] == 1].set_index("category")["coordinate"]
    assert np.sign(one["g=b"]) == np.sign(one["approved=0"]) != np.sign(one["g=a"])
    v = np.sqrt(dict_chi(pdf))
    assert math.isclose(one.abs().pipe(lambda _: mca[mca["dim"] == 1]["inertia"].iloc[0]), (1 + v) / 2, abs_tol=1e-3)


def dict_chi(pdf):
    """chi2 / n of g against approved, uncorrected."""
    t = pd.crosstab(pdf["g"], pdf["approved"]).to_numpy().astype(float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    return ((t - e) ** 2 / e).sum() / t.sum()


def test_smote(people):
    df, pdf = people
    out = G.smote_oversample(df, "id", ["x", "z"], "approved").toPandas()
    sizes = out.groupby("approved").size()
    assert sizes[0] == sizes[1] and (~out["synthetic"]).sum() == len(pdf)
    new, old = out[out.synthetic], out[(~out.synthetic) & (out.approved == out[out.synthetic].approved.iloc[0])]
    assert new["x"].between(old["x"].min(), old["x"].max()).all() and new["approved"].nunique() == 1


def test_constrained_training_closes_the_gap(people):
    df, _ = people
    full = df.filter("g IS NOT NULL").withColumn("b", (F.col("g") == "b").cast("double"))
    parts = IO.written(T.stratified_split(full, "id", "approved"), "parts")
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    feats = ["x", "z", "y_prob"]
    plain = T.score_table(T.fit_classifier(train, feats, "approved", kind="logistic"), test, feats)
    fair = G.fair_training(train, test, feats, "approved", "g", epsilon=0.02)
    gap = lambda d, c: (lambda r: max(r) - min(r))([x[0] for x in d.groupBy("g").agg(F.avg(c)).select("avg(" + c + ")").collect()])
    assert gap(fair, "y_prob") < 0.6 * gap(plain, "y_pred")
    sweep = G.pareto_sweep(train, test, feats, "approved", "g", models=5, rounds=5).toPandas()
    assert len(sweep) == 5 and sweep["accuracy"].iloc[-1] >= sweep["accuracy"].iloc[0] - 0.05


def test_weights(people):
    df, _ = people
    w = G.reweighting_weights(df, "g")
    assert math.isclose(sum(r["n"] * r["weight"] for r in w.collect()), df.filter("g IS NOT NULL").count(), rel_tol=1e-4)
    assert G.apply_weights(df, w, "g").filter("weight IS NULL").count() == 0
    adj = L.label_adjust_weights(df, "g", "approved").toPandas()
    rate = adj.assign(m=adj.n * adj.weight).pivot(index="grp", columns="y", values="m")
    assert np.allclose(*(rate[1] / (rate[0] + rate[1])).to_numpy(), atol=1e-4)


def test_drift(spark):
    rng = np.random.default_rng(7)
    same = [(0, float(v), "a") for v in rng.normal(size=4000)] + [(1, float(v), "a") for v in rng.normal(size=4000)]
    moved = [(2, float(v), "a") for v in rng.normal(1.5, 1, 4000)]
    df = spark.createDataFrame(same + moved, "t int, v double, c string")
    got = {(r["period"], r["feature"]): r for r in N.feature_drift(df, F.col("t") == 0, F.col("t"), ["v", "c"]).collect()}
    assert not got[(1, "v")]["drifted"] and got[(2, "v")]["drifted"] and got[(2, "c")]["psi"] == 0.0


def test_audit_log_appends(spark, people):
    df, _ = people
    path = IO.scratch_folder(spark, "log")
    metrics = M.disparate_impact(df, ["g"], "y_pred").select("attribute", F.lit("di").alias("metric"), F.col("ratio").alias("value"))
    for run in ("r1", "r2"):
        IO.append_log(IO.audit_entries(metrics, run, "v1", df, "none", "me"), path)
    log = spark.read.parquet(path)
    assert log.count() == 2 and log.select("data_version").distinct().count() == 1
    assert rows(IO.fingerprint(df)) == rows(IO.fingerprint(df.repartition(9))) != rows(IO.fingerprint(df.filter("id > 0")))


def _logged(spark, runs, path):
    for run in runs:
        entries = spark.createDataFrame([(run, "g", f"m{i}", float(i) if i else None) for i in range(3)], "run_id string, attribute string, metric string, value double")
        IO.append_log(entries, path)


def _states(spark, path, heads=()):
    return {r.run_id: (r.n_entries, r.status) for r in IO.verify_log(spark, path, heads).collect()}


def test_log_chain_finds_changed_and_lost_runs(spark):
    path = IO.scratch_folder(spark, "log")
    assert _states(spark, path) == {} and IO.log_heads(spark, path) == []
    _logged(spark, ["01", "2", "3"], path)
    heads = IO.log_heads(spark, path)
    whole = {"01": (3, "ok"), "2": (3, "ok"), "3": (3, "ok")}
    assert len(heads) == 1 and _states(spark, path, heads) == whole
    # copies of the log, each with one thing wrong; a copy without a run stands for a lost folder
    log, links = spark.read.schema("attribute string, metric string, value double, run_id string").parquet(path), spark.read.parquet(path + "-chain")

    def copy(entries, chain):
        other = IO.scratch_folder(spark, "log")
        entries.write.partitionBy("run_id").parquet(other)
        chain.write.parquet(other + "-chain")
        return other

    assert _states(spark, copy(log.repartition(2), links), heads) == whole
    changed = log.withColumn("value", F.when((F.col("run_id") == "2") & (F.col("metric") == "m2"), 2.5).otherwise(F.col("value")))
    assert _states(spark, copy(changed, links), heads) == whole | {"2": (3, "changed")}
    filled = log.withColumn("value", F.when(F.col("run_id") == "2", F.coalesce("value", F.lit(0.0))).otherwise(F.col("value")))
    assert _states(spark, copy(filled, links), heads)["2"] == (3, "changed")
    assert _states(spark, copy(log.where("run_id <> '2'"), links), heads) == whole | {"2": (0, "lost")}
    assert _states(spark, copy(log.where("run_id <> '2' or metric <> 'm1'"), links), heads)["2"] == (2, "changed")
    hash_of = {r.run_id: r.hash for r in links.collect()}
    assert _states(spark, copy(log, links.where("run_id <> '2'")), heads) == whole | {"2": (3, "unlinked"), hash_of["2"]: (0, "missing")}
    cut = copy(log.where("run_id <> '3'"), links.where("run_id <> '3'"))  # the last run with its link: only the kept head tells
    assert _states(spark, cut) == {"01": (3, "ok"), "2": (3, "ok")} and _states(spark, cut, heads)[hash_of["3"]] == (0, "missing")
    forged = links.withColumn("n_entries", F.when(F.col("run_id") == "2", 2).otherwise(F.col("n_entries")))
    assert _states(spark, copy(log, forged), heads)["2"] == (3, "forged")


def test_log_chain_of_runs_side_by_side(spark):
    """Two runs follow the same link, as if logged at once; the next one follows both."""
    path = IO.scratch_folder(spark, "log")
    _logged(spark, ["a"], path)
    links = spark.read.parquet(path + "-chain").collect()
    _logged(spark, ["b"], path)
    other = IO.scratch_folder(spark, "log")
    spark.read.schema("attribute string, metric string, value double, run_id string").parquet(path).where("run_id = 'a'").write.partitionBy("run_id").parquet(other)
    spark.createDataFrame(links, IO.LINK).write.parquet(other + "-chain")
    _logged(spark, ["c"], other)  # follows a, as b does
    for folder in ("", "-chain"):
        only = spark.read.schema("attribute string, metric string, value double, run_id string").parquet(other) if not folder else spark.read.parquet(other + folder)
        only = only.where("run_id = 'c'")
        (only.write.mode("append").partitionBy("run_id") if not folder else only.write.mode("append")).parquet(path + folder)
    assert len(IO.log_heads(spark, path)) == 2
    _logged(spark, ["d"], path)
    heads = IO.log_heads(spark, path)
    assert len(heads) == 1 and _states(spark, path, heads) == {r: (3, "ok") for r in "abcd"}
    assert {r.run_id: len(r.previous) for r in spark.read.parquet(path + "-chain").collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    _logged(spark, ["d"], path)
    assert _states(spark, path)["d"] == (6, "repeated")


def test_csv_and_nan(spark):
    path = IO.scratch_folder(spark, "csv")
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, float("nan"))], "id long, s string, v double")
    clean = IO.normalise_nan(df)
    IO.write_csv(clean, path)
    assert rows(IO.read_csv(spark, path, "id long, s string, v double")) == rows(clean) == [(1, "a,b", 1.5), (2, None, None)]


def test_views_have_their_planted_shape(spark, sf):
    df = V.decisions(spark, sf)
    assert df.filter("segment IS NULL").count() > 0 and df.filter("age < 0").count() > 0
    assert df.select("record_id").distinct().count() == df.count()
