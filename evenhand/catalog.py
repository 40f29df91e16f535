"""The registered queries: every operator applied to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.functions.hashing import uniform
from evenhand.operators import (
    association as K, audit as A, cleaning as S, explain as X, labels as L, metrics as M, mitigation as G, models as T, monitoring as N, profile as Q, report as P, risk as R,
)
from evenhand.plans.association import chi_square
from evenhand.sources import tables as IO, views as V
from evenhand.streaming import live

ATTRS, ATTRS4 = V.ATTRS, V.ATTRS4
FEATURES = V.NUMERIC
TARGET = "approved"
# A fixed linear score over the numeric features, for the exact attributions.
COEFS = {"age": 0.01, "employment_years": -0.005, "income": 0.00002, "total_price": 0.000001, "branch_tier": -0.2, "skill_score": 0.004}
MODEL_FEATURES = ["age", "employment_years", "income", "total_price", "branch_tier", "skill_score"]

# A score that is not additive, in terms that Spark and DuckDB read alike, and the error its attributions are asked for.
FORMULA = "1e0 / (1e0 + exp(-(2e-2 * (age - 4e1) + 1e-4 * income * (branch_tier - 2e0) + 1e-6 * total_price - 1e-2 * employment_years * coalesce(skill_score, 5e1) / 5e1)))"
FORMULA_ERROR = 0.001

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def by_year(df: DataFrame) -> DataFrame:
    """Decisions with the year as the id of the audited model."""
    return df.withColumn("model_id", F.date_format("decided_at", "yyyy"))


def by_month(df: DataFrame) -> DataFrame:
    """Decisions with the month as the id of the audited model."""
    return df.withColumn("model_id", F.date_format("decided_at", "yyyy-MM"))


# ---- sources and sinks -------------------------------------------------------------------------


@query
def csv_roundtrip(spark, sf):
    path = IO.scratch_folder(spark, "csv")
    IO.write_csv(V.doc_audit(spark, sf), path)
    return IO.read_csv(spark, path, "record_id bigint, lang string, source string, n_chars bigint, quality int, toxic int")


@query
def report_sink(spark, sf):
    path = IO.scratch_folder(spark, "report")
    IO.write_report(A.outcome_distribution(V.decisions(spark, sf), ATTRS, TARGET), path)
    return spark.read.schema("attribute string, grp string, approval_rate double, n bigint").json(path)


@query
def audit_log(spark, sf):
    df = V.decisions(spark, sf)
    log = IO.scratch_folder(spark, "log")
    metrics = M.disparate_impact(df, ATTRS, "y_pred").select("attribute", F.lit("disparate_impact").alias("metric"), F.col("ratio").alias("value"))
    for run in ("run1", "run2"):
        IO.append_log(IO.audit_entries(metrics, run, "v1", V.doc_audit(spark, sf), "none", "auditor"), log)
    out = spark.read.parquet(log)
    return out.select("run_id", "model_version", "data_rows", "data_version", "attribute", "metric", "value", "mitigation", "approved_by")


@query
def audit_chain(spark, sf):
    """Three runs logged one after the other, and what the chain of their hashes tells of each."""
    df = V.decisions(spark, sf)
    log = IO.scratch_folder(spark, "log")
    for run in range(3):
        metrics = M.disparate_impact(df, ATTRS[: run + 1], "y_pred").select("attribute", F.lit("disparate_impact").alias("metric"), F.col("ratio").alias("value"))
        IO.append_log(IO.audit_entries(metrics, f"run{run}", "v1", V.doc_audit(spark, sf), "none", "auditor"), log)
    return IO.verify_log(spark, log, IO.log_heads(spark, log))


@query
def table_profile(spark, sf):
    return S.table_profile(V.decisions(spark, sf))


@query
def growing_profile(spark, sf):
    """Decisions profiled year by year as they would arrive, the last year recorded twice; merged per column of few values."""
    df = by_year(V.decisions(spark, sf)).select("model_id", *V.ATTRS4, "age", "branch_tier", "y_prob", "skill_score")
    path = IO.scratch_folder(spark, "profiles")
    Q.record_profiles(Q.part_profiles(df.filter("model_id < '2000'"), "model_id"), path)
    for _ in range(2):
        Q.record_profiles(Q.part_profiles(df.filter("model_id >= '2000'"), "model_id"), path)
    out = Q.merged_profile(Q.recorded_profiles(spark, path))
    few = F.when(F.col("column_name") != "skill_score", F.col("n_distinct"))  # estimates of many values are tested, not compared
    return out.select("position", "column_name", "dtype", "n", "n_null", few.alias("n_distinct"), *[F.round(c, 4).alias(c) for c in ("low", "high", "mean", "std")])


# ---- cleaning ----------------------------------------------------------------------------------


@query
def inconsistency_removal(spark, sf):
    return S.inconsistency_removal(V.decisions(spark, sf)).select("record_id", "age", "employment_years", "income")


@query
def inconsistency_report(spark, sf):
    return S.inconsistency_report(V.decisions(spark, sf))


@query
def fair_encoding(spark, sf):
    return S.one_hot(V.decisions(spark, sf).select("record_id", "segment", "priority", "balance_sign"), ["priority", "balance_sign"])


@query
def standard_scale(spark, sf):
    cols = ["income", "total_price", "skill_score", "branch_tier"]
    out = S.standard_scale(V.decisions(spark, sf).select("record_id", *cols), cols)
    return out.select("record_id", *[F.round(c, 6).alias(c) for c in cols])


@query
def scaler_stats(spark, sf):
    return S.scaler_stats(V.decisions(spark, sf), ["age", "employment_years", "income", "total_price", "skill_score", "branch_tier"])


@query
def binarize_target(spark, sf):
    df = V.decisions(spark, sf).select("record_id", "total_price", "balance_sign", "y_pred")
    for c in ("total_price", "balance_sign", "y_pred"):
        df = S.binarize_target(df, c, c + "_target")
    return df.select("record_id", "total_price_target", "balance_sign_target", "y_pred_target")


@query
def detect_sensitive(spark, sf):
    return S.detect_sensitive(V.decisions(spark, sf))


@query
def detect_target(spark, sf):
    return S.detect_target(V.decisions(spark, sf))


@query
def feature_selection(spark, sf):
    df = V.decisions(spark, sf)
    names = S.feature_columns(df, TARGET, ["segment", "region"], skip=["record_id", "y_prob", "y_pred"])
    vec = S.feature_matrix(S.median_impute(df, names), "record_id", names)
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array("features")
    return vec.select("record_id", F.size(arr).alias("n_features"), F.round(F.aggregate(arr, F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query
def median_impute(spark, sf):
    df = V.decisions(spark, sf).select("record_id", "skill_score", "income")
    return S.median_impute(df, ["skill_score", "income"])


@query
def quantile_bins(spark, sf):
    df = V.decisions(spark, sf).select("record_id", "total_price", "skill_score", "approved")
    return S.quantile_bins(df, ["total_price", "skill_score", "approved"]).select("record_id", "total_price_bin", "skill_score_bin", "approved_bin")


@query
def quantile_edges(spark, sf):
    out = S.quantile_edges(V.decisions(spark, sf), ["total_price", "skill_score", "income"])
    return out.withColumn("edge", F.round("edge", 4))


@query
def complete_cases(spark, sf):
    return S.complete_cases(V.decisions(spark, sf).select("record_id", "segment", "skill_score"), ["segment", "skill_score"])


@query
def review_sample(spark, sf):
    out = S.review_sample(V.decisions(spark, sf), "record_id", ["region", "approved"], "y_prob", 10)
    return out.select("record_id", "region", "approved", "y_prob", "review_rank")


@query
def drop_proxies(spark, sf):
    df = V.decisions(spark, sf)
    found = K.proxy_detection(df, ["segment"], ["branch_tier", "skill_score", "total_price"])
    return S.drop_proxies(df.select("record_id", "branch_tier", "skill_score", "total_price"), found)


@query
def decorrelate_feature(spark, sf):
    out = S.decorrelate_feature(V.decisions(spark, sf).select("record_id", "segment", "branch_tier"), "segment", "branch_tier")
    return out.withColumn("branch_tier", F.round("branch_tier", 6))


# ---- data audit --------------------------------------------------------------------------------


@query
def group_representation(spark, sf):
    return A.group_representation(V.decisions(spark, sf), ATTRS4)


@query
def underrepresented_groups(spark, sf):
    return A.underrepresented_groups(V.doc_audit(spark, sf), ["lang", "source"])


@query
def missing_by_group(spark, sf):
    return A.missing_by_group(V.decisions(spark, sf), ATTRS, ["segment", "skill_score", "income"])


@query
def missing_gaps(spark, sf):
    return A.missing_gaps(V.decisions(spark, sf), ATTRS, ["skill_score", "income", "priority"], threshold=0.10)


@query
def outcome_distribution(spark, sf):
    return A.outcome_distribution(V.decisions(spark, sf), ATTRS4, TARGET)


@query
def outcome_distribution_docs(spark, sf):
    return A.outcome_distribution(V.doc_audit(spark, sf), ["lang", "source"], "quality")


def _missing(spark, sf):
    df = V.decisions(spark, sf)
    return df, ["segment", "region"], ["skill_score", "segment", "income"], ["age", "income", "total_price", "branch_tier", "skill_score", "approved"]


@query
def missingness_correlations(spark, sf):
    out = A.missingness_correlations(*_missing(spark, sf))
    return out.select("column_name", "other", "kind", F.round("r", 6).alias("r"), "n", F.round("p", 5).alias("p"))


@query
def missingness_class(spark, sf):
    return A.missingness_class(*_missing(spark, sf))


@query
def audit_summary(spark, sf):
    df, attrs, cols, _ = _missing(spark, sf)
    return A.audit_summary(df, attrs, cols)


# ---- association -------------------------------------------------------------------------------


@query
def contingency_table(spark, sf):
    return K.contingency_table(V.decisions(spark, sf), ATTRS4, TARGET)


@query
def contingency_wide(spark, sf):
    out = K.contingency_wide(V.decisions(spark, sf), ATTRS4, TARGET, ["0", "1"])
    return out.select("attribute", "grp", F.col("0").alias("rejected_n"), F.col("1").alias("approved_n"))


@query
def test_pvalues(spark, sf):
    from evenhand.functions.pvalues import chi2_sf

    cells = K.contingency_table(V.decisions(spark, sf), [*ATTRS4, "branch_tier"], TARGET)
    tests = chi_square(cells, ["attribute"], "grp", "y")
    return tests.select("attribute", "dof", F.round("chi_square", 4).alias("statistic"), F.round(chi2_sf("chi_square", "dof"), 6).alias("p_value"))


@query
def chi_square_tests(spark, sf):
    return K.chi_square_tests(V.decisions(spark, sf), ATTRS4, TARGET)


@query
def chi_square_docs(spark, sf):
    return K.chi_square_tests(V.doc_audit(spark, sf), ["lang", "source"], "toxic")


@query
def fisher_exact(spark, sf):
    return K.fisher_exact(V.small_tables(spark, sf), ["source"], "long_text", "toxic")


@query
def cramers_v_target(spark, sf):
    return K.cramers_v_target(V.decisions(spark, sf), ATTRS4, TARGET)


@query
def proxy_detection(spark, sf):
    return K.proxy_detection(V.decisions(spark, sf), ["segment", "region"], [*FEATURES, "priority", "balance_sign"])


@query
def proxy_strength(spark, sf):
    return K.proxy_strength(K.proxy_detection(V.decisions(spark, sf), ["segment", "region"], [*FEATURES, "balance_sign"]))


@query
def point_biserial(spark, sf):
    return K.point_biserial(V.decisions(spark, sf), ATTRS4, FEATURES)


@query
def covariance_matrix(spark, sf):
    out = K.covariance_matrix(V.decisions(spark, sf), ["age", "employment_years", "income", "branch_tier", "skill_score", "approved"])
    return out.withColumn("covariance", F.round("covariance", 4))


@query
def pca_loadings(spark, sf):
    return K.pca_loadings(V.decisions(spark, sf), [*FEATURES, TARGET], sensitive=["branch_tier"])


@query
def pca_moments(spark, sf):
    """Sum and sum of squares of all explained variance shares: trace and squared norm of the covariance matrix tell them."""
    out = K.pca_loadings(V.decisions(spark, sf), [*FEATURES, TARGET], components=len(FEATURES) + 1)
    shares = out.select("component", "explained_variance").distinct()
    lengths = out.groupBy("component").agg(F.sum(F.col("loading") * F.col("loading")).alias("l"))
    return shares.join(lengths, "component").agg(
        F.count(F.lit(1)).alias("components"), F.round(F.sum("explained_variance"), 2).alias("total"),
        F.round(F.sum(F.col("explained_variance") * F.col("explained_variance")), 3).alias("squares"), F.round(F.max(F.abs(F.col("l") - 1)), 2).alias("length_error"),
    )


@query
def mca_moments(spark, sf):
    """Sum of all squared singular values of the standardised Burt matrix, which is its squared norm."""
    out = K.mca_coordinates(V.decisions(spark, sf), ["segment", "region", TARGET], dims=30)
    return out.select("dim", "inertia").distinct().agg(F.round(F.sum(F.col("inertia") * F.col("inertia")), 2).alias("squared_norm"))


@query
def burt_table(spark, sf):
    return K.burt_table(V.decisions(spark, sf), [*ATTRS, TARGET])


@query
def mca_coordinates(spark, sf):
    return K.mca_coordinates(V.decisions(spark, sf), ["segment", "region", TARGET]).drop("coordinate", "residual")


@query
def mca_association(spark, sf):
    """The association of every two categories, put together again from the positions on all dimensions."""
    out = K.mca_association(K.mca_coordinates(V.decisions(spark, sf), ["segment", "region", TARGET], dims=30))
    return out.select("cat_a", "cat_b", (F.round("association", 4) + F.lit(0.0)).alias("association"))


@query
def intersectional_rates(spark, sf):
    return K.intersectional_rates(V.decisions(spark, sf), ATTRS, TARGET)


@query
def intersectional_tests(spark, sf):
    return K.intersectional_tests(V.decisions(spark, sf), ATTRS4, TARGET)


@query
def intersectional_status(spark, sf):
    return K.intersectional_status(V.decisions(spark, sf), ATTRS4, TARGET)


@query
def bootstrap_cramers_v(spark, sf):
    return K.bootstrap_cramers_v(V.decisions(spark, sf), ATTRS, TARGET)


@query
def bootstrap_rate_ci(spark, sf):
    return K.bootstrap_rate_ci(V.decisions(spark, sf), ["segment", "region"], TARGET)


@query
def bootstrap_metric_ci(spark, sf):
    return K.bootstrap_metric_ci(V.decisions(spark, sf), ATTRS, TARGET, "y_pred")


@query
def bootstrap_score_ci(spark, sf):
    return M.bootstrap_score_ci(V.decisions(spark, sf), [*ATTRS, "balance_sign"], TARGET, "y_prob")


@query
def metric_confidence(spark, sf):
    return K.metric_confidence(K.bootstrap_rate_ci(V.doc_audit(spark, sf), ["lang", "source"], "quality"))


@query
def bias_summary(spark, sf):
    return K.bias_summary(V.decisions(spark, sf), ATTRS4, TARGET, FEATURES)


# ---- labels ------------------------------------------------------------------------------------


@query
def label_distribution(spark, sf):
    return L.label_distribution(V.decisions(spark, sf), ATTRS4, TARGET)


@query
def label_disparity(spark, sf):
    return L.label_disparity(V.decisions(spark, sf), ATTRS4, TARGET)


@query
def label_independence(spark, sf):
    return L.label_independence(V.decisions(spark, sf), ATTRS4, TARGET)


@query
def counterfactual_gap(spark, sf):
    return L.counterfactual_gap(V.decisions(spark, sf), ATTRS4, TARGET)


@query
def matched_counterfactual(spark, sf):
    return L.matched_counterfactual(V.decisions(spark, sf), ["segment", "region"], TARGET, ["priority", "branch_tier", "total_price"])


@query
def outcome_vs_label(spark, sf):
    real = V.outcomes(spark, sf).groupBy("record_id").agg(F.min("outcome").alias("outcome"))
    return L.outcome_vs_label(V.decisions(spark, sf), real, "record_id", ["segment", "region"], TARGET)


@query
def label_bias_score(spark, sf):
    return L.label_bias_score(V.decisions(spark, sf), ATTRS4, TARGET)


@query
def label_gate(spark, sf):
    return L.label_gate(L.label_bias_score(by_year(V.decisions(spark, sf)), ATTRS4, TARGET, by=["model_id"]))


@query
def label_adjust_weights(spark, sf):
    return L.label_adjust_weights(V.decisions(spark, sf), "segment", TARGET)


# ---- models and attributions -------------------------------------------------------------------


@query
def stratified_split(spark, sf):
    return T.stratified_split(V.decisions(spark, sf), "record_id", TARGET).select("record_id", "approved", "split")


def _split(spark, sf):
    """The split decisions as a written table: model fitting passes over them many times."""
    return IO.written(T.stratified_split(V.decisions(spark, sf), "record_id", TARGET), "split")


@query
def train_scores(spark, sf):
    out = T.train_scores(V.decisions(spark, sf), "record_id", MODEL_FEATURES, TARGET)
    return out.select("record_id", "approved", "y_pred", F.round("y_prob", 4).alias("y_prob"))


@query
def score_counts(spark, sf):
    """Rows per split and label of the scored table, and the rows whose decision is not that of their score."""
    parts = _split(spark, sf)
    model = T.fit_classifier(parts.filter("split = 'train'"), MODEL_FEATURES, TARGET, kind="logistic")
    out = T.score_table(model, parts, MODEL_FEATURES)
    wrong = F.col("y_prob").isNull() | (F.col("y_pred") != (F.col("y_prob") > 0.5).cast("int")) | ~F.col("y_prob").between(0, 1)
    return out.groupBy("split", "approved").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("n_wrong"))


@query
def score_table(spark, sf):
    parts = _split(spark, sf)
    model = T.fit_classifier(parts.filter("split = 'train'"), MODEL_FEATURES, TARGET, kind="logistic")
    return T.score_table(model, parts, MODEL_FEATURES).select("record_id", "split", "y_pred", F.round("y_prob", 4).alias("y_prob"))


@query
def accuracy(spark, sf):
    return T.accuracy(V.decisions(spark, sf), TARGET, "y_pred", ATTRS)


@query
def linear_attributions(spark, sf):
    return X.linear_attributions(V.decisions(spark, sf), "record_id", COEFS).withColumn("phi", F.round("phi", 6))


@query
def group_attributions(spark, sf):
    return X.group_attributions(V.decisions(spark, sf), ATTRS, COEFS).withColumn("mean_phi", F.round("mean_phi", 4))


def _divergence(spark, sf):
    return X.attribution_divergence(X.group_attributions(V.decisions(spark, sf), ATTRS, COEFS))


@query
def attribution_divergence(spark, sf):
    return _divergence(spark, sf)


@query
def explainability_disparity(spark, sf):
    return X.explainability_disparity(_divergence(spark, sf))


@query
def root_cause_ranking(spark, sf):
    return X.root_cause_ranking(_divergence(spark, sf))


@query
def feature_proxy_report(spark, sf):
    df = V.decisions(spark, sf)
    return X.feature_proxy_report(df, K.proxy_detection(df, ["segment", "region"], FEATURES), COEFS)


@query
def sampled_attributions(spark, sf):
    df = V.decisions(spark, sf)
    parts = _split(spark, sf)
    model = T.fit_classifier(parts.filter("split = 'train'"), MODEL_FEATURES, TARGET, kind="logistic")
    return X.attribution_divergence(X.group_sampled_attributions(df, "record_id", MODEL_FEATURES, model, ATTRS))


@query
def formula_attributions(spark, sf):
    """Sampled attributions of a score with interactions, in one round of four pairs of orders."""
    out = X.group_sampled_attributions(V.decisions(spark, sf), "record_id", MODEL_FEATURES, F.expr(FORMULA), ATTRS, tolerance=FORMULA_ERROR, pairs=4, most_pairs=4)
    digits = ("mean_phi", "std_error", "mean_score", "mean_reference")
    return out.select(*[F.round(c, 6).alias(c) if c in digits else c for c in out.columns])


# ---- fairness metrics --------------------------------------------------------------------------


@query
def selection_rates(spark, sf):
    return M.selection_rates(V.decisions(spark, sf), ATTRS4, "y_pred")


@query
def demographic_parity(spark, sf):
    return M.demographic_parity(V.decisions(spark, sf), ATTRS4, "y_pred")


@query
def demographic_parity_ratio(spark, sf):
    return M.demographic_parity_ratio(V.decisions(spark, sf), ATTRS4, "y_pred")


@query
def group_confusion(spark, sf):
    return M.group_confusion(V.decisions(spark, sf), ATTRS4, TARGET, "y_pred")


@query
def error_rates(spark, sf):
    return M.error_rates(V.decisions(spark, sf), ATTRS4, TARGET, "y_pred")


@query
def equalized_odds(spark, sf):
    return M.equalized_odds(V.decisions(spark, sf), ATTRS4, TARGET, "y_pred")


@query
def disparate_impact(spark, sf):
    return M.disparate_impact(V.decisions(spark, sf), ATTRS4, "y_pred")


@query
def disparate_impact_labels(spark, sf):
    return M.disparate_impact_labels(V.decisions(spark, sf), ATTRS4, TARGET)


@query
def calibration_curve(spark, sf):
    return M.calibration_curve(V.decisions(spark, sf), ATTRS, TARGET, "y_prob")


@query
def calibration_error(spark, sf):
    return M.calibration_error(V.decisions(spark, sf), ATTRS, TARGET, "y_prob")


@query
def wasserstein_prob(spark, sf):
    df = V.decisions(spark, sf).withColumn("africa", F.when(F.col("region") == "AFRICA", "yes").otherwise("no"))
    return M.wasserstein_prob(df, ["balance_sign", "africa", "segment"], "y_prob")


@query
def lipschitz_pairs(spark, sf):
    return M.lipschitz_pairs(V.decisions(spark, sf), ["segment", "region"], "y_prob", ["priority", "branch_tier", "total_price"])


@query
def individual_fairness(spark, sf):
    cols = ["total_price", "income", "skill_score"]
    rows = S.median_impute(V.decisions(spark, sf).select("record_id", "region", "balance_sign", "y_prob", *cols), cols)
    return M.individual_fairness(rows, ["region"], "record_id", "y_prob", cols)


@query
def fairness_summary(spark, sf):
    return M.fairness_summary(V.decisions(spark, sf), ATTRS4, TARGET, "y_pred")


@query
def attribute_verdict(spark, sf):
    return M.attribute_verdict(V.decisions(spark, sf), ATTRS4, TARGET)


@query
def issue_list(spark, sf):
    return M.issue_list(V.decisions(spark, sf), ATTRS4, TARGET, FEATURES)


# ---- risk --------------------------------------------------------------------------------------


def _risk(df):
    """Components per model, from one group table."""
    groups = IO.written(P.group_table(df, ATTRS4, TARGET, "y_pred", ["skill_score", "income"], list(COEFS), ["model_id"]), "groups")
    return IO.written(P.components(groups, ["skill_score", "income"], COEFS, attrs=ATTRS), "components")


def _risk_inputs(spark, sf):
    """Components of the models of every month."""
    return _risk(by_month(V.decisions(spark, sf)))


@query
def risk_components(spark, sf):
    return _risk(by_year(V.decisions(spark, sf)))


@query
def audit_run(spark, sf):
    """The audit of every year's model; the phases are written as the report sink does and read back."""
    out = P.audit_run(by_year(V.decisions(spark, sf)), ATTRS, TARGET, "y_pred", ["skill_score", "income"], COEFS)
    path = P.write_phases(out)
    return spark.read.schema("model_id string, attribute string, metric string, value double, phase string").json(path)


@query
def risk_score(spark, sf):
    return R.risk_score(_risk_inputs(spark, sf))


@query
def risk_score_simple(spark, sf):
    df = by_year(V.decisions(spark, sf))
    stats = L.label_disparity(df, ATTRS4, TARGET, ["model_id"]).join(K.cramers_v_target(df, ATTRS4, TARGET, ["model_id"]), ["model_id", "attribute"])
    parts = R.simple_components(stats.withColumnRenamed("ratio", "di"), A.underrepresented_groups(df, ATTRS4, by=["model_id"]))
    return R.risk_score_simple(parts)


@query
def risk_sensitivity(spark, sf):
    return R.risk_sensitivity(_risk_inputs(spark, sf))


@query
def worst_component(spark, sf):
    return R.worst_component(_risk_inputs(spark, sf))


def _sweep(spark, sf):
    """Accuracy and parity gap of every month's model at 25 score thresholds."""
    return IO.written(R.threshold_sweep(by_month(V.decisions(spark, sf)), "model_id", "region", TARGET, "y_prob"), "sweep")


@query
def pareto_frontier(spark, sf):
    return R.pareto_frontier(_sweep(spark, sf))


@query
def best_balanced(spark, sf):
    return R.best_balanced(R.pareto_frontier(_sweep(spark, sf)))


@query
def threshold_sweep(spark, sf):
    return _sweep(spark, sf)


def _train_test(spark, sf):
    parts = _split(spark, sf).select("record_id", "segment", "region", "approved", *MODEL_FEATURES, "split")
    train = parts.filter("split = 'train'")
    full = S.standard_scale(S.median_impute(parts, MODEL_FEATURES, fit_on=train), MODEL_FEATURES, fit_on=train)
    full = IO.written(full, "train-test")
    return full.filter("split = 'train'"), full.filter("split = 'test'")


@query
def pareto_sweep(spark, sf):
    train, test = _train_test(spark, sf)
    return G.pareto_sweep(train, test, MODEL_FEATURES, TARGET, "region")


@query
def pareto_sweep_bounds(spark, sf):
    """The trained strengths, and whether each keeps its bound on the train rows and ends with a small duality gap."""
    out = pareto_sweep(spark, sf)
    return out.select(F.floor(F.col("epsilon") * 1000).alias("strength_permille"), (F.col("train_gap") <= F.col("epsilon")).alias("within_bound"), (F.col("solved") & (F.col("duality_gap") <= 0.005)).alias("solved"))


@query
def mitigation_run(spark, sf):
    """Every level's techniques on the split decisions."""
    parts = _split(spark, sf).select("record_id", "segment", "region", "approved", *MODEL_FEATURES, "split")
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    baseline = G.mitigation_baseline(train, test, MODEL_FEATURES, TARGET)
    runs = [G.run_mitigation(train, test, "record_id", MODEL_FEATURES, TARGET, "region", level, baseline=baseline) for level in G.PLAN]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query
def mitigation_checks(spark, sf):
    """What must hold of :func:`mitigation_run` whatever the models are: one original accuracy, consistent changes, the
    most accurate technique chosen."""
    out = IO.written(mitigation_run(spark, sf), "mitigation")
    first = out.agg(F.min("original_accuracy").alias("a")).scalar()
    best = out.groupBy("level").agg(F.max("mitigated_accuracy").alias("best"))
    steady = (F.col("original_accuracy") == first) & (F.abs(F.col("mitigated_accuracy") - F.col("original_accuracy") - F.col("accuracy_change")) < 2e-4)
    return out.join(best, "level").select(
        "level", "technique", steady.alias("consistent"), (F.col("within_tolerance") == (F.abs("accuracy_change") <= 0.05)).alias("tolerance_right"),
        (~F.col("chosen") | (F.col("mitigated_accuracy") == F.col("best"))).alias("choice_right"),
    )

@query
def recommendation_codes(spark, sf):
    return R.recommendation_codes(_risk_inputs(spark, sf))


# ---- mitigation --------------------------------------------------------------------------------


@query
def reweighting_weights(spark, sf):
    return G.reweighting_weights(V.doc_audit(spark, sf), "lang")


@query
def reweighted_scores(spark, sf):
    parts = _split(spark, sf)
    train = parts.filter("split = 'train'")
    weighted = G.apply_weights(train, G.reweighting_weights(train, "segment"), "segment")
    model = T.fit_classifier(weighted, MODEL_FEATURES, TARGET, kind="logistic", weight="weight")
    out = T.score_table(model, parts.filter("split = 'test'"), MODEL_FEATURES)
    return M.demographic_parity(out, ATTRS, "y_pred")


KNN_FEATURES = ["income", "total_price", "skill_score"]


@query
def minority_knn(spark, sf):
    rows = V.decisions(spark, sf).filter("approved = 1").select("record_id", *KNN_FEATURES)
    out = G.minority_knn(rows, "record_id", KNN_FEATURES)
    return out.withColumn("distance", F.round("distance", 4))


def _smote(spark, sf):
    return G.smote_oversample(V.decisions(spark, sf), "record_id", KNN_FEATURES, TARGET)


@query
def smote_oversample(spark, sf):
    return _smote(spark, sf).select("record_id", "approved", "synthetic", *[F.round(c, 3).alias(c) for c in KNN_FEATURES])


@query
def smote_checks(spark, sf):
    """Per class: rows in all, and the synthetic rows outside of their class's range of any feature."""
    out = IO.written(_smote(spark, sf), "smote")
    own = out.filter("NOT synthetic").groupBy("approved").agg(*[f(c).alias(f"{n}_{c}") for c in KNN_FEATURES for n, f in (("lo", F.min), ("hi", F.max))])
    outside = sum(((F.col(c) < F.col("lo_" + c)) | (F.col(c) > F.col("hi_" + c))).cast("int") for c in KNN_FEATURES)
    return out.join(own, "approved").groupBy("approved").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("synthetic") & (outside > 0)).alias("n_outside"))


@query
def smote_counts(spark, sf):
    return _smote(spark, sf).groupBy("approved", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query
def fair_training(spark, sf):
    train, test = _train_test(spark, sf)
    out = G.fair_training(train, test, MODEL_FEATURES, TARGET, "region")
    return out.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.first("solved").alias("solved"), F.round(F.avg("y_prob"), 4).alias("selection"), F.round(F.avg((F.col("y_pred") == F.col("approved")).cast("int")), 4).alias("accuracy")
    )


@query
def grid_thresholds(spark, sf):
    """One threshold per group at the best whole-percent rate."""
    return G.group_thresholds(V.decisions(spark, sf), "region", TARGET, "y_prob")


def _thresholds(spark, sf):
    """Thresholds fitted on the train rows, and the test rows."""
    parts = _split(spark, sf)
    return IO.written(G.equal_rate_thresholds(parts.filter("split = 'train'"), "region", TARGET, "y_prob"), "thresholds"), parts.filter("split = 'test'")


@query
def group_thresholds(spark, sf):
    out, _ = _thresholds(spark, sf)
    return out.select("grp", "strict", "loose", F.round("mix", 6).alias("mix"), F.round("common_rate", 6).alias("common_rate"), "accuracy")


@query
def apply_thresholds(spark, sf):
    """The train rows' thresholds on the test rows: each row's chance, and its drawn decision."""
    found, test = _thresholds(spark, sf)
    rows = G.mixed_selection(G.apply_mixed(test, found, "region", "y_prob", "record_id"), found, "region", "y_prob")
    return rows.select("record_id", "region", F.round("y_select", 6).alias("y_select"), "y_pred")


@query
def mitigation_plan(spark, sf):
    return G.mitigation_plan(R.risk_score(_risk_inputs(spark, sf)))


@query
def accuracy_change(spark, sf):
    """Accuracy of every month's test decisions as they are, and at the threshold that balances its train rows best."""
    parts = by_month(_split(spark, sf))
    test = parts.filter("split = 'test'")
    sweep = IO.written(R.threshold_sweep(parts.filter("split = 'train'"), "model_id", "region", TARGET, "y_prob"), "sweep")
    chosen = R.best_balanced(R.pareto_frontier(sweep)).select("model_id", "epsilon")
    right = lambda pred: F.round(F.avg((pred == F.col(TARGET)).cast("int")), 4).alias("accuracy")
    before = test.groupBy("model_id").agg(right(F.col("y_pred")))
    after = test.join(chosen, "model_id").groupBy("model_id").agg(right((F.col("y_prob") >= F.col("epsilon")).cast("int")))
    return G.accuracy_change(before, after)


@query
def revalidation_diff(spark, sf):
    """The test rows' metrics as decided and by the train rows' thresholds."""
    found, test = _thresholds(spark, sf)
    after = IO.written(G.apply_mixed(test, found, "region", "y_prob", "record_id"), "after")
    return G.revalidation_diff(
        G.fairness_metrics_long(test, ["segment", "region"], TARGET, "y_pred"), G.fairness_metrics_long(after, ["segment", "region"], TARGET, "y_pred")
    )


# ---- monitoring --------------------------------------------------------------------------------

BASELINE_END = "1996-01-01"


def _drift_args():
    return F.col("decided_at") < F.lit(BASELINE_END).cast("timestamp_ntz"), F.date_trunc("year", "decided_at").cast("timestamp_ntz")


@query
def di_trend(spark, sf):
    return N.di_trend(V.decisions(spark, sf), "decided_at", ["region", "segment"], "y_pred", "year")


@query
def di_trend_days(spark, sf):
    return N.di_trend(V.decision_stream(spark, sf), "ts", ["grp"], TARGET, "30 days")


@query
def feature_drift(spark, sf):
    return N.feature_drift(V.decisions(spark, sf), *_drift_args(), ["total_price", "skill_score", "segment", "branch_tier"])


@query
def drift_class(spark, sf):
    return N.drift_class(V.decisions(spark, sf), *_drift_args(), ["total_price", "skill_score"], ["region"], threshold=0.01, uneven=0.005)


@query
def feedback_loop(spark, sf):
    return N.feedback_loop(V.decisions(spark, sf), V.outcomes(spark, sf), "record_id", "decided_at", "observed_at", "y_pred", ["region", "segment"], limit=0.02)


@query
def fairness_alerts(spark, sf):
    df = V.decisions(spark, sf)
    trend = N.di_trend(df, "decided_at", ["region", "segment"], "y_pred", "year")
    drift = N.feature_drift(df, *_drift_args(), ["total_price", "segment"], threshold=0.001)
    loops = N.feedback_loop(df, V.outcomes(spark, sf), "record_id", "decided_at", "observed_at", "y_pred", ["region"], limit=0.02)
    return N.fairness_alerts(trend, drift, loops)


@query
def late_report(spark, sf):
    df = V.decision_stream(spark, sf)
    # one row in twenty arrives two days later
    late = F.when(uniform(F.col("record_id"), "l") < 0.05, F.col("ts") + F.expr("INTERVAL 2 DAYS")).otherwise(F.col("ts"))
    return N.late_report(df.withColumn("arrived", late), "ts", "arrived", "1 day", "12 HOURS")


@query
def stream_di_trend(spark, sf):
    schema = IO.load(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    path, state = IO.scratch_folder(spark, "stream"), IO.scratch_folder(spark, "state")
    result = live.stream_di_trend(V.decision_stream_columns(source), "ts", ["grp"], TARGET, "1 day", "12 hours")
    live.append_to(result, path, state).awaitTermination()
    whole = live.stream_di_trend(V.decision_stream(spark, sf), "ts", ["grp"], TARGET, "1 day", "12 hours")
    return live.with_open_windows(spark.read.schema(result.schema).parquet(path), whole, ["period", "attribute"])


@query
def stream_feedback_loop(spark, sf):
    """Feedback pairs joined on the live streams; pairs per attribute group against the batch."""
    orders, lines = IO.load(spark, sf, "orders").schema, IO.load(spark, sf, "lineitem").schema
    read = lambda name, schema: spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    decided = read("orders", orders).select(F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("decided_at"), F.col("o_orderpriority").alias("priority"))
    seen = read("lineitem", lines).select(
        F.col("l_orderkey").alias("record_id"), F.col("l_shipdate").alias("observed_at"), (F.col("l_returnflag") != "R").cast("int").alias("outcome")
    )
    # the files hold all days at once, so the watermark's delay spans them
    pairs = live.stream_feedback_pairs(decided, seen, "record_id", "decided_at", "observed_at", delay="4000 days")
    path = IO.scratch_folder(spark, "pairs")
    live.append_to(pairs, path, IO.scratch_folder(spark, "state")).awaitTermination()
    found = spark.read.schema(pairs.schema).parquet(path)
    return found.groupBy("priority").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("outcome"), 4).alias("success"))


@query
def stream_feedback(spark, sf):
    """The feedback loop from moments of live streams: orders above a price as decisions, returned lines as outcomes. Windows
    the watermark has not closed yet come from the same operator over the rows as a batch."""
    schemas = {name: IO.load(spark, sf, name).schema for name in ("orders", "lineitem")}

    def moments(read):
        decided = read("orders").select(
            F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("decided_at"), (F.col("o_totalprice") >= 150000).cast("int").alias("y_pred"), F.col("o_orderpriority").alias("priority")
        )
        seen = read("lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_shipdate").alias("observed_at"), (F.col("l_returnflag") != "R").cast("int").alias("outcome"))
        return live.stream_feedback_moments(decided, seen, "record_id", "decided_at", "observed_at", "y_pred", ["priority"])

    result = moments(lambda name: spark.readStream.schema(schemas[name]).option("pathGlobFilter", f"{name}.parquet").parquet(sf))
    path = IO.scratch_folder(spark, "moments")
    live.append_to(result, path, IO.scratch_folder(spark, "state"), on_disk=True).awaitTermination()
    whole = moments(lambda name: IO.load(spark, sf, name))
    found = live.with_open_windows(spark.read.schema(result.schema).parquet(path), whole, ["window", "attribute", "grp"])
    return live.feedback_of_moments(found, limit=0.02)
