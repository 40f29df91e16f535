"""Default thresholds and weights of the audit (every operator takes them as arguments)."""

UNDERREPRESENTED = 0.10
MISSING_GAP = 0.15
CRAMERS_V = 0.30
CORRELATION = 0.30
ALPHA = 0.05
SMALL_SAMPLE = 30
FISHER_CELL = 5
DP_GAP = 0.10
DISPARATE_IMPACT = 0.80
EQUALIZED_ODDS = 0.10
RISK_WEIGHTS = {
    "cramers_v": 0.30,
    "dp_gap": 0.30,
    "imbalance_ratio": 0.15,
    "missing_gap": 0.10,
    "explainability_disparity": 0.10,
    "label_bias": 0.05,
}
RISK_LOW = 0.30
RISK_HIGH = 0.60
SENSITIVITY_PERTURBATION = 0.20
SENSITIVITY_RUNS = 100
SMOTE_NEIGHBORS = 5
PARETO_MODELS = 25
ACCURACY_TOLERANCE = 0.05
DRIFT = 0.15
CHECK_INTERVAL_DAYS = 30
# Status texts of the summaries.
STATUS = {
    "audit_ok": "PASS", "audit_issues": "ISSUES FOUND", "bias": "BIAS DETECTED", "no_bias": "NO SIGNIFICANT BIAS",
    "violations": "FAIRNESS VIOLATIONS DETECTED", "fair": "ALL METRICS PASS",
}
