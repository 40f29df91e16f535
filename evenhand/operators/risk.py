"""Risk scores as table operators: one row per audited model, thousands of models per job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.functions.hashing import uniform_py
from evenhand.functions.numeric import binary, cap1, level3
from evenhand.plans import defaults
from evenhand.plans.ordered import add_piece, cut_points, running_min_above
from evenhand.sources.tables import written


def risk_components(
    keys: DataFrame, key: str, association: DataFrame, parity: DataFrame, underrepresented: DataFrame, gaps: DataFrame,
    explainability: DataFrame, labels: DataFrame,
) -> DataFrame:
    """The six components per model from the audit tables (each carrying ``key``): largest V,
    largest parity gap, 0.2 per underrepresented group, largest missing gap, attribution disparity
    and label bias, each at most 1 and 0 where a table has nothing."""
    parts = [
        association.select(key, F.lit("cramers_v").alias("component"), F.col("cramers_v").alias("v")),
        parity.select(key, F.lit("dp_gap").alias("component"), (F.col("gap") / 100).alias("v")),
        underrepresented.groupBy(key).agg(F.count(F.lit(1)).alias("c")).select(key, F.lit("imbalance_ratio").alias("component"), (F.col("c") * 0.2).alias("v")),
        gaps.select(key, F.lit("missing_gap").alias("component"), (F.col("gap_pct") / 100).alias("v")),
        explainability.select(key, F.lit("explainability_disparity").alias("component"), F.col("disparity_score").alias("v")),
        labels.select(key, F.lit("label_bias").alias("component"), F.col("label_bias").alias("v")),
    ]
    names = F.explode(F.array(*[F.lit(c) for c in defaults.RISK_WEIGHTS]))
    found = keys.select(key, names.alias("component")).withColumn("v", F.lit(0.0).cast("double"))
    for p in parts:
        found = found.unionByName(p.select(key, "component", F.col("v").cast("double").alias("v")))
    return found.groupBy(key, "component").agg(F.round(cap1(F.max("v")), 4).alias("value"))


def _wide(components: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    return components.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("component") == c, F.col("value"))), F.lit(0.0)).alias(c) for c in names])


def risk_level(score: Column, low: float = defaults.RISK_LOW, high: float = defaults.RISK_HIGH) -> Column:
    return level3(score, [("LOW", low), ("MEDIUM", high)], "HIGH")


def _weighted(weights: dict[str, float]) -> Column:
    return cap1(sum((F.lit(float(w)) * F.col(c) for c, w in weights.items()), F.lit(0.0)))


def risk_score(components: DataFrame, key: str = "model_id", weights: dict[str, float] = defaults.RISK_WEIGHTS) -> DataFrame:
    """Weighted sum of the components, at most 1, and its level."""
    out = _wide(components, key, list(weights)).select(key, F.round(_weighted(weights), 4).alias("score"))
    return out.withColumn("level", risk_level(F.col("score")))


# Weights of the simple score.
SIMPLE_WEIGHTS = {"association": 0.35, "approval_gap": 0.35, "di_deviation": 0.20, "imbalance": 0.10}


def simple_components(stats: DataFrame, small_groups: DataFrame, key: str = "model_id") -> DataFrame:
    """Components of the simple score per model from per-attribute label statistics
    (``gap, di, cramers_v``) and the table of underrepresented groups."""
    per = stats.groupBy(key).agg(
        cap1(F.max("cramers_v")).alias("association"), cap1(F.max("gap") / 100).alias("approval_gap"),
        F.greatest(F.lit(0.0), 1 - F.min("di")).alias("di_deviation"),
    )
    small = small_groups.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    return per.join(small, key, "left").select(
        key, "association", "approval_gap", "di_deviation", cap1(F.coalesce("_c", F.lit(0)) * 0.15).alias("imbalance")
    )


def risk_score_simple(parts: DataFrame, key: str = "model_id") -> DataFrame:
    """Four-part score; HIGH above 0.6, MEDIUM above 0.3."""
    score = sum((F.lit(w) * F.col(c) for c, w in SIMPLE_WEIGHTS.items()), F.lit(0.0))
    s = F.col("score")
    return parts.select(key, F.round(score, 4).alias("score")).withColumn("level", F.when(s > 0.6, "HIGH").when(s > 0.3, "MEDIUM").otherwise("LOW"))


def perturbed_weights(weights: dict[str, float], runs: int, width: float) -> list[dict[str, float]]:
    """Every run scales each weight by 1 +- width (hash noise) and renormalises."""
    out = []
    for run in range(1, runs + 1):
        raw = {c: max(0.0, w + (uniform_py(f"{run}-{c}-n") * 2 - 1) * width * w) for c, w in weights.items()}
        total = sum(raw.values())
        out.append({c: v / total for c, v in raw.items()})
    return out


def risk_sensitivity(
    components: DataFrame, key: str = "model_id", weights: dict[str, float] = defaults.RISK_WEIGHTS, runs: int = defaults.SENSITIVITY_RUNS,
    width: float = defaults.SENSITIVITY_PERTURBATION, low_bound: float = defaults.RISK_LOW, high_bound: float = defaults.RISK_HIGH,
) -> DataFrame:
    """Score range and level stability under perturbed weights; borderline below 85 %.

    All runs are scored as expressions inside each model's row: no copy of the table per run.
    """
    dots = (" + ".join(f"{r[c]!r}D * `{c}`" for c in weights) for r in perturbed_weights(weights, runs, width))
    scores = F.expr("array(" + ", ".join(f"least({d}, 1D)" for d in dots) + ")")
    scored = _wide(components, key, list(weights)).select(key, scores.alias("s"))
    total = lambda col: F.aggregate(col, F.lit(0.0), lambda s, x: s + x)
    spread = F.transform("s", lambda x: (x - F.col("_mean")) * (x - F.col("_mean")))
    stats = scored.withColumn("_mean", total(F.col("s")) / runs).withColumn("std", F.sqrt(total(spread) / runs))
    low = F.size(F.filter("s", lambda x: x < low_bound))
    high = F.size(F.filter("s", lambda x: x >= high_bound))
    counted = stats.select(key, "s", "std", low.alias("low"), (F.lit(runs) - low - high).alias("medium"), high.alias("high"))
    stable = F.greatest("low", "medium", "high") / F.lit(float(runs))
    return counted.select(
        key, F.round(F.array_min("s"), 4).alias("min_score"), F.round(F.array_max("s"), 4).alias("max_score"), F.round("std", 4).alias("std"),
        "low", "medium", "high", F.round(stable * 100, 1).alias("stability"), (stable < 0.85).alias("borderline"),
    )


def worst_component(components: DataFrame, key: str = "model_id") -> DataFrame:
    """Largest component of every model (first name on ties)."""
    return components.groupBy(key).agg(F.min_by("component", F.struct(-F.col("value"), "component")).alias("component"), F.max("value").alias("value"))


def threshold_sweep(df: DataFrame, key: str, group: str, target: str, prob: str, runs: int = defaults.PARETO_MODELS) -> DataFrame:
    """``key, run_id, epsilon, accuracy, dp_gap``: accuracy and parity gap of every model at ``runs`` score thresholds.

    Rows are counted once per (model, group, number of thresholds below the score); a threshold's selection
    follows from those counts, so no row is copied per run. A row is selected when its score reaches the threshold.
    """
    cuts = [round(i / (runs + 1), 4) for i in range(1, runs + 1)]
    p, y = F.col(prob).cast("double"), binary(target)
    passed = sum(((p >= c).cast("int") for c in cuts), F.lit(0))
    rows = df.filter(F.col(group).isNotNull() & p.isNotNull() & y.isNotNull()).select(key, F.col(group).cast("string").alias("_g"), passed.alias("_k"), y.alias("_y"))
    cells = rows.groupBy(key, "_g", "_k").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))
    spread = cells.withColumn("run_id", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    chosen = F.col("_k") >= F.col("run_id")
    right = F.when(chosen, F.col("pos")).otherwise(F.col("n") - F.col("pos"))
    per = spread.groupBy(key, "run_id", "_g").agg(F.sum("n").alias("n"), F.sum(F.when(chosen, F.col("n")).otherwise(0)).alias("sel"), F.sum(right).alias("right"))
    rate = F.col("sel") / F.col("n")
    at = F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("run_id"))
    return per.groupBy(key, "run_id").agg(F.round(F.sum("right") / F.sum("n"), 4).alias("accuracy"), F.round(F.max(rate) - F.min(rate), 4).alias("dp_gap")).select(
        key, "run_id", at.alias("epsilon"), "accuracy", "dp_gap"
    )


def pareto_frontier(results: DataFrame, key: str = "model_id", accuracy: str = "accuracy", gap: str = "dp_gap") -> DataFrame:
    """Results not dominated on accuracy (up) and gap (down) within their key.

    A result is on the frontier when its gap is the smallest at its accuracy and smaller than every
    gap at a higher accuracy. Results are first reduced to the smallest gap per accuracy; the
    running minimum works on pieces of the accuracy axis, so a hot key is not sorted in one task.
    """
    best = written(results.groupBy(key, accuracy).agg(F.min(gap).alias("_gap")), "best")
    cuts = cut_points(best, accuracy)
    run = running_min_above(add_piece(best, accuracy, cuts), [key], accuracy, "_gap")
    kept = run.filter(F.col("best_above").isNull() | (F.col("_gap") < F.col("best_above"))).select(key, accuracy, F.col("_gap").alias(gap))
    return results.join(kept, [key, accuracy, gap], "left_semi").select(*results.columns)


def best_balanced(frontier: DataFrame, key: str = "model_id", accuracy: str = "accuracy", gap: str = "dp_gap", tie: str = "run_id") -> DataFrame:
    """The frontier result nearest to (best accuracy, smallest gap) after min-max scaling."""
    span = frontier.groupBy(key).agg(F.min(accuracy).alias("a0"), F.max(accuracy).alias("a1"), F.min(gap).alias("g0"), F.max(gap).alias("g1"))
    both = frontier.join(span, key)
    a = (F.col(accuracy) - F.col("a0")) / (F.col("a1") - F.col("a0") + 1e-10)
    g = (F.col(gap) - F.col("g0")) / (F.col("g1") - F.col("g0") + 1e-10)
    dist = both.withColumn("distance", F.sqrt((1 - a) * (1 - a) + g * g))
    row = F.struct(F.round("distance", 9).alias("d"), F.col(tie), F.struct(*frontier.columns, "distance").alias("r"))
    return dist.groupBy(key).agg(F.min(row).alias("m")).select("m.r.*").withColumn("distance", F.round("distance", 6))


# Advice codes in priority order; the first three follow the level, the others a component limit.
COMPONENT_ADVICE = (
    (2, "IN_PROCESSING", "cramers_v", 0.3),
    (3, "THRESHOLD_ADJUSTMENT", "dp_gap", 0.1),
    (4, "EXPERT_RELABELLING", "label_bias", 0.3),
    (5, "OVERSAMPLING", "imbalance_ratio", 0.2),
)


def recommendation_codes(components: DataFrame, key: str = "model_id", weights: dict[str, float] = defaults.RISK_WEIGHTS) -> DataFrame:
    """Prioritised advice codes per model: one for the level, one per component over its limit and
    one for a borderline level."""
    wide = _wide(components, key, list(weights)).withColumn("level", risk_level(F.round(_weighted(weights), 4)))
    first = F.when(F.col("level") == "HIGH", "DO_NOT_DEPLOY").when(F.col("level") == "MEDIUM", "REVIEW_REQUIRED").otherwise("CONTINUE_MONITORING")
    items = [F.struct(F.lit(1).alias("priority"), first.alias("code"))]
    items += [F.struct(F.lit(p).alias("priority"), F.when(F.col(c) > lim, F.lit(code)).alias("code")) for p, code, c, lim in COMPONENT_ADVICE]
    own = wide.select(key, F.inline(F.array(*items))).filter(F.col("code").isNotNull())
    unsure = risk_sensitivity(components, key, weights).filter("borderline").select(key, F.lit(6).alias("priority"), F.lit("MANUAL_REVIEW").alias("code"))
    return own.unionByName(unsure)
