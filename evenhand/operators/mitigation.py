"""Mitigation: reweighting, oversampling, per-group thresholds, constrained training, re-validation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evenhand.functions.hashing import uniform
from evenhand.functions.numeric import as_double, binary
from evenhand.functions.programme import best_mixture
from evenhand.operators.cleaning import median_impute
from evenhand.operators.metrics import demographic_parity, disparate_impact, equalized_odds
from evenhand.operators.models import fit_classifier, score_table
from evenhand.plans import defaults
from evenhand.plans.hulls import upper_hull
from evenhand.plans.neighbours import nearest
from evenhand.plans.ordered import add_piece, cut_points, first_by_hash, running_sums
from evenhand.sources.tables import written


def reweighting_weights(df: DataFrame, group: str) -> DataFrame:
    """Weight N / (G * n_g) per group, so every group counts the same in training."""
    counts = df.filter(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("g"))
    total, groups = totals.select("t").scalar(), totals.select("g").scalar()
    return counts.withColumn("weight", F.round(total / (groups * F.col("n")), 6))


def apply_weights(df: DataFrame, weights: DataFrame, group: str) -> DataFrame:
    """The rows with their group's weight; rows of no group weigh 1."""
    w = weights.select(F.col("grp").alias("_grp"), "weight")
    return df.join(w, F.col(group).cast("string") == F.col("_grp"), "left").drop("_grp").na.fill(1.0, ["weight"])


def minority_knn(df: DataFrame, key: str, features: Sequence[str], k: int = defaults.SMOTE_NEIGHBORS) -> DataFrame:
    """The k nearest other rows of every row (Euclidean), exact; nulls count as the column's median."""
    return nearest(median_impute(df.select(key, *features), features), key, features, k)


def smote_oversample(
    df: DataFrame, key: str, features: Sequence[str], by: str, k: int = defaults.SMOTE_NEIGHBORS, seed: int = 42
) -> DataFrame:
    """Synthetic rows for every smaller class of ``by`` until all classes have the size of the largest.

    A synthetic row lies between a row and one of its k nearest of the same class; neighbour and
    position come from a hash. Every row gets the same number of copies, the remainder goes to the
    first rows in hash order. Returns original and synthetic rows (``synthetic`` flag, null key), null
    features as the column's median. Rows without a class stay and get no copies; so do rows without a key.
    """
    every = median_impute(df.select(key, by, *[as_double(F.col(f)).alias(f) for f in features]), features)
    every = written(every, "smote")
    rows = every.filter(F.col(by).isNotNull() & F.col(key).isNotNull())
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.agg(F.max("_n")).first()[0]
    marked = first_by_hash(rows, key, by, lambda n: (F.lit(top) - n) % n, f"smote-{seed}").join(sizes, by).filter("_n > 1")
    copies = marked.withColumn("_copies", F.floor((F.lit(top) - F.col("_n")) / F.col("_n")).cast("int") + F.col("_first").cast("int")).filter("_copies > 0")
    copies = written(copies, "copies")
    near = nearest(rows, key, features, k, by=by, asking=copies)  # other rows need no neighbours
    tag = F.concat_ws("-", F.col(key).cast("string"), F.col("_c").cast("string"))
    picked = copies.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_copies")))).withColumn(
        "rank", (F.floor(uniform(tag, f"nb{seed}") * F.least(F.lit(k), F.col("_n") - 1)) + 1).cast("int")
    ).withColumn("_u", uniform(tag, f"u{seed}"))
    other = rows.select(F.col(key).alias("neighbour"), F.col(by).alias("_by"), *[F.col(f).alias("n:" + f) for f in features])
    joined = picked.join(near.select(key, "rank", "neighbour"), [key, "rank"]).join(other, "neighbour").filter(F.col("_by") == F.col(by))
    new = joined.select(
        F.lit(None).cast(dict(rows.dtypes)[key]).alias(key), by,
        *[(F.col(f) + F.col("_u") * (F.col("n:" + f) - F.col(f))).alias(f) for f in features], F.lit(True).alias("synthetic"),
    )
    return every.withColumn("synthetic", F.lit(False)).unionByName(new)


def group_thresholds(df: DataFrame, group: str, target: str, prob: str, grid: int | None = 100) -> DataFrame:
    """Score threshold per group so that all groups are selected at a common rate with the largest
    total accuracy.

    A row is selected when its score lies above the threshold; a null threshold selects everyone.
    Rows are reduced to distinct scores per group. Running counts from the highest score give, for
    every threshold, the selected share and the right decisions. Each point answers for the grid
    rates from its own share up to the next point's, so a group adds ``grid + 1`` rows, not a
    curve. Groups meet per grid rate, and the best rate wins (the smallest on ties). ``grid=None`` takes
    as many rates as there are distinct scores, at least 100.
    """
    score = as_double(F.col(prob))
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(target).cast("int").alias("y"), score.alias("p")).filter(
        F.col("grp").isNotNull() & F.col("y").isNotNull() & F.col("p").isNotNull()
    )
    curve = written(rows.groupBy("grp", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")), "curve")
    totals = curve.groupBy("grp").agg(F.sum("n").alias("total"), F.sum("pos").alias("total_pos"))
    grid = grid or max(100, curve.select("p").distinct().count())
    run = running_sums(add_piece(curve, "p", cut_points(curve, "p")), ["grp"], "p", ["n", "pos"], descending=True)
    # point i decides "score above p_i": it selects what ran up before it
    sel, tp = F.col("run_n") - F.col("n"), F.col("run_pos") - F.col("pos")
    below = run.join(totals, "grp").select("grp", F.col("p").alias("threshold"), sel.alias("sel"), tp.alias("tp"), "run_n", "total", "total_pos")
    cover = F.sequence(F.ceil(F.col("sel") * grid / F.col("total")), F.ceil(F.col("run_n") * grid / F.col("total")) - 1)
    some = below.filter(F.ceil(F.col("sel") * grid / F.col("total")) < F.ceil(F.col("run_n") * grid / F.col("total"))).select(
        "grp", "threshold", "sel", "tp", "total", "total_pos", F.explode(cover).alias("rate")
    )
    everyone = totals.select(
        "grp", F.lit(None).cast("double").alias("threshold"), F.col("total").alias("sel"), F.col("total_pos").alias("tp"), "total", "total_pos",
        F.lit(grid).cast("bigint").alias("rate"),
    )
    right = F.col("tp") + F.col("total") - F.col("total_pos") - F.col("sel") + F.col("tp")
    spread = some.unionByName(everyone).withColumn("right", right)
    best = spread.groupBy("rate").agg(F.sum("right").alias("s")).agg(F.max_by("rate", F.struct("s", -F.col("rate"))).alias("r"))
    return spread.filter(F.col("rate") == best.select("r").scalar()).select(
        "grp", "threshold", F.round(F.col("sel") / F.col("total"), 4).alias("selection_rate"), F.round(F.col("right") / F.col("total"), 4).alias("accuracy"),
        (F.col("rate") / F.lit(float(grid))).alias("common_rate"),
    )


def equal_rate_thresholds(df: DataFrame, group: str, target: str, prob: str) -> DataFrame:
    """Two score thresholds per group and the share of the looser one, so that all groups are selected at exactly the same
    rate with the largest total accuracy any mix of thresholds reaches.

    ``grp, strict, loose, mix, common_rate, accuracy``: scores above ``strict`` are selected, scores above ``loose`` with
    probability ``mix`` (:func:`mixed_selection`); a null threshold selects everyone. Where the rate needs no mix, both are equal
    and ``mix`` is 0.

    A group's thresholds are points (selected rows, right decisions); mixes of two fill the area below their upper hull, which
    is formed piece by piece (:mod:`evenhand.plans.hulls`). Along the common rate the sum of the hulls is concave; running
    sums of its slope's changes find where it stops to rise (the smallest such rate). Rows without group, label or score are
    left out; a group of one score has the thresholds everyone and nobody.
    """
    score = as_double(F.col(prob))
    rows = df.select(F.col(group).cast("string").alias("grp"), binary(target).cast("bigint").alias("y"), score.alias("p"))
    rows = rows.filter(F.col("grp").isNotNull() & F.col("y").isNotNull() & F.col("p").isNotNull())
    curve = written(rows.groupBy("grp", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")), "curve")
    totals = written(curve.groupBy("grp").agg(F.sum("n").alias("total"), F.sum("pos").alias("total_pos")), "totals")
    cuts = cut_points(curve, "p")
    run = running_sums(add_piece(curve, "p", cuts), ["grp"], "p", ["n", "pos"], descending=True)
    # point i decides "score above p_i": it selects what ran up before it
    sel, tp = F.col("run_n") - F.col("n"), F.col("run_pos") - F.col("pos")
    points = run.select("grp", F.col("p").alias("threshold"), sel.alias("sel"), tp.alias("tp"), "_piece")
    everyone = totals.select("grp", F.lit(None).cast("double").alias("threshold"), F.col("total").alias("sel"), F.col("total_pos").alias("tp"), F.lit(0).alias("_piece"))
    known = points.unionByName(everyone).join(totals, "grp")
    right = 2 * F.col("tp") + F.col("total") - F.col("total_pos") - F.col("sel")
    corners = upper_hull(known.select("grp", "threshold", "sel", right.alias("right"), "total", "_piece"), "grp", "sel", "right", len(cuts) + 1)
    along = W.partitionBy("grp").orderBy("sel")  # a hull's corners
    edges = written(corners.select(
        "grp", "threshold", "right", "total", (F.col("sel") / F.col("total")).alias("rate"), *[F.lead(c).over(along).alias(f"next_{c}") for c in ("threshold", "right")],
        (F.lead("sel").over(along) / F.col("total")).alias("next_rate"),
    ), "edges")
    slope = F.coalesce((F.col("next_right") - F.col("right")) / (F.col("next_rate") - F.col("rate")), F.lit(0.0))
    turns = edges.withColumn("slope", slope).withColumn("turn", F.col("slope") - F.coalesce(F.lag("slope").over(W.partitionBy("grp").orderBy("rate")), F.lit(0.0)))
    turns = written(turns.groupBy("rate").agg(F.sum("turn").alias("turn")), "turns")
    rising = running_sums(add_piece(turns, "rate", cut_points(turns, "rate")), [], "rate", ["turn"])
    rows_in_all = totals.agg(F.sum("total").alias("n")).scalar()
    best = rising.filter(F.col("run_turn") <= 1e-9 * rows_in_all).agg(F.min("rate").alias("r")).scalar()
    at = edges.withColumn("common_rate", best).filter((F.col("rate") <= F.col("common_rate")) & F.coalesce(F.col("next_rate") > F.col("common_rate"), F.lit(True)))
    exact = F.col("rate") == F.col("common_rate")
    mix = F.when(exact, 0.0).otherwise((F.col("common_rate") - F.col("rate")) / (F.col("next_rate") - F.col("rate")))
    return at.select(
        "grp", F.col("threshold").alias("strict"), F.when(exact, F.col("threshold")).otherwise(F.col("next_threshold")).alias("loose"), mix.alias("mix"), "common_rate",
        F.round((F.col("right") + mix * F.when(exact, 0).otherwise(F.col("next_right") - F.col("right"))) / F.col("total"), 4).alias("accuracy"),
    )


def mixed_selection(df: DataFrame, thresholds: DataFrame, group: str, prob: str, out: str = "y_select") -> DataFrame:
    """``out``: the probability with which a row is selected by :func:`equal_rate_thresholds`; null for rows of no known group
    or without a score."""
    t = thresholds.select(F.col("grp").alias("_grp"), F.col("strict").alias("_s"), F.col("loose").alias("_l"), F.col("mix").alias("_m"))
    joined = df.join(t, F.col(group).cast("string") == F.col("_grp"), "left")
    score = as_double(F.col(prob))
    above = lambda c: F.coalesce((score > F.col(c)).cast("double"), F.lit(1.0))
    chance = F.when(F.col("_grp").isNotNull() & score.isNotNull(), (1 - F.col("_m")) * above("_s") + F.col("_m") * above("_l"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], chance.alias(out))


def apply_mixed(df: DataFrame, thresholds: DataFrame, group: str, prob: str, key: str, pred: str = "y_pred", seed: int = 42) -> DataFrame:
    """Decisions by :func:`equal_rate_thresholds`; rows between a group's thresholds are drawn by a hash of their key, so
    reruns agree. Rows of no known group or without a score keep theirs."""
    chances = mixed_selection(df, thresholds, group, prob, "_chance")
    drawn = (uniform(F.col(key), f"mix{seed}") < F.col("_chance")).cast("int")
    return chances.select(*[F.coalesce(drawn, F.col(c)).alias(c) if c == pred else F.col(f"`{c}`") for c in df.columns])


def apply_thresholds(df: DataFrame, thresholds: DataFrame, group: str, prob: str, pred: str = "y_pred") -> DataFrame:
    """Decisions by the group's threshold; rows of no known group keep theirs."""
    t = thresholds.select(F.col("grp").alias("_grp"), F.col("threshold").alias("_t"), F.lit(True).alias("_known"))
    joined = df.join(t, F.col(group).cast("string") == F.col("_grp"), "left")
    new = F.when(F.col("_known").isNull(), F.col(pred)).otherwise(F.coalesce((F.col(prob) > F.col("_t")).cast("int"), F.lit(1)))
    return joined.select(*[new.alias(c) if c == pred else F.col(c) for c in df.columns])


# Techniques per risk level, in order.
PLAN = {"LOW": ("OVERSAMPLING",), "MEDIUM": ("REWEIGHTING",), "HIGH": ("CONSTRAINED_TRAINING", "GROUP_THRESHOLDS")}


def mitigation_plan(scores: DataFrame, key: str = "model_id") -> DataFrame:
    """Techniques to apply per model, by its risk level."""
    steps = F.create_map(*[x for lev, t in PLAN.items() for x in (F.lit(lev), F.array(*[F.lit(v) for v in t]))])
    return scores.select(key, "level", F.posexplode(steps[F.col("level")]).alias("step", "technique")).withColumn("step", F.col("step") + 1)


def accuracy_change(before: DataFrame, after: DataFrame, key: str = "model_id", tolerance: float = defaults.ACCURACY_TOLERANCE) -> DataFrame:
    """Mitigated minus original accuracy per model, and whether it is within the tolerance."""
    b = before.select(key, F.col("accuracy").alias("original_accuracy"))
    a = after.select(key, F.col("accuracy").alias("mitigated_accuracy"))
    change = F.round(F.col("mitigated_accuracy") - F.col("original_accuracy"), 4)
    return b.join(a, key).withColumn("accuracy_change", change).withColumn("within_tolerance", F.abs("accuracy_change") <= tolerance)


def fairness_metrics_long(df: DataFrame, attrs: Sequence[str], target: str, pred: str) -> DataFrame:
    """``attribute, metric, value`` where larger is worse."""
    dp = demographic_parity(df, attrs, pred).select("attribute", F.lit("dp_gap").alias("metric"), F.col("gap").alias("value"))
    eo = equalized_odds(df, attrs, target, pred)
    di = disparate_impact(df, attrs, pred)
    return (
        dp.unionByName(eo.select("attribute", F.lit("tpr_gap").alias("metric"), F.col("tpr_gap").alias("value")))
        .unionByName(eo.select("attribute", F.lit("fpr_gap").alias("metric"), F.col("fpr_gap").alias("value")))
        .unionByName(di.select("attribute", F.lit("di_deficit").alias("metric"), F.round(1 - F.col("ratio"), 4).alias("value")))
    )


def revalidation_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every metric before and after mitigation, with the axes that got worse."""
    b = before.select("attribute", "metric", F.col("value").alias("before"))
    a = after.select("attribute", "metric", F.col("value").alias("after"))
    delta = F.round(F.col("after") - F.col("before"), 4)
    return b.join(a, ["attribute", "metric"], "full").withColumn("delta", delta).withColumn("worse", F.col("delta") > 0)


class Mixture:
    """A randomised classifier: fitted hypotheses with weights (driver-sized state).

    A hypothesis is a linear rule (coefficients and intercept), a constant, or any fitted Spark model."""

    def __init__(self, features: Sequence[str], rules: list, weights: Sequence[float] | None = None):
        self.features, self.rules = list(features), rules
        self.weights = list(weights) if weights is not None else [1.0 / len(rules)] * len(rules)

    def decide(self, df: DataFrame, i: int, out: str) -> DataFrame:
        """``df`` with the 0/1 decision of hypothesis ``i``; features have to be complete."""
        rule = self.rules[i]
        if isinstance(rule, tuple):
            margin = sum((F.lit(float(c)) * F.col(f) for c, f in zip(rule[0], self.features)), F.lit(float(rule[1])))
            return df.withColumn(out, (margin >= 0).cast("double"))
        vec = df if "_v" in df.columns else VectorAssembler(inputCols=self.features, outputCol="_v").transform(df)
        kept = [c for c in df.columns if c != "_v"] + (["_v"] if "_v" in df.columns else [])
        return rule.transform(vec).select(*kept, F.col("prediction").alias(out))

    def score(self, df: DataFrame, out: str = "y_prob") -> DataFrame:
        """``df`` with the probability of selecting."""
        used = [i for i, w in enumerate(self.weights) if w > 0]
        rows = df
        for i in used:
            rows = self.decide(rows, i, f"_h{i}")
        total = sum((F.lit(float(self.weights[i])) * F.col(f"_h{i}") for i in used), F.lit(0.0))
        return rows.withColumn(out, total).drop(*[f"_h{i}" for i in used])


class ConstrainedTraining:
    """Least error subject to demographic parity (reductions approach, Agarwal et al. 2018), for any
    strength of the constraint, on one written train table.

    The pool of hypotheses starts with an unconstrained model and the two constants. :meth:`solve` finds the best mixture of
    the pool and the constraints' prices exactly (a linear programme on hypotheses x groups numbers); one distributed
    cost-sensitive fit at these prices and one grouped aggregation then look for a hypothesis that beats the pool, which gives
    a lower bound of what any mixture reaches, as far as the learner finds it. Hypotheses join the pool until mixture and bound
    are within ``tolerance`` of each other, and serve all strengths.

    ``learner`` makes an estimator that accepts weights, given ``featuresCol, labelCol, weightCol``; by
    default a logistic regression. Only multipliers, group rates and models come to the driver.
    """

    def __init__(self, train: DataFrame, features: Sequence[str], target: str, group: str, learner=None):
        base = train.filter(F.col(group).isNotNull() & F.col(target).isNotNull()).select(
            *[F.col(f).cast("double").alias(f) for f in features], binary(target).alias("_y"), F.col(group).cast("string").alias("_g")
        )
        self.features, self.learner = list(features), learner
        self.table = written(VectorAssembler(inputCols=self.features, outputCol="_v").transform(base), "train")
        share = {r["_g"]: r["n"] for r in self.table.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per group
        self.names = sorted(share)
        self.p = np.array([share[g] for g in self.names], dtype=float) / max(sum(share.values()), 1)
        self.rules: list = []
        self.rates, self.errors = np.zeros((0, len(self.names))), np.zeros(0)
        self.fits = 0
        self.priced: list[tuple[np.ndarray, float, float]] = []  # net prices, their total, the least value found at them
        for bias in (-1.0, 1.0):
            self._add((np.zeros(len(self.features)), bias))
        self._add(self._fit(np.zeros(len(self.names))))

    def _fit(self, net: np.ndarray):
        """The hypothesis of least error plus priced selection."""
        self.fits += 1
        price = F.create_map(*[x for g, e in zip(self.names, net / self.p - net.sum()) for x in (F.lit(g), F.lit(float(e)))])[F.col("_g")]
        gain = F.when(F.col("_y") == 1, 1.0).otherwise(-1.0) - price
        rows = self.table.select("_v", (gain > 0).cast("double").alias("_l"), F.abs(gain).alias("_w"))
        args = {"featuresCol": "_v", "labelCol": "_l", "weightCol": "_w"}
        if self.learner is not None:
            return self.learner(**args).fit(rows)
        model = LogisticRegression(maxIter=25, regParam=1e-4, **args).fit(rows)
        if model.numClasses < 2:  # nobody is worth selecting
            return np.zeros(len(self.features)), -1.0
        return model.coefficientMatrix.toArray()[0], float(model.interceptVector[0])

    def _add(self, rule) -> None:
        mixture = Mixture(self.features, [*self.rules, rule])
        rows = mixture.decide(self.table, len(self.rules), "_h")
        found = {r["_g"]: r for r in rows.groupBy("_g").agg(F.avg("_h").alias("rate"), F.avg((F.col("_h") != F.col("_y")).cast("double")).alias("err")).collect()}
        self.rules.append(rule)
        self.rates = np.vstack([self.rates, [found[g]["rate"] for g in self.names]])
        self.errors = np.append(self.errors, sum(found[g]["err"] * q for g, q in zip(self.names, self.p)))

    def _solve(self, epsilon: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """The best weights of the pool and the prices of the constraints."""
        return best_mixture(self.errors, self.rates - (self.rates @ self.p)[:, None], epsilon, bound)

    def _values(self, prices: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Each hypothesis's error with the prices of what it violates, and the net price of each group's rate."""
        half = len(self.names)
        net = prices[:half] - prices[half:]
        return self.errors + (self.rates - (self.rates @ self.p)[:, None]) @ net - prices.sum() * epsilon, net

    def _known_bound(self, epsilon: float) -> float:
        """What earlier searches, for any strength, say the best mixture costs at least: a search's prices bound all strengths."""
        over = self.rates - (self.rates @ self.p)[:, None]
        return max((min(value, float((self.errors + over @ net).min())) - total * epsilon for net, total, value in self.priced), default=-np.inf)

    def solve(self, epsilon: float, bound: float = 10.0, tolerance: float = 0.005, rounds: int = 12) -> tuple[Mixture, dict]:
        """The mixture whose group rates differ from the overall rate by at most ``epsilon``, and what is known of it on
        the train rows: ``gap`` (that difference), ``error``, ``duality_gap`` and ``solved``, whether that is within
        ``tolerance`` (not where ``rounds`` ended the search)."""
        low = self._known_bound(epsilon)
        for round_ in range(rounds + 1):
            weights, prices = self._solve(epsilon, bound)
            weights = self._within(weights, epsilon)
            rate = weights @ self.rates
            over = rate - float(rate @ self.p)
            primal = float(weights @ self.errors)
            if round_ == rounds or primal - low <= tolerance:
                break
            values, net = self._values(prices, epsilon)
            best = float(values.min())
            self._add(self._fit(net))
            new = float(self._values(prices, epsilon)[0][-1])
            low = max(low, min(best, new))
            self.priced.append((net, float(prices.sum()), min(best, new) + float(prices.sum()) * epsilon))
            if new >= best - 1e-9:  # nothing beats the pool: its best mixture is the best there is
                weights = np.append(weights, 0.0)
                break
        gap = max(0.0, primal - low)
        stats = {"gap": float(np.abs(over).max()), "error": primal, "duality_gap": gap, "solved": gap <= tolerance}
        return Mixture(self.features, self.rules, weights), stats

    def _within(self, weights: np.ndarray, epsilon: float) -> np.ndarray:
        """The weights mixed with the better constant, just as much as the constraint needs: a constant selects all
        groups alike, so the difference shrinks in proportion."""
        rate = weights @ self.rates
        gap = float(np.abs(rate - float(rate @ self.p)).max())
        if gap <= epsilon:
            return weights
        keep = epsilon / gap * (1 - 1e-9)
        fixed = np.zeros(len(weights))
        fixed[int(np.argmin(self.errors[:2]))] = 1.0
        return keep * weights + (1 - keep) * fixed


def fair_training(
    train: DataFrame, test: DataFrame, features: Sequence[str], target: str, group: str, epsilon: float = 0.01, rounds: int = 12, learner=None,
    tolerance: float = 0.005,
) -> DataFrame:
    """Test rows scored by the constrained mixture: ``y_prob`` is its probability of selecting, ``y_pred`` the majority
    decision. ``duality_gap`` and ``solved`` say how far the mixture may be from the best one and whether that is within
    ``tolerance``; ``rounds`` may end the search before. Null features count as the train rows' median."""
    test = median_impute(test, features, fit_on=train)
    train = median_impute(train, features)
    mixture, stats = ConstrainedTraining(train, features, target, group, learner).solve(epsilon, tolerance=tolerance, rounds=rounds)
    known = {"duality_gap": F.lit(stats["duality_gap"]), "solved": F.lit(stats["solved"])}
    return mixture.score(test).withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int")).withColumns(known)


def pareto_sweep(
    train: DataFrame, test: DataFrame, features: Sequence[str], target: str, group: str, models: int = defaults.PARETO_MODELS, rounds: int = 6, learner=None
) -> DataFrame:
    """``epsilon, accuracy, dp_gap, train_gap, duality_gap, solved`` of ``models`` constraint strengths from 0.01 to 0.5.

    Every strength is trained to its own duality gap on one train table; hypotheses found for one strength are
    known to the next. Accuracy and gap of the mixtures on the test rows come from one aggregation.
    """
    game = ConstrainedTraining(median_impute(train, features), features, target, group, learner)
    strengths = [round(float(e), 4) for e in np.linspace(0.01, 0.5, models)]
    solved = [game.solve(e, rounds=rounds) for e in strengths]
    pool = len(game.rules)
    known = median_impute(test, features, fit_on=train).filter(F.col(group).isNotNull() & F.col(target).isNotNull())
    rows = known.select(*features, binary(target).alias("_y"), F.col(group).cast("string").alias("_g"))
    every = Mixture(features, game.rules)
    for i in range(pool):
        rows = every.decide(rows, i, f"_h{i}")
    groups = rows.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"_h{i}").alias(f"r{i}") for i in range(pool)],
        *[F.avg((F.col(f"_h{i}") == F.col("_y")).cast("double")).alias(f"a{i}") for i in range(pool)],
    ).collect()  # one row per group
    total = sum(r["n"] for r in groups)
    rate = np.array([[r[f"r{i}"] for r in groups] for i in range(pool)])
    right = np.array([sum(r[f"a{i}"] * r["n"] for r in groups) / total for i in range(pool)])
    out = []
    for e, (mixture, stats) in zip(strengths, solved):
        w = np.zeros(pool)
        w[: len(mixture.weights)] = mixture.weights
        mix = w @ rate
        out.append((e, round(float(w @ right), 4), round(float(mix.max() - mix.min()), 4), round(stats["gap"], 4), round(stats["duality_gap"], 4), stats["solved"]))
    return train.sparkSession.createDataFrame(out, "epsilon double, accuracy double, dp_gap double, train_gap double, duality_gap double, solved boolean")


def mitigation_baseline(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, kind: str = "logistic") -> tuple[PipelineModel, DataFrame]:
    """The original model and the test rows with its scores, written: what all levels of :func:`run_mitigation` compare with."""
    model = fit_classifier(train, features, target, kind)
    return model, written(score_table(model, test, features), "baseline")


def run_mitigation(
    train: DataFrame, test: DataFrame, key: str, features: Sequence[str], target: str, group: str, level: str, kind: str = "logistic",
    tolerance: float = defaults.ACCURACY_TOLERANCE, epsilon: float = 0.01, rounds: int = 8, baseline: tuple[PipelineModel, DataFrame] | None = None,
) -> DataFrame:
    """Apply the techniques of a risk level: retrain, compare with the original model on the test rows.

    One row per technique: ``level, technique, original_accuracy, mitigated_accuracy, accuracy_change, within_tolerance,
    gap_before, gap_after, chosen``. Where a level has several techniques, the most accurate is chosen (the first on ties).
    Thresholds are fitted on the train rows' scores and applied to the test rows. ``baseline`` is :func:`mitigation_baseline` of the
    same rows, where several levels share it.
    """
    if level not in PLAN:
        raise ValueError(f"'{level}' is no risk level: {list(PLAN)}")
    model, base = baseline or mitigation_baseline(train, test, features, target, kind)
    known = F.col(group).isNotNull()

    def state(scored: DataFrame, pred: Column) -> tuple[float, float]:
        rows = scored.filter(F.col(target).isNotNull()).withColumn("_p", pred.cast("double"))
        per = rows.groupBy(F.when(known, F.col(group).cast("string")).alias("_g")).agg(
            F.count(F.lit(1)).alias("n"), F.avg("_p").alias("rate"), F.avg(F.col(target) * F.col("_p") + (1 - F.col(target)) * (1 - F.col("_p"))).alias("right")
        ).collect()  # one row per group
        rates = [r["rate"] for r in per if r["_g"] is not None]
        return sum(r["right"] * r["n"] for r in per) / sum(r["n"] for r in per), max(rates) - min(rates)

    def applied(technique: str) -> tuple[float, float]:
        if technique == "OVERSAMPLING":
            fitted = fit_classifier(written(smote_oversample(train, key, features, target), "resampled"), features, target, kind)
        elif technique == "REWEIGHTING":
            fitted = fit_classifier(apply_weights(train, reweighting_weights(train, group), group), features, target, kind, weight="weight")
        elif technique == "GROUP_THRESHOLDS":
            fitted_on = written(score_table(model, train, features), "train-scores")
            moved = mixed_selection(base, equal_rate_thresholds(fitted_on, group, target, "y_prob"), group, "y_prob")
            return state(moved, F.coalesce("y_select", "y_pred"))  # expected decisions of the mix
        else:
            return state(fair_training(train, test, features, target, group, epsilon, rounds), F.col("y_prob"))  # expected decisions of the mixture
        return state(score_table(fitted, test, features), F.col("y_pred"))

    accuracy, gap = state(base, F.col("y_pred"))
    results = [(t, *applied(t)) for t in PLAN[level]]
    best = max(results, key=lambda r: r[1])[0]
    rows = [
        (level, t, round(accuracy, 4), round(a, 4), round(a - accuracy, 4), abs(round(a - accuracy, 4)) <= tolerance, round(gap, 4), round(g, 4), t == best)
        for t, a, g in results
    ]
    schema = "level string, technique string, original_accuracy double, mitigated_accuracy double, accuracy_change double, within_tolerance boolean, gap_before double, gap_after double, chosen boolean"
    return train.sparkSession.createDataFrame(rows, schema)
