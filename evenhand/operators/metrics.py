"""Fairness metrics of a scored table (label, predicted label, probability)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from evenhand.functions.numeric import argmax, argmin, as_double, binary, flag, ratio
from evenhand.operators.association import proxy_detection
from evenhand.operators.labels import disparity, label_distribution
from evenhand.plans import defaults
from evenhand.plans.association import binary_tests
from evenhand.plans.longform import group_rates, to_long
from evenhand.plans.neighbours import nearest_in_other_groups
from evenhand.plans.ordered import add_piece, cut_points, running_sums
from evenhand.plans.quantiles import bin_edges, discretise
from evenhand.plans.resample import intervals, reliability, resampled
from evenhand.sources.tables import written

# Inner edges of five equal calibration bins, as the float steps of linspace(0, 1, 6).
CALIBRATION_EDGES = (0.2, 0.4, 0.6000000000000001, 0.8)


def selection_rates(df: DataFrame, attrs: Sequence[str], pred: str, by: Sequence[str] = ()) -> DataFrame:
    return group_rates(df, attrs, pred, by).select(*by, "attribute", "grp", "n", F.round(F.col("rate") * 100, 2).alias("selection_rate"))


def demographic_parity(
    df: DataFrame, attrs: Sequence[str], pred: str, by: Sequence[str] = (), threshold: float = defaults.DP_GAP
) -> DataFrame:
    """Gap of the rounded selection rates in points; also the unrounded difference (4 dp)."""
    return parity_of(group_rates(df, attrs, pred, by), by, threshold)


def parity_of(rates: DataFrame, by: Sequence[str] = (), threshold: float = defaults.DP_GAP) -> DataFrame:
    """:func:`demographic_parity` from a table of group rates."""
    rates = rates.withColumn("pct", F.round(F.col("rate") * 100, 2))
    pct = F.col("pct")
    return rates.groupBy(*by, "attribute").agg(
        F.max(pct).alias("max_rate"), argmax("grp", pct).alias("max_group"), F.min(pct).alias("min_rate"), argmin("grp", pct).alias("min_group"),
        F.round(F.max(pct) - F.min(pct), 2).alias("gap"), F.round(F.max("rate") - F.min("rate"), 4).alias("dp_difference"),
    ).withColumn("above_threshold", F.col("gap") / 100 > threshold)


def demographic_parity_ratio(df: DataFrame, attrs: Sequence[str], pred: str, by: Sequence[str] = ()) -> DataFrame:
    return group_rates(df, attrs, pred, by).groupBy(*by, "attribute").agg(F.round(ratio(F.min("rate"), F.max("rate")), 4).alias("dp_ratio"))


def group_confusion(
    df: DataFrame, attrs: Sequence[str], target: str, pred: str, by: Sequence[str] = (), extra: dict[str, Column] | None = None
) -> DataFrame:
    """tp, fp, fn, tn per group in one pass (``extra`` aggregates may use ``_y`` and ``_p``)."""
    long = to_long(df, attrs, [*by, binary(target).alias("_y"), binary(pred).alias("_p")])
    cell = {n: (F.col("_y") == y) & (F.col("_p") == p) for n, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))}
    return long.groupBy(*by, "attribute", "grp").agg(
        *[F.sum(flag(c)).alias(n) for n, c in cell.items()], *[c.alias(n) for n, c in (extra or {}).items()]
    )


def error_rates(
    df: DataFrame, attrs: Sequence[str], target: str, pred: str, by: Sequence[str] = (), extra: dict[str, Column] | None = None
) -> DataFrame:
    """Confusion counts with TPR, FPR and FNR (4 dp, 0 where undefined)."""
    return rates_of(group_confusion(df, attrs, target, pred, by, extra))


def rates_of(confusion: DataFrame) -> DataFrame:
    """:func:`error_rates` from a table of confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion.select(
        "*", F.round(ratio(tp, tp + fn), 4).alias("tpr"), F.round(ratio(fp, fp + tn), 4).alias("fpr"), F.round(ratio(fn, fn + tp), 4).alias("fnr")
    )


def equalized_odds(
    df: DataFrame, attrs: Sequence[str], target: str, pred: str, by: Sequence[str] = (), threshold: float = defaults.EQUALIZED_ODDS
) -> DataFrame:
    tpr, fpr = F.max("tpr") - F.min("tpr"), F.max("fpr") - F.min("fpr")
    return error_rates(df, attrs, target, pred, by).groupBy(*by, "attribute").agg(
        F.round(tpr, 4).alias("tpr_gap"), F.round(fpr, 4).alias("fpr_gap"), ((tpr > threshold) | (fpr > threshold)).alias("above_threshold")
    )


def disparate_impact(
    df: DataFrame, attrs: Sequence[str], pred: str, by: Sequence[str] = (), threshold: float = defaults.DISPARATE_IMPACT
) -> DataFrame:
    """Smallest over largest selection rate per attribute (4 dp; 0 when nobody is selected)."""
    rate = F.col("rate")
    out = group_rates(df, attrs, pred, by).groupBy(*by, "attribute").agg(
        F.round(F.max(rate) * 100, 2).alias("max_rate"), argmax("grp", rate).alias("max_group"),
        F.round(F.min(rate) * 100, 2).alias("min_rate"), argmin("grp", rate).alias("min_group"),
        F.round(ratio(F.min(rate), F.max(rate)), 4).alias("ratio"),
    )
    return out.withColumn("passes", F.col("ratio") >= threshold)


def disparate_impact_labels(df: DataFrame, attrs: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Disparate impact of the recorded labels, from the rounded rates."""
    return disparity(label_distribution(df, attrs, target, by), "approval_rate", by).select(
        *by, "attribute", "ratio", (F.col("ratio") >= defaults.DISPARATE_IMPACT).alias("passes")
    )


def _calibration_bins(df: DataFrame, attrs: Sequence[str], target: str, prob: str, by: Sequence[str], edges: Sequence[float]) -> DataFrame:
    p = F.col("_p")
    index = sum((F.when(p > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0)).alias("bin")
    long = to_long(df, attrs, [*by, F.col(target).cast("int").alias("_y"), as_double(F.col(prob)).alias("_p")])
    bins = long.filter(F.col("_y").isNotNull() & p.isNotNull()).groupBy(*by, "attribute", "grp", index).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("prob_true"), F.avg("_p").alias("prob_pred")
    )
    # at most one row per bin in a partition
    return bins.withColumn("group_n", F.sum("n").over(W.partitionBy(*by, "attribute", "grp")))


def calibration_curve(
    df: DataFrame, attrs: Sequence[str], target: str, prob: str, by: Sequence[str] = (), min_rows: int = 20,
    edges: Sequence[float] = CALIBRATION_EDGES,
) -> DataFrame:
    """Observed rate and mean score per probability bin and group; empty bins are absent. A group below ``min_rows``
    has one row without a bin, with all its rows as ``n`` and a status."""
    bins = _calibration_bins(df, attrs, target, prob, by, edges)
    enough = F.col("group_n") >= min_rows
    rows = bins.select(
        *by, "attribute", "grp", F.when(enough, F.col("bin")).alias("bin"), F.when(enough, F.col("n")).otherwise(F.col("group_n")).alias("n"),
        F.when(enough, F.round("prob_true", 4)).alias("prob_true"), F.when(enough, F.round("prob_pred", 4)).alias("prob_pred"),
        F.when(enough, "ok").otherwise("too few samples").alias("status"),
    )
    return rows.distinct()


def calibration_error(
    df: DataFrame, attrs: Sequence[str], target: str, prob: str, by: Sequence[str] = (), min_rows: int = 20,
    edges: Sequence[float] = CALIBRATION_EDGES,
) -> DataFrame:
    """Unweighted mean bin error per group; groups below ``min_rows`` get a status instead."""
    err = F.avg(F.abs(F.col("prob_true") - F.col("prob_pred")))
    out = _calibration_bins(df, attrs, target, prob, by, edges).groupBy(*by, "attribute", "grp").agg(err.alias("_e"), F.max("group_n").alias("n"))
    ok = F.col("n") >= min_rows
    return out.select(
        *by, "attribute", "grp", "n", F.when(ok, F.round("_e", 4)).alias("calibration_error"),
        F.when(ok, F.col("_e") < 0.1).alias("well_calibrated"), F.when(ok, "ok").otherwise("too few samples").alias("status"),
    )


def _distances(scores: DataFrame, two: DataFrame, cuts: Sequence[float], keys: Sequence[str], named_by: Sequence[str] = ("attribute",)) -> DataFrame:
    """Wasserstein-1 distance ``w`` per ``keys`` from counts ``n`` of scores ``p`` per ``grp``, between the two groups that ``two``
    names per ``named_by`` (at most a row for each attribute column of an audited model)."""
    k, n = list(keys), F.col("n")
    points = scores.join(F.broadcast(two), list(named_by)).groupBy(*k, "p").agg(
        F.sum(F.when(F.col("grp") == F.col("group_1"), n).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col("grp") == F.col("group_2"), n).otherwise(0)).alias("n2"),
    )
    run = running_sums(add_piece(points, "p", cuts), k, "p", ["n1", "n2"])
    totals = points.groupBy(*k).agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    width = F.col("next_value") - F.col("p")
    area = F.abs(F.try_divide(F.col("run_n1"), F.col("t1")) - F.try_divide(F.col("run_n2"), F.col("t2"))) * width
    whole = (F.col("t1") > 0) & (F.col("t2") > 0)
    return run.join(totals, k).filter(whole).groupBy(*k).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("w"))


def wasserstein_prob(df: DataFrame, attrs: Sequence[str], prob: str, concern: float = 0.1) -> DataFrame:
    """Wasserstein-1 distance between the scores of the two groups of an attribute.

    The rows are aggregated to distinct scores; the running group counts come from
    :func:`running_sums`, so no attribute is sorted in one task. Attributes with another number of
    groups are skipped.
    """
    long = to_long(df, attrs, [as_double(F.col(prob)).alias("p")]).filter(F.col("p").isNotNull())
    scores = written(long.groupBy("attribute", "grp", "p").agg(F.count(F.lit(1)).alias("n")), "scores")
    pair = scores.groupBy("attribute", "grp").agg(F.sum("n").alias("n")).groupBy("attribute").agg(
        F.count(F.lit(1)).alias("n_groups"), F.min("grp").alias("group_1"), F.max("grp").alias("group_2"),
    )
    two = pair.filter("n_groups = 2").select("attribute", "group_1", "group_2")
    dist = _distances(scores, two, cut_points(scores, "p"), ["attribute"])
    out = pair.join(dist, "attribute", "left")
    ok = F.col("n_groups") == 2
    return out.select(
        "attribute", "n_groups", F.when(ok, F.col("group_1")).alias("group_1"), F.when(ok, F.col("group_2")).alias("group_2"),
        F.round("w", 4).alias("wasserstein"), F.when(ok, F.col("w") > concern).alias("concern"),
    )


def individual_fairness(df: DataFrame, attrs: Sequence[str], key: str, prob: str, features: Sequence[str]) -> DataFrame:
    """How differently the most similar record of another group is scored: |score difference| / distance for every record and
    its nearest record of another group (Euclidean over the features as they are; scale them before).

    ``attribute, n, n_copies, max_copy_gap, mean_distance, mean_ratio, lipschitz``: records with a copy in another group have no ratio;
    they are counted, with the largest difference among them. ``lipschitz`` is the largest ratio. Of neighbours at the same
    distance the one with the smallest key counts. Records without a score, a feature, a key or a group are left out; where no two
    groups are left, the attribute has no row.
    """
    score = as_double(F.col(prob))
    complete = reduce(lambda a, b: a & b, [as_double(F.col(f)).isNotNull() for f in features], score.isNotNull() & F.col(key).isNotNull())
    rows = written(df.filter(complete).select(key, *attrs, score.alias("_p"), *[as_double(F.col(f)).alias(f) for f in features]), "scored")
    scores = rows.select(F.col(key).alias("neighbour"), F.col("_p").alias("_q"))
    out = None
    for a in attrs:
        near = nearest_in_other_groups(rows, key, a, features).join(rows.select(key, "_p"), key).join(scores, "neighbour")
        gap = F.abs(F.col("_p") - F.col("_q"))
        ratio = F.when(F.col("distance") > 0, gap / F.col("distance"))
        found = near.groupBy(F.lit(a).alias("attribute")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("distance") == 0).alias("n_copies"), F.round(F.max(F.when(F.col("distance") == 0, gap)), 4).alias("max_copy_gap"),
            F.round(F.avg("distance"), 4).alias("mean_distance"), F.round(F.avg(ratio), 6).alias("mean_ratio"), F.round(F.max(ratio), 6).alias("lipschitz"),
        )
        out = found if out is None else out.unionByName(found)
    return out


def bootstrap_score_ci(
    df: DataFrame, attrs: Sequence[str], target: str, prob: str, replicates: int = 200, seed: int = 42, min_rows: int = 20, steps: int = 10_000,
    edges: Sequence[float] = CALIBRATION_EDGES,
) -> DataFrame:
    """95% bootstrap intervals of the metrics of scores: ``calibration_error`` of every group and ``wasserstein`` of every attribute
    of two groups (``grp`` null, ``n`` its rows), every row weighted by Poisson(1) in each replicate.

    Both come from one table of counted cells (attribute, group, label, calibration bin, score on a grid of ``steps`` to one, which
    moves a score by at most half a step), so resampling costs a hash a cell and replicate and the running counts of a
    replicate are formed in pieces of the score axis. Rows without score count for nothing, those without label only for
    the distance. Groups below ``min_rows`` labelled rows have no error and LOW confidence.
    """
    p, y = F.col("_p"), F.col("y")
    index = sum((F.when(p > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0)).alias("bin")
    long = to_long(df, attrs, [binary(target).alias("y"), as_double(F.col(prob)).alias("_p")]).filter(p.isNotNull())
    names = ["attribute", "grp", "y", "bin", "score"]
    counted = long.groupBy("attribute", "grp", "y", index, F.round(p * steps).cast("bigint").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    cells = written(counted.withColumn("p", F.col("score") / F.lit(float(steps))), "cells")
    drawn = written(resampled(cells, names, replicates, seed), "draws")
    n = F.col("n")

    def errors(table: DataFrame, keys: list[str]) -> DataFrame:
        bins = table.filter(y.isNotNull()).groupBy(*keys, "bin").agg(F.sum(n).alias("n"), F.sum(n * y).alias("sy"), F.sum(n * F.col("p")).alias("sp"))
        err = F.avg(F.abs(F.try_divide(F.col("sy"), n) - F.try_divide(F.col("sp"), n)))  # bins without rows count for nothing
        return bins.groupBy(*keys).agg(F.sum(n).alias("rows"), err.alias("value"))

    sized = cells.groupBy("attribute", "grp").agg(F.sum(n).alias("n"), F.coalesce(F.sum(F.when(y.isNotNull(), n)), F.lit(0)).alias("labelled"))
    two = sized.groupBy("attribute").agg(F.count(F.lit(1)).alias("k"), F.min("grp").alias("group_1"), F.max("grp").alias("group_2"), F.sum("n").alias("n")).filter("k = 2")
    cuts = cut_points(cells, "p")
    far = lambda table, keys: _distances(table, two.select("attribute", "group_1", "group_2"), cuts, keys)
    group, label = ["attribute", "grp"], F.lit("calibration_error").alias("metric")
    error = errors(cells, group).drop("rows")
    point = sized.filter("labelled > 0").join(error, group).select(
        *group, label, F.col("labelled").alias("n"), F.when(F.col("labelled") >= min_rows, F.col("value")).alias("value")
    ).unionByName(far(cells, ["attribute"]).join(two, "attribute").select(
        "attribute", F.lit(None).cast("string").alias("grp"), F.lit("wasserstein").alias("metric"), "n", F.col("w").alias("value")
    ))
    large = sized.filter(F.col("labelled") >= min_rows).select(*group)
    draws = errors(drawn, [*group, "replicate"]).join(large, group).select(*group, label, "value").unionByName(
        far(drawn, ["attribute", "replicate"]).select("attribute", F.lit(None).cast("string").alias("grp"), F.lit("wasserstein").alias("metric"), F.col("w").alias("value"))
    )
    out = intervals(draws, point, ["attribute", "grp", "metric"])
    return out.withColumn("confidence", F.coalesce(F.when(n < defaults.SMALL_SAMPLE, "LOW"), reliability(F.col("_width")))).drop("_width")


def lipschitz_pairs(df: DataFrame, attrs: Sequence[str], prob: str, features: Sequence[str], max_discrete: int = 5) -> DataFrame:
    """Score differences of similar records in different groups.

    Records are similar when all their (binned) features fall in the same cell. The largest
    cross-group difference of a cell needs only each group's extreme scores, so no pair of rows is
    formed. ``lipschitz`` relates it to the cell's width, one bin in each of the features.
    """
    edges = bin_edges(df, features, keep_discrete=max_discrete)
    cell = F.concat_ws("|", *[F.coalesce(c, F.lit("null")) for c in discretise(df, features, edges)]).alias("cell")
    long = to_long(df, attrs, [cell, as_double(F.col(prob)).alias("p")]).filter(F.col("p").isNotNull())
    groups = written(
        long.groupBy("attribute", "cell", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")), "cells"
    )
    # best high against the lowest low of another group, via the two extremes on either side
    top = F.max(F.struct("hi", "grp")).alias("top")
    low = F.min(F.struct("lo", "grp")).alias("low")
    cells = groups.groupBy("attribute", "cell").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), top, low)
    shared = groups.join(cells.filter("g >= 2"), ["attribute", "cell"])
    reach = F.greatest(
        F.when(F.col("grp") != F.col("low.grp"), F.col("hi") - F.col("low.lo")),
        F.when(F.col("grp") != F.col("top.grp"), F.col("top.hi") - F.col("lo")),
    )
    per_cell = shared.groupBy("attribute", "cell").agg(F.max(reach).alias("gap"), F.sum(groups["n"]).alias("rows"))
    width = float(len(features)) ** 0.5
    return per_cell.groupBy("attribute").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("rows").alias("n_rows"), F.round(F.max("gap"), 4).alias("max_gap"),
        F.round(F.avg("gap"), 4).alias("mean_gap"), F.round(F.max("gap") / width, 4).alias("lipschitz"),
    )


def fairness_summary(df: DataFrame, attrs: Sequence[str], target: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Violations of the three group metrics and the status, from one group table. Selection rates
    count every row with a prediction, error rates those with a label too."""
    conf = error_rates(df, attrs, target, pred, by, extra={"n": F.count("_p"), "selected": F.sum("_p")})
    rate = F.try_divide(F.col("selected").cast("double"), F.col("n"))
    rated = conf.withColumn("rate", rate).withColumn("pct", F.round(rate * 100, 2))
    gap = lambda c: F.max(c) - F.min(c)
    per = rated.groupBy(*by, "attribute").agg(
        (F.round(gap("pct"), 2) / 100 > defaults.DP_GAP).alias("dp"),
        ((gap("tpr") > defaults.EQUALIZED_ODDS) | (gap("fpr") > defaults.EQUALIZED_ODDS)).alias("eo"),
        (F.round(ratio(F.min("rate"), F.max("rate")), 4) < defaults.DISPARATE_IMPACT).alias("di"),
    )
    out = per.groupBy(*by).agg(*[F.coalesce(F.sum(flag(F.col(c))), F.lit(0)).alias(n) for c, n in
                    (("dp", "dp_violations"), ("eo", "eo_violations"), ("di", "di_violations"))])
    total = F.col("dp_violations") + F.col("eo_violations") + F.col("di_violations")
    return out.withColumn("total_violations", total).withColumn(
        "status", F.when(F.col("total_violations") > 0, defaults.STATUS["violations"]).otherwise(defaults.STATUS["fair"])
    )


def label_statistics(df: DataFrame, attrs: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Per attribute from one scan: rounded rate extremes, gap, disparate impact and V of the labels."""
    rates = group_rates(df, attrs, target, by).withColumn("pct", F.round(F.col("rate") * 100, 2))
    pct = F.col("pct")
    extra = {"max_pct": F.max(pct), "min_pct": F.min(pct), "best": argmax("grp", pct), "worst": argmin("grp", pct)}
    t = binary_tests(rates, [*by, "attribute"], extra=extra)
    return t.select(
        *by, "attribute", F.round(F.col("max_pct") - F.col("min_pct"), 2).alias("gap"),
        F.round(ratio(F.col("min_pct"), F.col("max_pct")), 4).alias("di"), F.round("cramers_v", 4).alias("cramers_v"), "best", "worst",
    )


def attribute_verdict(
    df: DataFrame, attrs: Sequence[str], target: str, gap_limit: float = 10.0, v_limit: float = defaults.CRAMERS_V, by: Sequence[str] = ()
) -> DataFrame:
    """Unfair when the label gap, disparate impact or V of an attribute is out of bounds."""
    unfair = (F.col("gap") > gap_limit) | (F.col("di") < defaults.DISPARATE_IMPACT) | (F.col("cramers_v") > v_limit)
    return label_statistics(df, attrs, target, by).select(
        *by, "attribute", "cramers_v", "gap", "di", F.when(unfair, "UNFAIR").otherwise("FAIR").alias("verdict")
    )


def issue_list(
    df: DataFrame, attrs: Sequence[str], target: str, features: Sequence[str], gap_limit: float = 10.0, v_limit: float = defaults.CRAMERS_V
) -> DataFrame:
    """Numbered issues: per attribute gap, disparate impact, association; then the proxies as one."""
    order = F.create_map(*[x for i, a in enumerate(attrs) for x in (F.lit(a), F.lit(i))])
    stats = label_statistics(df, attrs, target)
    checks = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("approval_gap").alias("kind"), F.col("gap").alias("value"), (F.col("gap") > gap_limit).alias("hit")),
        F.struct(F.lit(2).alias("step"), F.lit("disparate_impact").alias("kind"), F.col("di").alias("value"), (F.col("di") < defaults.DISPARATE_IMPACT).alias("hit")),
        F.struct(F.lit(3).alias("step"), F.lit("association").alias("kind"), F.col("cramers_v").alias("value"), (F.col("cramers_v") > v_limit).alias("hit")),
    )
    own = stats.select("attribute", order[F.col("attribute")].alias("place"), F.inline(checks)).filter("hit").drop("hit")
    proxies = proxy_detection(df, attrs, features, v_limit).filter("is_proxy").agg(F.count(F.lit(1)).cast("double").alias("value")).filter("value > 0")
    last = proxies.select(F.lit("all").alias("attribute"), F.lit(len(attrs)).alias("place"), F.lit(4).alias("step"), F.lit("proxies").alias("kind"), "value")
    # at most three issues per attribute column and one more: one small partition
    number = F.row_number().over(W.orderBy("place", "step"))
    return own.unionByName(last).select(number.alias("issue_no"), "attribute", "kind", "value")
