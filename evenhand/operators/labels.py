"""Label audit: are the recorded outcomes themselves tied to group membership?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from evenhand.functions.numeric import argmax, argmin, cap1, ratio
from evenhand.operators.association import chi_square_tests
from evenhand.plans import defaults
from evenhand.plans.association import binary_tests, with_p
from evenhand.plans.longform import group_rates, to_long, with_totals
from evenhand.plans.quantiles import bin_edges, discretise


def label_distribution(df: DataFrame, attrs: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    return group_rates(df, attrs, target, by).select(
        *by, "attribute", "grp", F.round(F.col("rate") * 100, 2).alias("approval_rate"), "n",
        F.col("positives").alias("approved_n"), (F.col("n") - F.col("positives")).alias("rejected_n"),
    )


def disparity(rates: DataFrame, rate: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest and smallest rate of each attribute, gap and min/max ratio (0 when the max is 0)."""
    r = F.col(rate)
    out = rates.groupBy(*by, "attribute").agg(
        F.max(r).alias("max_rate"), argmax("grp", r).alias("max_group"),
        F.min(r).alias("min_rate"), argmin("grp", r).alias("min_group"),
    )
    return out.withColumn("gap", F.round(F.col("max_rate") - F.col("min_rate"), 2)).withColumn(
        "ratio", F.round(ratio(F.col("min_rate"), F.col("max_rate")), 4)
    )


def label_disparity(df: DataFrame, attrs: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    return disparity(label_distribution(df, attrs, target, by), "approval_rate", by)


def label_independence(df: DataFrame, attrs: Sequence[str], target: str, by: Sequence[str] = (), alpha: float = defaults.ALPHA) -> DataFrame:
    """Chi-square (or Fisher for a small 2x2) of label against each attribute."""
    return chi_square_tests(df, attrs, target, by, alpha=alpha).select(*by, "attribute", "test", "p_value", "significant")


def counterfactual_gap(df: DataFrame, attrs: Sequence[str], target: str, by: Sequence[str] = (), limit: float = 0.15) -> DataFrame:
    """Rate contrast of attributes with exactly two groups (ordered by value); others are skipped."""
    rates = group_rates(df, attrs, target, by)
    two = rates.groupBy(*by, "attribute").agg(
        F.count(F.lit(1)).alias("n_groups"), F.min("grp").alias("group_1"), F.max("grp").alias("group_2"),
        F.min_by("rate", "grp").alias("_r1"), F.max_by("rate", "grp").alias("_r2"),
    )
    ok = F.col("n_groups") == 2
    gap = F.abs(F.col("_r1") - F.col("_r2"))
    return two.select(
        *by, "attribute", "n_groups",
        F.when(ok, F.col("group_1")).alias("group_1"), F.when(ok, F.round(F.col("_r1") * 100, 2)).alias("rate_1"),
        F.when(ok, F.col("group_2")).alias("group_2"), F.when(ok, F.round(F.col("_r2") * 100, 2)).alias("rate_2"),
        F.when(ok, F.round(gap * 100, 2)).alias("gap"),
        F.when(~ok, "skipped").when(gap > limit, "biased").otherwise("ok").alias("status"),
    )


def matched_counterfactual(df: DataFrame, attrs: Sequence[str], target: str, features: Sequence[str], max_discrete: int = 5) -> DataFrame:
    """Label difference between groups among rows that agree on all (binned) features.

    Rows meet in a cell of equal feature codes; a cell with two or more groups contributes the
    spread of its group rates, weighted by its smallest group. No row is paired with another.
    """
    edges = bin_edges(df, features, keep_discrete=max_discrete)
    codes = discretise(df, features, edges)
    cell = F.concat_ws("|", *[F.coalesce(c, F.lit("null")) for c in codes]).alias("cell")
    rows = to_long(df, attrs, [cell, F.col(target).cast("int").alias("_y")]).filter(F.col("_y").isNotNull())
    groups = rows.groupBy("attribute", "cell", "grp").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("rate"))
    cells = groups.groupBy("attribute", "cell").agg(
        F.count(F.lit(1)).alias("g"), (F.max("rate") - F.min("rate")).alias("spread"), F.min("n").alias("weight"), F.sum("n").alias("n")
    )
    both = cells.filter("g >= 2")
    return both.groupBy("attribute").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_matched"),
        F.round(F.sum(F.col("spread") * F.col("weight")) / F.sum("weight"), 4).alias("matched_gap"),
    )


def outcome_vs_label(df: DataFrame, outcomes: DataFrame, key: str, attrs: Sequence[str], target: str) -> DataFrame:
    """Agreement of the label with the real outcome per group, and how many rejected succeeded.

    ``outcomes`` has one row per key with a 0/1 ``outcome``.
    """
    both = df.select(key, *attrs, target).join(outcomes.select(key, "outcome"), key)
    y, o = F.col("_y"), F.col("outcome")
    long = to_long(both, attrs, [F.col(target).cast("int").alias("_y"), "outcome"])
    return long.groupBy("attribute", "grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((y == o).cast("int")), 4).alias("agreement"),
        F.round(F.avg(F.when(y == 0, o)), 4).alias("rejected_success"),
        F.round(F.avg(F.when(y == 1, o)), 4).alias("approved_success"),
    )


def label_bias_score(df: DataFrame, attrs: Sequence[str], target: str, by: Sequence[str] = (), alpha: float = defaults.ALPHA) -> DataFrame:
    """Mean of up to three scores per attribute: rate gap, dependence test, two-group contrast.

    All three follow from one table of group rates, so the rows are read once.
    """
    return bias_of(group_rates(df, attrs, target, by), by, alpha)


def bias_of(rates: DataFrame, by: Sequence[str] = (), alpha: float = defaults.ALPHA) -> DataFrame:
    """:func:`label_bias_score` from a table of group rates."""
    keys = [*by, "attribute"]
    pct = F.round(F.col("rate") * 100, 2)
    extra = {"gap": F.round(F.max(pct) - F.min(pct), 2), "rate_1": F.min_by("rate", "grp"), "rate_2": F.max_by("rate", "grp")}
    tests = with_p(binary_tests(rates, keys, extra=extra), keys, F.col("min_expected") < defaults.FISHER_CELL)
    contrast = F.abs(F.col("rate_1") - F.col("rate_2"))
    pair = F.when(contrast > 0.15, 0.9).otherwise(cap1(F.round(contrast * 100, 2) / 30.0))
    scores = F.array(cap1(F.col("gap") / 50.0), F.when(F.col("p_value") < alpha, 0.8).otherwise(0.1), F.when(F.col("r") == 2, pair))
    each = tests.select(*by, F.explode(scores).alias("s")).filter(F.col("s").isNotNull())
    return each.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_scores"), F.round(F.coalesce(F.avg("s"), F.lit(0.0)), 4).alias("label_bias")
    )


def label_gate(scores: DataFrame) -> DataFrame:
    """HIGH above 0.6 (stop), MODERATE above 0.3, else LOW; the caller decides what to do."""
    s = F.col("label_bias")
    return scores.withColumn("level", F.when(s > 0.6, "HIGH").when(s > 0.3, "MODERATE").otherwise("LOW")).withColumn(
        "should_halt", s > 0.6
    )


def label_adjust_weights(df: DataFrame, attr: str, target: str) -> DataFrame:
    """Weight P(g)P(y) / P(g,y) per (group, label), which makes label and group independent."""
    cells = df.filter(F.col(attr).isNotNull() & F.col(target).isNotNull()).groupBy(
        F.col(attr).alias("grp"), F.col(target).alias("y")
    ).agg(F.count(F.lit(1)).alias("n"))
    ng = with_totals(cells, ["grp"], _ng=F.sum("n"))
    both = with_totals(ng, ["y"], _ny=F.sum("n"))
    total = cells.agg(F.sum("n").alias("t")).scalar()
    return both.select("grp", "y", "n", F.round(F.col("_ng") * F.col("_ny") / (F.col("n") * total), 6).alias("weight"))
