"""Monitoring in batch: disparate-impact trend, drift, feedback loops, alerts, late decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evenhand.functions.numeric import ratio, safe_corr
from evenhand.operators.metrics import disparate_impact
from evenhand.plans import defaults
from evenhand.plans.longform import to_long
from evenhand.plans.quantiles import bin_edges, discretise
from evenhand.sources.tables import written


def period_of(ts: str, every: str = f"{defaults.CHECK_INTERVAL_DAYS} days") -> Column:
    """Start of the calendar unit (``month``, ``year``...) or of an interval such as ``30 days``."""
    if " " in every:
        return F.window(ts, every)["start"]
    return F.date_trunc(every, F.col(ts)).cast("timestamp_ntz")


def di_trend(df: DataFrame, ts: str, attrs: Sequence[str], pred: str, every: str = f"{defaults.CHECK_INTERVAL_DAYS} days", alert: float = defaults.DISPARATE_IMPACT) -> DataFrame:
    """Disparate impact per period and attribute, with the previous period's value and an alert."""
    by_period = disparate_impact(df.withColumn("period", period_of(ts, every)), attrs, pred, ["period"], alert)
    prev = F.lag("ratio").over(W.partitionBy("attribute").orderBy("period"))  # one row per period
    return by_period.select("period", "attribute", F.col("ratio").alias("di"), prev.alias("prev_di"), (F.col("ratio") < alert).alias("alert"))


_FLOOR = 1e-4  # share given to a bin that is empty on one side, so that the logarithm exists


def _share(counts: DataFrame, keys: Sequence[str], n: str, out: str) -> DataFrame:
    """Counts as shares of their key's total; the totals are aggregated and joined, so that a key
    with very many values is not gathered in one window."""
    totals = counts.groupBy(*keys).agg(F.sum(n).alias("_total"))
    return counts.join(totals, list(keys)).withColumn(out, F.col(n) / F.col("_total")).drop(n, "_total")


def feature_drift(
    df: DataFrame, baseline: Column, period: Column, features: Sequence[str], by: Sequence[str] = (), threshold: float = defaults.DRIFT,
    attrs: Sequence[str] = (),
) -> DataFrame:
    """Population stability index and total variation of every feature per period against the
    baseline rows. Numeric features use the baseline's quintiles, a null is a category.

    With ``attrs`` each group is compared with its own baseline.
    """
    marked = df.withColumn("_base", F.coalesce(baseline, F.lit(False))).withColumn("period", period)
    edges = bin_edges(marked.filter("_base"), features)
    codes = [F.coalesce(c, F.lit("null")).alias("feat:" + f) for c, f in zip(discretise(df, features, edges), features)]
    keys = [*by, *(["attribute", "grp"] if attrs else [])]
    wide = marked.select(*by, "_base", "period", *attrs, *codes)
    rows = to_long(wide, attrs, [*by, "_base", "period", *["feat:" + f for f in features]]) if attrs else wide
    ids = [*keys, "_base", "period"]
    long = rows.unpivot(ids, ["feat:" + f for f in features], "feature", "value")
    # counted once for baseline and periods together; all that follows reads these counts
    counts = written(
        long.groupBy(*keys, F.substring_index("feature", "feat:", -1).alias("feature"), "_base", "period", "value").agg(F.count(F.lit(1)).alias("n")),
        "drift",
    )
    base = counts.filter("_base").groupBy(*keys, "feature", "value").agg(F.sum("n").alias("bn"))
    base = _share(base, [*keys, "feature"], "bn", "q")
    now = _share(counts.filter("NOT _base").drop("_base"), [*keys, "feature", "period"], "n", "p")
    # A baseline value that a period lacks adds a term of its own; all such terms follow from the sum over the whole
    # baseline, less the values the period has. So only values that occur are joined, never periods x values.
    qf, pf = F.greatest("q", F.lit(_FLOOR)), F.greatest("p", F.lit(_FLOOR))
    base = base.withColumn("absent", (_FLOOR - qf) * F.log(_FLOOR / qf))
    whole = base.groupBy(*keys, "feature").agg(F.sum("absent").alias("all_absent"), F.sum("q").alias("all_q"))
    here = now.join(base, [*keys, "feature", "value"], "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    sums = here.groupBy(*keys, "feature", "period").agg(
        F.sum((pf - qf) * F.log(pf / qf) - F.coalesce("absent", F.lit(0.0))).alias("psi"), F.sum(F.abs(F.col("p") - F.col("q")) - F.col("q")).alias("tv")
    )
    out = sums.join(whole, [*keys, "feature"], "left").select(
        *keys, "feature", "period", F.round(F.col("psi") + F.coalesce("all_absent", F.lit(0.0)), 4).alias("psi"),
        F.round((F.col("tv") + F.coalesce("all_q", F.lit(0.0))) / 2, 4).alias("tv"),
    )
    return out.withColumn("drifted", F.col("psi") > threshold)


def drift_class(
    df: DataFrame, baseline: Column, period: Column, features: Sequence[str], attrs: Sequence[str], threshold: float = defaults.DRIFT,
    uneven: float = 0.05,
) -> DataFrame:
    """Per-group drift compared: ``benign`` when all groups drift alike, ``harmful`` when not,
    ``none`` below the threshold."""
    per = feature_drift(df, baseline, period, features, threshold=threshold, attrs=attrs)
    out = per.groupBy("period", "feature", "attribute").agg(F.min("psi").alias("min_psi"), F.max("psi").alias("max_psi"))
    kind = F.when(F.col("max_psi") <= threshold, "none").when(F.round(F.col("max_psi") - F.col("min_psi"), 4) > uneven, "harmful").otherwise("benign")
    return out.withColumn("drift_class", kind)


def feedback_loop(
    decisions: DataFrame, outcomes: DataFrame, key: str, decided: str, observed: str, pred: str, attrs: Sequence[str],
    min_days: int = 90, max_days: int = 180, limit: float = 0.1,
) -> DataFrame:
    """Decision against the outcome seen 90 to 180 days later, per group: correlation, success of
    rejected and approved rows, and whether outcomes follow the decisions."""
    age = F.datediff(F.col(observed), F.col(decided))
    # the key is equal on both sides, the time range is checked on the joined pairs
    pairs = decisions.select(key, decided, pred, *attrs).join(outcomes.select(key, observed, "outcome"), key).filter(
        (age >= min_days) & (age <= max_days)
    )
    long = to_long(pairs, attrs, [F.col(pred).cast("double").alias("_p"), F.col("outcome").cast("double").alias("_o")])
    r = safe_corr(F.col("_p"), F.col("_o"))
    out = long.groupBy("attribute", "grp").agg(
        F.count(F.lit(1)).alias("n"), r.alias("_r"),
        F.round(F.avg(F.when(F.col("_p") == 0, F.col("_o"))), 4).alias("rejected_success"),
        F.round(F.avg(F.when(F.col("_p") == 1, F.col("_o"))), 4).alias("approved_success"),
    )
    return out.select(
        "attribute", "grp", "n", F.round("_r", 4).alias("r"), "rejected_success", "approved_success",
        F.coalesce(F.round("_r", 4) > limit, F.lit(False)).alias("active"),
    )


def fairness_alerts(trend: DataFrame, drift: DataFrame, loops: DataFrame) -> DataFrame:
    """One table of alerts: low disparate impact, drift above the threshold, active feedback loop."""
    di = trend.filter("alert").select(F.lit("disparate_impact").alias("kind"), F.col("period").cast("string").alias("period"), F.col("attribute").alias("subject"), F.col("di").alias("value"))
    dr = drift.filter("drifted").select(F.lit("drift").alias("kind"), F.col("period").cast("string").alias("period"), F.col("feature").alias("subject"), F.col("psi").alias("value"))
    lo = loops.filter("active").select(F.lit("feedback_loop").alias("kind"), F.lit(None).cast("string").alias("period"), F.concat_ws("=", "attribute", "grp").alias("subject"), F.col("r").alias("value"))
    return di.unionByName(dr).unionByName(lo)


def late_report(df: DataFrame, event_ts: str, arrived: str, every: str, delay: str) -> DataFrame:
    """Per window: decisions, how many arrived after the window's end plus the allowed delay, and
    their share. The batch view of what a stream with that watermark would leave out."""
    w = F.window(event_ts, every)
    late = F.col(arrived) > w["end"] + F.expr(f"INTERVAL {delay}")
    return df.groupBy(w["start"].alias("window_start")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(late).alias("n_late"), F.round(ratio(F.count_if(late), F.count(F.lit(1))), 4).alias("late_share")
    )
