"""The audit as a whole, from one table of groups.

Everything an audit states about groups follows from a few sums per (model, attribute, group). The rows
are read once for them; the phases then work on the group table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.functions.numeric import as_double, binary, flag, ratio
from evenhand.operators import audit, explain, labels, metrics, risk
from evenhand.plans import defaults
from evenhand.plans.association import binary_tests
from evenhand.plans.longform import require, to_long
from evenhand.sources.tables import scratch_folder, write_report, written

OVERALL = "overall"


def group_table(
    df: DataFrame, attrs: Sequence[str], target: str, pred: str, columns: Sequence[str] = (), features: Sequence[str] = (), by: Sequence[str] = ()
) -> DataFrame:
    """``by, attribute, grp`` with rows, labels, predictions, confusion counts, nulls of ``columns`` and sums of
    ``features``; the attribute ``overall`` has all rows as one group. One scan, one shuffle of group rows."""
    require(df, [*attrs, *columns, *features, *by])
    types = dict(df.dtypes)
    gone = {c: F.col(c).isNull() if types[c] not in ("double", "float") else F.col(c).isNull() | F.isnan(c) for c in columns}
    keep = [
        *by, binary(target).alias("_y"), binary(pred).alias("_p"), *[g.cast("int").alias("null:" + c) for c, g in gone.items()],
        *[as_double(F.col(f)).alias("x:" + f) for f in features],
    ]
    long = to_long(df.withColumn(OVERALL, F.lit("all")), [*attrs, OVERALL], keep)
    y, p = F.col("_y"), F.col("_p")
    cells = {"tp": (y == 1) & (p == 1), "fp": (y == 0) & (p == 1), "fn": (y == 1) & (p == 0), "tn": (y == 0) & (p == 0)}
    return long.groupBy(*by, "attribute", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.count("_y").alias("labelled"), F.coalesce(F.sum("_y"), F.lit(0)).alias("positives"),
        F.count("_p").alias("predicted"), F.coalesce(F.sum("_p"), F.lit(0)).alias("selected"), *[F.sum(flag(c)).alias(n) for n, c in cells.items()],
        *[F.sum("null:" + c).alias("null:" + c) for c in columns],
        *[F.struct(F.count("x:" + f).alias("n"), F.coalesce(F.sum("x:" + f), F.lit(0.0)).alias("s")).alias("x:" + f) for f in features],
    )


def _rates(groups: DataFrame, by: Sequence[str], n: str, positives: str) -> DataFrame:
    rate = F.try_divide(F.col(positives).cast("double"), F.col(n))
    return groups.select(*by, "attribute", "grp", F.col(n).alias("n"), F.col(positives).alias("positives"), rate.alias("rate"))


def _mean_attributions(groups: DataFrame, coefficients: dict[str, float], by: Sequence[str]) -> DataFrame:
    """Mean contribution of each feature per group; contributions are relative to the mean over all models."""
    whole = groups.filter(F.col("attribute") == OVERALL).agg(
        *[F.try_divide(F.sum(F.col(f"`x:{f}`.s")), F.sum(F.col(f"`x:{f}`.n"))).alias("m:" + f) for f in coefficients]
    )

    def mean(f: str, b: float) -> Column:
        x = F.col(f"`x:{f}`")
        return F.coalesce((x["s"] - x["n"] * whole.select(f"`m:{f}`").scalar()) * F.lit(float(b)) / F.col("n"), F.lit(0.0))

    parts = F.array(*[F.struct(F.lit(f).alias("feature"), mean(f, b).alias("mean_phi")) for f, b in coefficients.items()])
    return groups.filter(F.col("attribute") != OVERALL).select(*by, "attribute", "grp", F.inline(parts))


def components(
    groups: DataFrame, columns: Sequence[str], coefficients: dict[str, float], key: str = "model_id", attrs: Sequence[str] | None = None
) -> DataFrame:
    """The six risk components per model from a group table (by ``key``). ``attrs`` limits all but the count of
    underrepresented groups."""
    by = [key]
    every = groups.filter(F.col("attribute") != OVERALL)
    some = every.filter(F.col("attribute").isin(*attrs)) if attrs else every
    marked = groups.filter(F.col("attribute").isin(*attrs, OVERALL)) if attrs else groups
    label_rates = _rates(some, by, "labelled", "positives")
    return risk.risk_components(
        groups.filter(F.col("attribute") == OVERALL).select(key), key,
        binary_tests(label_rates, [*by, "attribute"]).select(key, F.round("cramers_v", 4).alias("cramers_v")),
        metrics.parity_of(_rates(some, by, "predicted", "selected"), by),
        audit.small_groups(audit.shares(every.select(*by, "attribute", "grp", "n"), by)),
        audit.wide_gaps(audit.missing_rates(some, columns, by), defaults.MISSING_GAP, by),
        explain.explainability_disparity(explain.attribution_divergence(_mean_attributions(marked, coefficients, by), by), by),
        labels.bias_of(label_rates, by),
    )


def audit_run(
    df: DataFrame, attrs: Sequence[str], target: str, pred: str, columns: Sequence[str], coefficients: dict[str, float], key: str = "model_id"
) -> DataFrame:
    """All phases in long form: ``key, phase, attribute, metric, value``; risk rows have the attribute ``all``.

    The rows of ``df`` are read once; the group table is written, and every phase reads it from there."""
    groups = written(group_table(df, attrs, target, pred, columns, list(coefficients), [key]), "groups")
    by, keys = [key], [key, "attribute"]
    each = groups.filter(F.col("attribute") != OVERALL)
    gap = lambda c: F.max(c) - F.min(c)

    def long(phase: str, table: DataFrame, **values: Column) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()])
        return table.select(key, F.lit(phase).alias("phase"), "attribute", F.inline(pairs))

    parts = audit.shares(each.select(*keys, "grp", "n"), by).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"), F.min("pct").alias("smallest"), F.count_if(F.col("pct") / 100 < defaults.UNDERREPRESENTED).alias("under")
    )
    missing = audit.missing_rates(each, columns, by).groupBy(*keys, "column_name").agg(gap("missing_pct").alias("g")).groupBy(*keys).agg(F.max("g").alias("g"))
    given, decided = _rates(each, by, "labelled", "positives"), _rates(each, by, "predicted", "selected")
    pct = given.withColumn("pct", F.round(F.col("rate") * 100, 2)).groupBy(*keys).agg(F.min("pct").alias("lo"), F.max("pct").alias("hi"))
    tests = binary_tests(given, keys)
    impact = decided.groupBy(*keys).agg(F.min("rate").alias("lo"), F.max("rate").alias("hi"))
    odds = metrics.rates_of(each).groupBy(*keys).agg(gap("tpr").alias("tpr"), gap("fpr").alias("fpr"))
    drivers = explain.attribution_divergence(_mean_attributions(groups, coefficients, by), by).groupBy(*keys).agg(F.max("divergence").alias("d"))
    found = written(components(groups, columns, coefficients, key), "components")
    score = risk.risk_score(found, key)
    whole = F.lit("all").alias("attribute")
    phases = [
        long("audit", parts, groups=F.col("groups"), smallest_share=F.col("smallest"), underrepresented=F.col("under")),
        long("audit", missing, missing_gap=F.round("g", 2)),
        long("labels", pct, label_gap=F.round(F.col("hi") - F.col("lo"), 2), label_ratio=F.round(ratio(F.col("lo"), F.col("hi")), 4)),
        long("bias", tests, chi_square=F.round("chi_square", 4), cramers_v=F.round("cramers_v", 4)),
        long("fairness", metrics.parity_of(decided, by), dp_gap=F.col("gap")),
        long("fairness", impact, di_ratio=F.round(ratio(F.col("lo"), F.col("hi")), 4)),
        long("fairness", odds, tpr_gap=F.round("tpr", 4), fpr_gap=F.round("fpr", 4)),
        long("explain", drivers, top_divergence=F.col("d")),
        found.select(key, F.lit("risk").alias("phase"), whole, F.col("component").alias("metric"), "value"),
        long("risk", score.withColumn("attribute", F.lit("all")), score=F.col("score")),
    ]
    out = phases[0]
    for p in phases[1:]:
        out = out.unionByName(p)
    return out


def write_phases(report: DataFrame, path: str | None = None) -> str:
    """Every phase of a report as JSON lines, one folder for each; returns the path."""
    path = path or scratch_folder(report.sparkSession, "phases")
    write_report(report, path, partition="phase")
    return path
