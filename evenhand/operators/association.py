"""Statistical bias detection: tests, association strength, proxies, intersections, intervals."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evenhand.functions.numeric import as_double, binary, flag, level3, ratio, safe_corr
from evenhand.functions.pvalues import corr_p
from evenhand.plans import defaults
from evenhand.plans.association import binary_tests, chi_square, with_fisher, with_p
from evenhand.plans.eigen import largest_eigenpairs
from evenhand.plans.longform import contingency, group_rates, numeric_among, require, to_long, with_totals
from evenhand.plans.quantiles import bin_edges, discretise
from evenhand.plans.resample import intervals, reliability, resampled
from evenhand.sources.tables import written


def contingency_table(df: DataFrame, attrs: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (attribute, group, target value); absent cells are zero."""
    return contingency(df, attrs, target, by)


def contingency_wide(df: DataFrame, attrs: Sequence[str], target: str, values: Sequence[str]) -> DataFrame:
    """One column per given target value."""
    cells = contingency(df, attrs, target)
    return cells.groupBy("attribute", "grp").pivot("y", list(values)).agg(F.sum("n")).na.fill(0)


def _strength(v: Column) -> Column:
    return level3(v, [("WEAK", 0.1), ("MODERATE", 0.3)], "STRONG")


def chi_square_tests(
    df: DataFrame, attrs: Sequence[str], target: str, by: Sequence[str] = (), alpha: float = defaults.ALPHA,
    threshold: float = defaults.CRAMERS_V, fisher_cell: float = defaults.FISHER_CELL, binning: str = "discrete",
) -> DataFrame:
    """Every attribute against the 0/1 target, in one scan: chi2 (Yates at dof 1), p, V, strength.

    Fisher's exact test replaces the p-value of a 2x2 whose smallest expected count is below
    ``fisher_cell``. The V of a numeric attribute with more than five values is that of its
    quintiles. ``binning="quantile_always"`` also cuts the target into quantiles, which
    collapses a 0/1 column to one bin and makes V zero.
    """
    keys = [*by, "attribute"]
    tests = with_p(binary_tests(group_rates(df, attrs, target, by), keys), keys, F.col("min_expected") < fisher_cell)
    tests = _quintile_v(tests, df, attrs, target, by)
    v = F.lit(0.0) if binning == "quantile_always" else F.col("cramers_v")
    return tests.withColumn("cramers_v", v).select(
        *keys, "n", "r", "k", "dof",
        F.round("chi_square", 4).alias("chi_square"), F.round("p_value", 6).alias("p_value"),
        F.round("cramers_v", 4).alias("cramers_v"), F.round("min_expected", 2).alias("min_expected"), "test",
        _strength(F.col("cramers_v")).alias("strength"), (F.col("p_value") < alpha).alias("significant"),
        (F.col("cramers_v") >= threshold).alias("above_threshold"),
    )


def _quintile_v(tests: DataFrame, df: DataFrame, attrs: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    """The tests with V taken from quintiles for numeric attributes with more than five values."""
    edges = bin_edges(df, numeric_among(df, attrs))
    wide = [a for a, e in edges.items() if e is not None]
    if not wide:
        return tests
    keys = [*by, "attribute"]
    binned = df.select(*by, target, *discretise(df, wide, edges))
    v = binary_tests(group_rates(binned, wide, target, by), keys).select(*keys, F.col("cramers_v").alias("_v"))
    return tests.join(v, keys, "left").withColumn("cramers_v", F.coalesce("_v", "cramers_v")).drop("_v")


def cramers_v_target(df: DataFrame, attrs: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """V of every attribute against the target, without the test columns (no Python involved)."""
    keys = [*by, "attribute"]
    t = _quintile_v(binary_tests(group_rates(df, attrs, target, by), keys), df, attrs, target, by)
    return t.select(*keys, "n", F.round("cramers_v", 4).alias("cramers_v"), _strength(F.col("cramers_v")).alias("strength"))


def fisher_exact(cells: DataFrame, keys: Sequence[str], row: str, col: str) -> DataFrame:
    """Two-sided Fisher p of every 2x2 among the tables of cells ``keys, row, col, n``."""
    tables = chi_square(cells, keys, row, col).filter(F.col("a").isNotNull())
    out = with_fisher(tables.select(*keys, "a", "b", "c", "d", "min_expected"), keys)
    return out.select(*keys, "a", "b", "c", "d", F.round("min_expected", 4).alias("min_expected"), F.round("fisher_p", 6).alias("p_value"))


def proxy_detection(
    df: DataFrame, attrs: Sequence[str], features: Sequence[str], threshold: float = defaults.CRAMERS_V, keep_discrete: int = 5,
) -> DataFrame:
    """V of every feature against every sensitive attribute.

    Numeric columns with more than ``keep_discrete`` values are cut into quintiles. All pairs are
    counted in one pass: rows are expanded to (attribute, feature) pairs before the map-side
    aggregation, only the cells travel.
    """
    require(df, [*attrs, *features])
    edges = bin_edges(df, list(dict.fromkeys([*attrs, *features])), keep_discrete=keep_discrete)
    codes = discretise(df, features, edges)
    wide = df.select(*[c.alias("attr:" + a) for c, a in zip(discretise(df, attrs, edges), attrs)], *[c.alias("feat:" + f) for c, f in zip(codes, features)])
    pairs = wide.unpivot(["attr:" + a for a in attrs], ["feat:" + f for f in features], "feature", "value")
    pairs = pairs.filter(F.col("value").isNotNull()).unpivot(["feature", "value"], ["attr:" + a for a in attrs], "attribute", "grp")
    cells = (
        pairs.filter(F.col("grp").isNotNull())
        .groupBy(F.substring_index("attribute", "attr:", -1).alias("attribute"), F.substring_index("feature", "feat:", -1).alias("feature"), "value", "grp")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("attribute") != F.col("feature"))
    )
    tests = chi_square(cells, ["attribute", "feature"], "value", "grp")
    v = F.round("cramers_v", 4)
    return tests.select("attribute", "feature", v.alias("cramers_v"), (F.col("cramers_v") >= threshold).alias("is_proxy"))


def proxy_strength(proxies: DataFrame) -> DataFrame:
    v = F.col("cramers_v")
    return proxies.filter("is_proxy").select(
        "attribute", "feature", "cramers_v", F.when(v > 0.6, "very strong").when(v > 0.4, "strong").otherwise("moderate").alias("strength")
    )


def point_biserial(
    df: DataFrame, attrs: Sequence[str], features: Sequence[str], threshold: float = defaults.CORRELATION, min_rows: int = 10
) -> DataFrame:
    """Correlation of sensitive attributes with numeric features.

    A two-valued string attribute counts as 1 for its first value in order, else 0 (also null).
    Group moments are aggregated first and r follows from them, so attributes with more values
    drop out on the group table. A numeric attribute is correlated as it is.
    """
    numeric = numeric_among(df, attrs)
    named = [a for a in attrs if a not in numeric]
    parts = ([_two_group_r(df, named, features)] if named else []) + ([_pearson_r(df, numeric, features)] if numeric else [])
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    size = F.abs("r")
    return out.filter((F.col("n") >= min_rows) & F.col("r").isNotNull()).withColumn("p_value", F.round(corr_p("r", "n"), 6)).select(
        "attribute", "feature", "n", F.round("r", 4).alias("r"), "p_value",
        F.when(size >= threshold, "INVESTIGATE").when(size >= 0.1, "MONITOR").otherwise("OK").alias("flag"),
    )


def _pearson_r(df: DataFrame, attrs: Sequence[str], features: Sequence[str]) -> DataFrame:
    pairs = [(a, f) for a in attrs for f in features if a != f]
    both = {(a, f): as_double(F.col(a)) + as_double(F.col(f)) for a, f in pairs}
    wide = df.agg(*[
        F.struct(F.lit(a).alias("attribute"), F.lit(f).alias("feature"), F.count(both[(a, f)]).alias("n"),
                 safe_corr(as_double(F.col(a)), as_double(F.col(f))).alias("r")).alias(f"p{i}")
        for i, (a, f) in enumerate(pairs)
    ])
    return wide.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])))


def _two_group_r(df: DataFrame, attrs: Sequence[str], features: Sequence[str]) -> DataFrame:
    vals = [as_double(F.col(f)).alias("f:" + f) for f in features]
    long = to_long(df, attrs, vals, keep_null=True)
    wide = long.groupBy("attribute", "grp").agg(
        *[F.struct(F.lit(f).alias("feature"), F.count("f:" + f).alias("n"), F.avg("f:" + f).alias("mean"), F.var_pop("f:" + f).alias("var")).alias(f"m{i}")
          for i, f in enumerate(features)]
    )
    groups = wide.select("attribute", "grp", F.inline(F.array(*[F.col(f"m{i}") for i in range(len(features))])))
    n, mean = F.col("n").cast("double"), F.col("mean")
    totals = with_totals(
        groups, ["attribute", "feature"], _first=F.min("grp"), _groups=F.count("grp"), _all=F.try_divide(F.sum(n * mean), F.sum(n))
    )
    coded = totals.filter((F.col("_groups") == 2) & (F.col("n") > 0))
    one = F.col("grp").eqNullSafe(F.col("_first")).cast("double")
    sums = coded.groupBy("attribute", "feature").agg(
        F.sum("n").alias("n"), F.sum(n * one).alias("n1"), F.sum(n * one * (mean - F.col("_all"))).alias("sxy"),
        F.sum(n * (F.col("var") + (mean - F.col("_all")) * (mean - F.col("_all")))).alias("ss"),
    )
    total = F.col("n").cast("double")
    r = F.try_divide(F.col("sxy"), F.sqrt(F.col("ss") * F.col("n1") * (total - F.col("n1")) / total))
    return sums.select("attribute", "feature", "n", r.alias("r"))


def covariance_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample covariances (upper triangle) over complete rows, in one aggregation."""
    rows = df.select(*[as_double(F.col(c)).alias(c) for c in columns]).na.drop()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = rows.agg(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.covar_samp(a, b).alias("covariance")).alias(f"c{i}")
                      for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(pairs))])))


def pca_loadings(df: DataFrame, columns: Sequence[str], sensitive: Sequence[str] = (), limit: float = 0.3, components: int = 5) -> DataFrame:
    """|loading| of every column on up to five components (centred, unscaled, complete rows).

    A sensitive column is flagged when it loads above ``limit`` on the first component; ``top5``
    marks its five largest. Empty when there are fewer than 3 columns or 10 complete rows.
    """
    schema = "component int, explained_variance double, feature string, loading double, top5 boolean, flagged boolean"
    spark = df.sparkSession
    rows = df.select(*[as_double(F.col(c)).alias(c) for c in columns]).na.drop()
    if len(columns) < 3 or rows.limit(10).count() < 10:
        return spark.createDataFrame([], schema)
    vec = VectorAssembler(inputCols=list(columns), outputCol="v").transform(rows)
    model = PCA(k=min(components, len(columns)), inputCol="v", outputCol="pc").fit(vec)
    load, ratio = np.abs(model.pc.toArray()), model.explainedVariance.toArray()
    top = set(np.argsort(-load[:, 0], kind="stable")[:5])
    out = [
        (k + 1, round(float(ratio[k]), 4), c, round(float(load[j, k]), 4), k == 0 and j in top,
         bool(k == 0 and c in set(sensitive) and load[j, 0] > limit))
        for k in range(load.shape[1]) for j, c in enumerate(columns)
    ]
    return spark.createDataFrame(out, schema)


def burt_table(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Co-occurrence counts of all categories (both orders and the diagonal).

    The rows are first aggregated to distinct value combinations; only those are paired up, by
    attribute, not row by row.
    """
    combos = df.select(*[F.col(a).cast("string").alias(a) for a in attrs]).na.drop().groupBy(*attrs).agg(F.count(F.lit(1)).alias("n"))
    cats = F.array(*[F.concat(F.lit(a + "="), F.col(a)) for a in attrs])
    pairs = combos.select("n", F.explode(cats).alias("cat_a"), cats.alias("_all")).select("n", "cat_a", F.explode("_all").alias("cat_b"))
    return pairs.groupBy("cat_a", "cat_b").agg(F.sum("n").alias("n"))


def mca_coordinates(df: DataFrame, attrs: Sequence[str], dims: int = 2) -> DataFrame:
    """Category positions of a multiple correspondence analysis: ``category, dim, inertia, abs_coordinate, coordinate, residual``.

    The dimensions are the largest eigenvectors of the standardised Burt matrix D^-1/2 (P - m m') D^-1/2 (category masses m). Only
    the cells that occur are stored; P's trivial direction is taken off by a rank-one term. The eigenvectors come from a block
    Krylov iteration by joins, so neither a category's row nor the list of categories is ever in one place. ``residual``
    is the norm of what an eigenvector leaves over; dimensions without inertia are left out. The entry that is largest in size
    (to nine digits, ties: first category) is positive."""
    q = len(attrs)
    burt = written(burt_table(df, attrs), "burt")
    counts = burt.filter("cat_a = cat_b").select(F.col("cat_a").alias("category"), F.col("n").alias("mass"))
    total = float(counts.agg(F.sum("mass")).first()[0] or 1)  # rows x attributes
    keys = written(counts.select(F.col("category").alias("key"), F.sqrt(F.col("mass") / total).alias("s")), "categories")
    size = keys.select(F.col("key").alias("_k"), "s")
    cells = burt.join(size.select(F.col("_k").alias("cat_a"), F.col("s").alias("sa")), "cat_a").join(size.select(F.col("_k").alias("cat_b"), F.col("s").alias("sb")), "cat_b")
    cells = written(cells.select(F.col("cat_a").alias("a"), F.col("cat_b").alias("b"), (F.col("n") / (total * q) / (F.col("sa") * F.col("sb"))).alias("v")), "cells")
    vectors, values, left = largest_eigenpairs(cells, keys, dims)
    found = F.array(*[F.struct(F.lit(i + 1).alias("dim"), F.lit(float(v)).alias("value"), F.lit(float(r)).alias("residual")) for i, (v, r) in enumerate(zip(values, left))])
    schema = "array<struct<dim:int,value:double,residual:double>>"
    rows = vectors.select("key", "s", "x", F.inline(found.cast(schema))).withColumn("v", F.get("x", F.col("dim") - 1))
    # one row a dimension
    signs = rows.groupBy("dim").agg(F.min_by(F.signum("v"), F.struct(-F.round(F.abs("v"), 9), F.col("key"))).alias("sign"))
    place = F.col("sign") * F.col("v") * F.sqrt("value") / F.col("s")
    return rows.join(signs, "dim").select(
        F.col("key").alias("category"), "dim", F.round("value", 4).alias("inertia"), F.round(F.abs(place), 4).alias("abs_coordinate"), place.alias("coordinate"), "residual"
    )


def mca_association(coordinates: DataFrame) -> DataFrame:
    """``cat_a, cat_b, association``: how much more often than by chance two categories meet, as the given dimensions of
    :func:`mca_coordinates` tell it (the product of the positions); over all dimensions it is exact."""
    left = coordinates.select(F.col("category").alias("cat_a"), "dim", F.col("coordinate").alias("_a"))
    right = coordinates.select(F.col("category").alias("cat_b"), "dim", F.col("coordinate").alias("_b"))
    return left.join(right, "dim").groupBy("cat_a", "cat_b").agg(F.sum(F.col("_a") * F.col("_b")).alias("association"))


def _intersection_groups(df: DataFrame, attrs: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """``intersection, grp, size, n, positives, rate`` for every combination of two or more attributes.

    The rows are counted once on all attributes together; the combinations are rolled up from that
    cube by grouping sets. A null value is the group ``nan``.
    """
    require(df, [*attrs, target, *by])
    y = F.col(target).cast("int")
    cube = df.select(*by, *[F.coalesce(F.col(a).cast("string"), F.lit("nan")).alias(a) for a in attrs], y.alias("_y")).groupBy(*by, *attrs).agg(
        F.count(F.lit(1)).alias("size"), F.count("_y").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("positives")
    )
    sets = [[*by, *combo] for k in range(2, len(attrs) + 1) for combo in combinations(attrs, k)]
    rolled = cube.groupingSets(sets, *by, *attrs).agg(
        F.sum("size").alias("size"), F.sum("n").alias("n"), F.sum("positives").alias("positives"),
        F.concat_ws(" × ", *[F.when(F.grouping(a) == 0, F.lit(a)) for a in attrs]).alias("intersection"),
    )
    return rolled.select(
        *by, "intersection", F.concat_ws("_", *attrs).alias("grp"), "size", "n", "positives",
        F.try_divide(F.col("positives").cast("double"), F.col("n")).alias("rate"),
    )


def intersectional_rates(df: DataFrame, attrs: Sequence[str], target: str) -> DataFrame:
    return _intersection_groups(df, attrs, target).select("intersection", "grp", "size", F.round(F.col("rate") * 100, 2).alias("approval_rate"))


def intersectional_tests(
    df: DataFrame, attrs: Sequence[str], target: str, alpha: float = defaults.ALPHA, small_sample: int = defaults.SMALL_SAMPLE,
    fisher_cell: float = defaults.FISHER_CELL, by: Sequence[str] = (),
) -> DataFrame:
    """One row per combination of attributes: test, V, subgroups, largest approval gap, confidence."""
    groups = _intersection_groups(df, attrs, target, by)
    sized = with_totals(groups, [*by, "intersection"], n_subgroups=F.count(F.lit(1)), smallest=F.min("size"))
    keys = [*by, "intersection", "n_subgroups", "smallest"]
    tests = with_p(binary_tests(sized, keys), keys, F.col("min_observed") < fisher_cell)
    gap = F.round((F.col("max_rate") - F.col("min_rate")) * 100, 2)
    return tests.select(
        *by, "intersection", "n_subgroups", "smallest", F.round("chi_square", 4).alias("chi_square"), "dof", "test",
        F.round("p_value", 6).alias("p_value"), F.round("cramers_v", 4).alias("cramers_v"), gap.alias("max_gap"),
        F.col("max_group").alias("highest_group"), F.col("min_group").alias("lowest_group"),
        (F.col("p_value") < alpha).alias("significant"), (F.col("smallest") < small_sample).alias("low_confidence"),
    )


def intersectional_status(df: DataFrame, attrs: Sequence[str], target: str) -> DataFrame:
    gap = F.col("max_gap")
    stats = binary_tests(_intersection_groups(df, attrs, target), ["intersection"])
    return stats.withColumn("max_gap", F.round((F.col("max_rate") - F.col("min_rate")) * 100, 2)).select(
        "intersection", "max_gap", F.col("min_group").alias("worst_group"), F.col("max_group").alias("best_group"),
        F.when(gap > 20, "urgent").when(gap > 10, "watch").otherwise("ok").alias("status"),
    )


def bootstrap_cramers_v(df: DataFrame, attrs: Sequence[str], target: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """95% bootstrap interval of V per attribute, numeric attributes in the same quintiles as in
    :func:`cramers_v_target`."""
    edges = bin_edges(df, numeric_among(df, attrs))
    wide = [a for a, e in edges.items() if e is not None]
    coded = df.select(target, *[a for a in attrs if a not in wide], *discretise(df, wide, edges))
    cells = to_long(coded, attrs, [binary(target).alias("y")]).filter(F.col("y").isNotNull()).groupBy("attribute", "grp", "y").agg(F.count(F.lit(1)).alias("n"))
    cells = written(cells, "cells")
    drawn = resampled(cells, ["attribute", "grp", "y"], replicates, seed)

    def v_of(table: DataFrame, keys: list[str]) -> DataFrame:
        groups = table.groupBy(*keys, "grp").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("positives"))
        rated = groups.withColumn("rate", F.try_divide(F.col("positives").cast("double"), F.col("n")))
        return binary_tests(rated, keys).select(*keys, "cramers_v")

    out = intervals(v_of(drawn, ["attribute", "replicate"]), v_of(cells, ["attribute"]), ["attribute"], "cramers_v")
    return out.withColumn("reliability", reliability(F.col("_width"))).drop("_width")


def bootstrap_metric_ci(
    df: DataFrame, attrs: Sequence[str], target: str, pred: str, replicates: int = 200, seed: int = 42, by: Sequence[str] = (),
    small_sample: int = defaults.SMALL_SAMPLE,
) -> DataFrame:
    """95% bootstrap intervals of the group metrics per attribute: ``dp_difference``, ``di_ratio``, ``tpr_gap`` and
    ``fpr_gap``, with the confidence of :func:`metric_confidence` for the smallest group."""
    long = to_long(df, attrs, [*by, binary(target).alias("y"), binary(pred).alias("p")]).filter(F.col("p").isNotNull())
    names = [*by, "attribute", "grp", "y", "p"]
    cells = written(long.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "cells")
    drawn = resampled(cells, names, replicates, seed)

    def metrics(table: DataFrame, keys: list[str]) -> DataFrame:
        n = F.col("n")
        given = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
        y, p = F.col("y"), F.col("p")
        groups = table.groupBy(*keys, "grp").agg(
            F.sum(n).alias("rows"), F.try_divide(F.sum(n * p).cast("double"), F.sum(n)).alias("rate"),
            ratio(given((y == 1) & (p == 1)), given(y == 1)).alias("tpr"), ratio(given((y == 0) & (p == 1)), given(y == 0)).alias("fpr"),
        )
        gap = lambda c: F.max(c) - F.min(c)
        wide = groups.groupBy(*keys).agg(
            F.min("rows").alias("smallest"), gap("rate").alias("dp_difference"), ratio(F.min("rate"), F.max("rate")).alias("di_ratio"),
            gap("tpr").alias("tpr_gap"), gap("fpr").alias("fpr_gap"),
        )
        return wide.unpivot([*keys, "smallest"], ["dp_difference", "di_ratio", "tpr_gap", "fpr_gap"], "metric", "value")

    keys = [*by, "attribute", "metric"]
    out = intervals(metrics(drawn, [*by, "attribute", "replicate"]), metrics(cells, [*by, "attribute"]), keys)
    few = F.col("smallest") < small_sample
    return out.select(
        *keys, "smallest", "point", "ci_lower", "ci_upper", "ci_width", F.when(few, "LOW").otherwise(reliability(F.col("_width"))).alias("confidence")
    )


def bootstrap_rate_ci(
    df: DataFrame, attrs: Sequence[str], target: str, replicates: int = 200, seed: int = 42, by: Sequence[str] = ()
) -> DataFrame:
    """95% bootstrap interval of every group's approval rate, each row weighted by Poisson(1) in every replicate. Rows
    without a label count for nothing; a group without any has no row."""
    long = to_long(df, attrs, [*by, binary(target).alias("y")]).filter(F.col("y").isNotNull())
    names = [*by, "attribute", "grp", "y"]
    cells = written(long.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "cells")

    def rates(table: DataFrame, keys: list[str]) -> DataFrame:
        n = F.col("n")
        return table.groupBy(*keys).agg(F.sum(n).alias("rows"), F.try_divide(F.sum(n * F.col("y")).cast("double"), F.sum(n)).alias("value"))

    keys = [*by, "attribute", "grp"]
    point = rates(cells, keys).withColumnRenamed("rows", "n")
    out = intervals(rates(resampled(cells, names, replicates, seed), [*keys, "replicate"]), point, keys)
    return out.withColumn("reliability", reliability(F.col("_width"))).drop("_width")


def metric_confidence(intervals: DataFrame, small_sample: int = defaults.SMALL_SAMPLE) -> DataFrame:
    """HIGH, MEDIUM or LOW confidence from interval width and group size (LOW below 30 rows)."""
    return intervals.withColumn("confidence", F.when(F.col("n") < small_sample, "LOW").otherwise(F.col("reliability")))


def bias_summary(df: DataFrame, attrs: Sequence[str], target: str, features: Sequence[str], threshold: float = defaults.CRAMERS_V) -> DataFrame:
    """Counts of significant tests, strong correlations and intersection flags, with a status."""
    tests = chi_square_tests(df, attrs, target).filter("significant").select(F.lit("test").alias("kind"))
    corr = point_biserial(df, attrs, features).filter("flag = 'INVESTIGATE'").select(F.lit("corr").alias("kind"))
    inter = intersectional_tests(df, attrs, target).filter(F.col("significant") & (F.col("cramers_v") >= threshold)).select(F.lit("inter").alias("kind"))
    found = tests.unionByName(corr).unionByName(inter)
    out = found.agg(*[F.coalesce(F.sum(flag(F.col("kind") == k)), F.lit(0)).alias(a) for k, a in
                      (("test", "significant_tests"), ("corr", "strong_correlations"), ("inter", "intersection_flags"))])
    return out.withColumn("total_flags", F.col("significant_tests") + F.col("strong_correlations") + F.col("intersection_flags")).withColumn(
        "status", F.when((F.col("significant_tests") > 0) | (F.col("intersection_flags") > 0), defaults.STATUS["bias"]).otherwise(defaults.STATUS["no_bias"])
    )
