"""Data audit: who is represented, where values are missing, how outcomes differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.functions.numeric import argmax, argmin, as_double, flag
from evenhand.functions.pvalues import corr_p
from evenhand.plans import defaults
from evenhand.plans.longform import group_rates, numeric_among, require, to_long, with_totals
from evenhand.plans.ordered import row_numbers
from evenhand.sources.tables import written


def group_representation(df: DataFrame, attrs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows and 2-dp percentage per attribute value; nulls count in neither."""
    return shares(to_long(df, attrs, list(by)).groupBy(*by, "attribute", "grp").agg(F.count(F.lit(1)).alias("n")), by)


def shares(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percentage of every group among the counts of its attribute."""
    whole = with_totals(counts, [*by, "attribute"], _total=F.sum("n"))
    return whole.select(*counts.columns, F.round(F.col("n") / F.col("_total") * 100, 2).alias("pct"))


def underrepresented_groups(
    df: DataFrame, attrs: Sequence[str], threshold: float = defaults.UNDERREPRESENTED, by: Sequence[str] = ()
) -> DataFrame:
    """Groups whose rounded share lies below the threshold; HIGH below half of it."""
    return small_groups(group_representation(df, attrs, by), threshold)


def small_groups(parts: DataFrame, threshold: float = defaults.UNDERREPRESENTED) -> DataFrame:
    """The groups of a table of shares that lie below the threshold."""
    share = F.col("pct") / 100
    return parts.filter(share < threshold).withColumn("severity", F.when(share < threshold / 2, "HIGH").otherwise("MEDIUM"))


def _null_counts(df: DataFrame, attrs: Sequence[str], columns: Sequence[str], by: Sequence[str], keep_null: bool = False) -> DataFrame:
    """Per group: rows and nulls of every column, in one aggregation."""
    require(df, columns)
    marks = [F.when(F.col(c).isNull() if t not in ("double", "float") else F.col(c).isNull() | F.isnan(c), 1).otherwise(0)
             .alias("null:" + c) for c, t in df.dtypes if c in set(columns)]
    long = to_long(df, attrs, [*by, *marks], keep_null)
    return long.groupBy(*by, "attribute", "grp").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum("null:" + c).alias("null:" + c) for c in columns]
    )


def missing_by_group(df: DataFrame, attrs: Sequence[str], columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Percentage of nulls of every column within each group, 2 dp."""
    columns = list(columns or [c for c in df.columns if c not in by])
    return missing_rates(_null_counts(df, attrs, columns, by), columns, by)


def missing_rates(groups: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing percentage per group and column from a group table with ``null:<column>`` counts."""
    wide = groups.select(
        *by, "attribute", "grp", *[F.round(F.col("null:" + c) / F.col("n") * 100, 2).alias("null:" + c) for c in columns]
    )
    long = wide.unpivot([*by, "attribute", "grp"], ["null:" + c for c in columns], "column_name", "missing_pct")
    return long.withColumn("column_name", F.substring_index("column_name", "null:", -1))


def missing_gaps(
    df: DataFrame, attrs: Sequence[str], columns: Sequence[str] | None = None,
    threshold: float = defaults.MISSING_GAP, by: Sequence[str] = (),
) -> DataFrame:
    """(attribute, column) pairs whose missing rate differs between groups by more than the threshold."""
    return wide_gaps(missing_by_group(df, attrs, columns, by), threshold, by)


def wide_gaps(rates: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """The differences between groups above the threshold."""
    rate = F.col("missing_pct")
    return (
        rates.groupBy(*by, "attribute", "column_name")
        .agg(
            argmax("grp", rate).alias("max_group"),
            argmin("grp", rate).alias("min_group"),
            (F.max(rate) - F.min(rate)).alias("_gap"),
            F.max(rate).alias("max_pct"),
            F.min(rate).alias("min_pct"),
        )
        .filter(F.col("_gap") > threshold * 100)
        .select(*by, "attribute", "column_name", "max_group", "min_group", F.round("_gap", 2).alias("gap_pct"), "max_pct", "min_pct")
    )


def outcome_distribution(df: DataFrame, attrs: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Approval percentage (2 dp) and number of known outcomes per group."""
    return group_rates(df, attrs, target, by).select(
        *by, "attribute", "grp", F.round(F.col("rate") * 100, 2).alias("approval_rate"), "n"
    )


def missingness_correlations(df: DataFrame, attrs: Sequence[str], columns: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """r and p of each column's null indicator against every sensitive attribute and numeric column.

    Sensitive values are coded 0, 1, 2... in value order and null as -1 (a numeric attribute keeps
    its value, null as 0); the codes exist only on the group table, from whose weighted moments r
    follows, so no row is ever recoded.
    """
    rows = _sensitive_r(_null_counts(df, attrs, columns, (), keep_null=True), columns, numeric_among(df, attrs))
    numeric_rows = _numeric_r(df, columns, numeric)
    both = rows if numeric_rows is None else rows.unionByName(numeric_rows)
    return both.withColumn("p", corr_p("r", "n"))


def _sensitive_r(groups: DataFrame, columns: Sequence[str], numeric_attrs: Sequence[str] = ()) -> DataFrame:
    """r of every null indicator with the coded attributes, from the group table."""
    named = row_numbers(groups.filter(F.col("grp").isNotNull()), ["attribute"], ["grp"], "_place")
    groups = named.unionByName(groups.filter(F.col("grp").isNull()).withColumn("_place", F.lit(0).cast("bigint")))
    code = F.col("_place").cast("double") - 1
    if numeric_attrs:
        own = F.coalesce(F.expr("try_cast(grp AS double)"), F.lit(0.0))
        code = F.when(F.col("attribute").isin(*numeric_attrs), own).otherwise(code)
    coded = groups.withColumn("code", code)
    long = coded.unpivot(["attribute", "code", "n"], ["null:" + c for c in columns], "column_name", "nulls").withColumn(
        "column_name", F.substring_index("column_name", "null:", -1)
    )
    n, x, m = F.col("n").cast("double"), F.col("code"), F.col("nulls").cast("double")
    sums = long.groupBy("column_name", F.col("attribute").alias("other")).agg(
        F.sum("n").alias("n"), F.sum(m).alias("m"), F.sum(n * x).alias("sx"), F.sum(n * x * x).alias("sxx"), F.sum(m * x).alias("sxy")
    )
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("m")
    spread = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("m") - F.col("m") * F.col("m"))
    return sums.filter((F.col("m") > 0) & (spread > 0) & (F.col("other") != F.col("column_name"))).select(
        "column_name", "other", F.lit("sensitive").alias("kind"), (cov / F.sqrt(spread)).alias("r"), "n"
    )


def _numeric_r(df: DataFrame, columns: Sequence[str], numeric: Sequence[str]) -> DataFrame | None:
    """r of every null indicator with the numeric columns, in one aggregation."""
    types = dict(df.dtypes)
    pairs = [(c, o) for c in columns for o in numeric if c != o]
    gone = {c: F.col(c).isNull() if types[c] not in ("double", "float") else F.col(c).isNull() | F.isnan(c) for c in columns}
    x = {o: as_double(F.col(o)) for o in numeric}
    # r of a 0/1 indicator follows from the mean where it is 1 and the overall mean and deviation
    wide = df.agg(
        *[F.struct(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).alias("x:" + o) for o, v in x.items()],
        *[F.count_if(g).alias("g:" + c) for c, g in gone.items()],
        *[F.struct(F.count(F.when(gone[c], x[o])).alias("n"), F.avg(F.when(gone[c], x[o])).alias("m")).alias(f"p:{c}:{o}") for c, o in pairs],
    )

    def pair(c: str, o: str) -> Column:
        every, part = F.col(f"`x:{o}`"), F.col(f"`p:{c}:{o}`")
        r = F.try_divide((part["m"] - every["m"]) * F.sqrt(part["n"] / F.nullif(every["n"] - part["n"], F.lit(0))), every["s"])
        return F.struct(F.lit(c).alias("column_name"), F.lit(o).alias("other"), every["n"].alias("n"), r.alias("r"), F.col(f"`g:{c}`").alias("g"))

    if not pairs:
        return None
    return (
        wide.select(F.inline(F.array(*[pair(c, o) for c, o in pairs])))
        .filter((F.col("g") > 0) & (F.col("n") > 10) & F.col("r").isNotNull())
        .select("column_name", "other", F.lit("numeric").alias("kind"), "r", "n")
    )


def missingness_class(
    df: DataFrame, attrs: Sequence[str], columns: Sequence[str], numeric: Sequence[str],
    alpha: float = 0.05, min_r: float = 0.1,
) -> DataFrame:
    """NMAR when missingness goes with a sensitive attribute, else MAR with a numeric column,
    else MCAR; all columns that have nulls, also those without any usable correlation."""
    found = _mechanism(missingness_correlations(df, attrs, columns, numeric), alpha, min_r)
    types = dict(df.dtypes)
    gone = {c: F.col(c).isNull() if types[c] not in ("double", "float") else F.col(c).isNull() | F.isnan(c) for c in columns}
    counts = df.agg(*[F.struct(F.lit(c).alias("column_name"), F.count_if(g).alias("n")).alias(f"c{i}") for i, (c, g) in enumerate(gone.items())])
    names = counts.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(gone))]))).filter("n > 0").select("column_name")
    return names.join(found, "column_name", "left").select("column_name", F.coalesce("mechanism", F.lit("MCAR")).alias("mechanism"))


def _mechanism(rows: DataFrame, alpha: float = 0.05, min_r: float = 0.1) -> DataFrame:
    hit = (F.col("p") < alpha) & (F.abs("r") > min_r)
    return rows.groupBy("column_name").agg(
        F.when(F.max(flag(hit & (F.col("kind") == "sensitive"))) == 1, "NMAR")
        .when(F.max(flag(hit & (F.col("kind") == "numeric"))) == 1, "MAR")
        .otherwise("MCAR")
        .alias("mechanism")
    )


def audit_summary(df: DataFrame, attrs: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Counts of the three kinds of finding and the overall status, from one table of group counts."""
    groups = written(_null_counts(df, attrs, columns, (), keep_null=True), "groups")
    named = groups.filter(F.col("grp").isNotNull())
    small = small_groups(shares(named.select("attribute", "grp", "n")), defaults.UNDERREPRESENTED)
    gaps = wide_gaps(missing_rates(named, columns), defaults.MISSING_GAP)
    # a numeric column can only make a column MAR, so the attributes decide what is NMAR
    nmar = _mechanism(_sensitive_r(groups, columns, numeric_among(df, attrs)).withColumn("p", corr_p("r", "n"))).filter("mechanism = 'NMAR'")
    found = (
        small.select(F.lit("underrepresented").alias("kind"))
        .unionByName(gaps.select(F.lit("gap").alias("kind")))
        .unionByName(nmar.select(F.lit("nmar").alias("kind")))
    )
    out = found.agg(*[F.count_if(F.col("kind") == k).cast("bigint").alias(a) for k, a in
                      (("underrepresented", "n_underrepresented"), ("gap", "n_missing_gaps"), ("nmar", "n_nmar"))])
    total = F.col("n_underrepresented") + F.col("n_missing_gaps") + F.col("n_nmar")
    return out.withColumn("total_issues", total).withColumn(
        "status", F.when(F.col("total_issues") == 0, defaults.STATUS["audit_ok"]).otherwise(defaults.STATUS["audit_issues"])
    )
