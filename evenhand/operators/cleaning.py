"""Cleaning: contradictions, encoding, scaling, imputation, binning, column detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType, StringType

from evenhand.functions.numeric import as_double
from evenhand.plans.longform import require, to_long
from evenhand.plans.quantiles import QUINTILES, bin_edges, bin_index, exact_quantiles, few_valued

# Parts of column names that suggest a sensitive attribute.
SENSITIVE_HINTS = (
    "gender", "sex", "caste", "race", "ethnicity", "religion", "region", "age", "disability",
    "nationality", "zip", "pincode", "income", "education", "marital", "language", "tribe",
)
# Preferred names of the outcome column, in order.
TARGET_NAMES = ("hired", "approved", "approve", "decision", "target", "label", "outcome", "result")


def default_rules(df: DataFrame) -> list[tuple[str, Column]]:
    """The standard contradictions, as far as the table has the columns."""
    has = set(df.columns)
    rules = []
    if "age" in has:
        rules.append(("negative age", F.col("age") < 0))
        if "employment_years" in has:
            rules.append(("employment_years > age", F.col("employment_years") > F.col("age")))
    if "income" in has:
        rules.append(("negative income", F.col("income") < 0))
    return rules


def first_violation(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first broken rule; a rule over nulls is not broken."""
    out = F.lit(None).cast("string")
    for name, cond in reversed(list(rules)):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def inconsistency_removal(df: DataFrame, rules: Sequence[tuple[str, Column]] | None = None) -> DataFrame:
    """The rows that break no rule."""
    return df.filter(first_violation(rules or default_rules(df)).isNull())


def inconsistency_report(df: DataFrame, rules: Sequence[tuple[str, Column]] | None = None) -> DataFrame:
    """Rows removed per rule (each rule sees what earlier rules left) and in total."""
    marked = df.select(first_violation(rules or default_rules(df)).alias("rule")).filter(F.col("rule").isNotNull())
    out = marked.rollup("rule").agg(F.count(F.lit(1)).alias("n_removed"))
    return out.filter("n_removed > 0").select(F.coalesce("rule", F.lit("total_removed")).alias("rule"), "n_removed")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def feature_columns(df: DataFrame, target: str, sensitive: Sequence[str], skip: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are neither target nor sensitive."""
    return [c for c in numeric_columns(df) if c != target and c not in set(sensitive) | set(skip)]


def one_hot(df: DataFrame, columns: Sequence[str], max_values: int = 2000, many: str = "refuse") -> DataFrame:
    """Each string column replaced by one 0/1 int column per value; null gives all zeros.

    The value names become the schema, so they are collected. Columns with more than ``max_values``
    values are refused, or with ``many="vector"`` become sparse vectors ``<column>_vec``. Two values
    that would give columns of one name are refused.
    """
    require(df, columns)
    sizes = to_long(df, columns).groupBy("attribute").agg(F.countDistinct("grp").alias("n"))
    wide = [c for c in columns if c in {r["attribute"] for r in sizes.filter(F.col("n") > max_values).collect()}]  # a row per column
    if wide and many != "vector":
        raise ValueError(f"more than {max_values} values in {wide}; use many='vector'")
    few = [c for c in columns if c not in wide]
    listed = to_long(df, few).select("attribute", "grp").distinct().collect() if few else []
    names = sorted((r["attribute"], r["grp"]) for r in listed)
    rest = [c for c in df.columns if c not in set(columns)]
    new = [f"{c}_{v}" for c, v in names] + [c + "_vec" for c in wide]
    twice = sorted({c for c in new if new.count(c) > 1 or c in rest})
    if twice:
        raise ValueError(f"several columns would be named {twice}; rename the inputs")
    codes = [
        F.when(F.col(c).cast("string") == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}")
        for col in few for c, v in names if c == col
    ]
    coded = one_hot_vectors(df, wide) if wide else df
    return coded.select(*rest, *codes, *[c + "_vec" for c in wide])


def one_hot_vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sparse one-hot vectors ``<column>_vec`` for columns with many values."""
    index = [StringIndexer(inputCol=c, outputCol=c + "_idx", handleInvalid="keep") for c in columns]
    code = OneHotEncoder(inputCols=[c + "_idx" for c in columns], outputCols=[c + "_vec" for c in columns], dropLast=True)
    out = Pipeline(stages=[*index, code]).fit(df).transform(df)
    return out.drop(*[c + "_idx" for c in columns])


def scaler_stats(df: DataFrame, columns: Sequence[str], digits: int | None = 4) -> DataFrame:
    """Mean and population standard deviation per column; a zero deviation counts as 1."""
    require(df, columns)
    vals = [as_double(F.col(c)) for c in columns]
    wide = df.agg(*[F.struct(F.lit(c).alias("column_name"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).alias(f"s{i}")
                    for i, (c, v) in enumerate(zip(columns, vals))])
    long = wide.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))
    std = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    if digits is None:
        return long.withColumn("std", std)
    return long.select("column_name", F.round("mean", digits).alias("mean"), F.round(std, digits).alias("std"))


def standard_scale(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std per column; nulls stay null. ``fit_on`` supplies the moments
    (the training rows), by default the table itself. The moments come in as scalar subqueries."""
    source = fit_on if fit_on is not None else df
    vals = {c: as_double(F.col(c)) for c in columns}
    stats = source.agg(*[F.avg(v).alias("m:" + c) for c, v in vals.items()], *[F.stddev_pop(v).alias("s:" + c) for c, v in vals.items()])

    def scaled(c: str) -> Column:
        mean, std = stats.select("m:" + c).scalar(), stats.select("s:" + c).scalar()
        return ((vals[c] - mean) / F.coalesce(F.nullif(std, F.lit(0.0)), F.lit(1.0))).alias(c)

    chosen = set(columns)
    return df.select(*[scaled(c) if c in chosen else F.col(c) for c in df.columns])


def binarize_target(df: DataFrame, target: str, out: str = "target") -> DataFrame:
    """0/1 target: a two-valued column is coded, any other numeric one compared with its median.

    Two values (strings or numbers) are coded 0 and 1 in value order; null stays null. Strings that all read as
    numbers are cast first. Anything else is refused.
    """
    require(df, [target])
    numeric = isinstance(df.schema[target].dataType, NumericType)
    two = target in few_valued(df, [target], 2)
    if two:
        x = as_double(F.col(target)) if numeric else F.col(target)
        low, high = df.agg(F.min(x).alias("low"), F.max(x).alias("high")).first()
        if numeric and {low, high} <= {0.0, 1.0, None}:  # one value alone keeps its meaning
            return df.withColumn(out, x.cast("int"))
        return df.withColumn(out, F.when(x.isNotNull(), (x > F.lit(low)).cast("int")))
    value = as_double(F.col(target)) if numeric else F.expr(f"try_cast(`{target}` AS double)")
    if not numeric and df.agg(F.count_if(value.isNull()).alias("bad")).first()["bad"]:
        raise ValueError(f"'{target}' is not an outcome column: more than two values that are not numbers")
    median = exact_quantiles(df.select(value.alias("v")), ["v"], [0.5])["v"]
    if median is None:
        raise ValueError(f"'{target}' has no values")
    return df.withColumn(out, F.when(value.isNotNull(), (value > F.lit(median[0])).cast("int")))


def table_profile(df: DataFrame, distinct: str = "exact") -> DataFrame:
    """Position, type, rows, nulls (NaN counts as null) and distinct values per column.

    ``distinct="approx"`` replaces the shuffle of all distinct values by a sketch.
    """
    df = df.select(*[as_double(F.col(c)).cast(t).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    types = F.create_map(*[x for i, (c, t) in enumerate(df.dtypes)
                           for x in (F.lit(c), F.struct(F.lit(i).alias("position"), F.lit(t).alias("dtype")))])
    if distinct == "approx":
        wide = df.agg(*[F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"),
                                 F.approx_count_distinct(c).alias("n_distinct")).alias(f"c{i}") for i, c in enumerate(df.columns)])
        long = wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(df.columns))])))
    else:
        values = to_long(df, df.columns, keep_null=True).groupBy("attribute", "grp").agg(F.count(F.lit(1)).alias("n"))
        long = values.groupBy(F.col("attribute").alias("column_name")).agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("grp").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
            F.count("grp").alias("n_distinct"),
        )
    meta = types[F.col("column_name")]
    return long.select(meta["position"].alias("position"), "column_name", meta["dtype"].alias("dtype"), "n", "n_null", "n_distinct")


def detect_sensitive(df: DataFrame, match: str = "substring") -> DataFrame:
    """Columns whose name contains a hint, with their number of nulls; only those columns are read.

    ``match="token"`` wants the hint as a whole ``_``-separated word (``page`` is then no ``age``).
    """
    found = []
    for i, c in enumerate(df.columns):
        name = c.lower()
        hint = next((h for h in SENSITIVE_HINTS if (h in name.split("_") if match == "token" else h in name)), None)
        if hint:
            found.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(hint).alias("hint"), F.count_if(F.col(c).isNull()).alias("n_null")))
    if not found:
        return df.sparkSession.createDataFrame([], "position int, column_name string, hint string, n_null bigint")
    wide = df.agg(*[f.alias(f"c{i}") for i, f in enumerate(found)])
    return wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(found))])))


def detect_target(df: DataFrame) -> DataFrame:
    """The most likely outcome column and the rule that chose it: a preferred name, else the last
    two-valued column, else the last numeric one, else the last one."""
    names = {c: c.lower() for c in df.columns}
    for want in TARGET_NAMES:
        for c in df.columns:
            if want in names[c]:
                return _chosen(df, c, "name")
    sizes = few_valued(df, df.columns, 2) - few_valued(df, df.columns, 1)
    binary = [c for c in df.columns if c in sizes]
    if binary:
        return _chosen(df, binary[-1], "binary")
    numbers = numeric_columns(df)
    return _chosen(df, numbers[-1], "numeric") if numbers else _chosen(df, df.columns[-1], "last")


def _chosen(df: DataFrame, column: str, rule: str) -> DataFrame:
    return df.agg(F.lit(column).alias("column_name"), F.lit(rule).alias("rule"), F.count(column).alias("n_known"))


def median_impute(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Nulls replaced by the column's median (of ``fit_on``, e.g. the training rows)."""
    medians = exact_quantiles(fit_on if fit_on is not None else df, columns, [0.5])
    fill = {c: m[0] for c, m in medians.items() if m}
    return df.select(*[F.coalesce(as_double(F.col(c)), F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in df.columns])


def quantile_edges(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = QUINTILES) -> DataFrame:
    """The quantile edges as rows (column_name, edge_no, edge), duplicates dropped."""
    edges = bin_edges(df, columns, probs, keep_discrete=0)
    rows = [(c, i, float(e)) for c in columns for i, e in enumerate(edges[c] or [])]
    return df.sparkSession.createDataFrame(rows, "column_name string, edge_no int, edge double")


def quantile_bins(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = QUINTILES) -> DataFrame:
    """``<column>_bin`` with the 0-based right-closed quantile bin."""
    edges = bin_edges(df, columns, probs, keep_discrete=0)
    bins = [bin_index(as_double(F.col(c)), edges[c] or []).alias(c + "_bin") for c in columns]
    return df.select(*df.columns, *bins)


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null (or NaN) in the columns."""
    return df.na.drop(subset=list(columns))


def feature_matrix(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, features`` with the columns assembled into one vector."""
    out = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)
    return out.select(key, "features")


def review_sample(
    df: DataFrame, key: str, groups: Sequence[str], prob: str, per_group: int, borderline: float = 0.5
) -> DataFrame:
    """The ``per_group`` most borderline rows of every group, for expert review.

    The rank filter lets Spark keep at most ``per_group`` rows per group in each map task
    (WindowGroupLimit), so a hot group never travels whole.
    """
    order = W.partitionBy(*groups).orderBy(F.abs(F.col(prob) - borderline), F.md5(F.col(key).cast("string")), key)
    return df.withColumn("review_rank", F.row_number().over(order)).filter(F.col("review_rank") <= per_group)


def drop_proxies(df: DataFrame, proxies: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The table without the features a proxy table flags (one name per flagged feature)."""
    names = {r["feature"] for r in proxies.filter("is_proxy").select("feature").distinct().collect()} - set(keep)
    return df.drop(*sorted(names))


def decorrelate_feature(df: DataFrame, attr: str, feature: str) -> DataFrame:
    """Feature with its group mean replaced by the overall mean; null groups keep their value.

    Group means are aggregated first and joined back, so no group is gathered in one task.
    """
    x = as_double(F.col(feature))
    sums = df.filter(F.col(attr).isNotNull()).groupBy(attr).agg(F.avg(x).alias("_group_mean"))
    overall = df.agg(F.avg(x).alias("m")).scalar()
    joined = df.join(sums, attr, "left")
    shifted = F.when(F.col("_group_mean").isNull(), x).otherwise(x - F.col("_group_mean") + overall)
    return joined.select(*[shifted.alias(c) if c == feature else F.col(c) for c in df.columns])
