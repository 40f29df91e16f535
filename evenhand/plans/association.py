"""Chi-square, Cramér's V and Fisher's exact test from grouped counts.

chi2 = N * (sum O^2 / (R*C) - 1) needs the non-zero cells only, so no dense crosstab is formed.
With a 0/1 target everything about an attribute follows from one aggregation of its group rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evenhand.functions.numeric import argmax, argmin, ratio
from evenhand.functions.pvalues import chi2_sf, fisher_p


def _finish(raw: Column, keys: Sequence[str], t: DataFrame, yates: bool, extra: Sequence[str] = ()) -> DataFrame:
    """From n, r, k, _q-free raw chi2 and margins to the test columns, Yates-corrected at dof 1."""
    # all four |O-E| of a 2x2 are equal, so the correction follows from chi2 and the margins
    scale = F.try_divide(
        F.pow(F.col("n").cast("double"), F.lit(3)), F.col("_rmin") * F.col("_rmax") * F.col("_cmin") * F.col("_cmax")
    )
    corrected = F.pow(F.greatest(F.sqrt(raw / scale) - F.lit(0.5), F.lit(0.0)), F.lit(2)) * scale
    dof = (F.col("r") - 1) * (F.col("k") - 1)
    chi = F.when(dof == 0, F.lit(0.0))
    if yates:
        chi = chi.when(dof == 1, corrected)
    m = F.least("r", "k") - 1
    out = t.withColumn("dof", dof.cast("int")).withColumn("chi_square", chi.otherwise(raw))
    square = (F.col("r") == 2) & (F.col("k") == 2)
    a = F.col("_a")
    return out.select(
        *keys, "n", "r", "k", "dof", "chi_square",
        F.when(m > 0, F.sqrt(F.col("chi_square") / (F.col("n") * m))).otherwise(F.lit(0.0)).alias("cramers_v"),
        (F.col("_rmin") * F.col("_cmin") / F.col("n")).alias("min_expected"),
        F.col("_omin").cast("bigint").alias("min_observed"),
        F.when(square, a).alias("a"),
        F.when(square, F.col("_r1") - a).alias("b"),
        F.when(square, F.col("_c1") - a).alias("c"),
        F.when(square, F.col("n") - F.col("_r1") - F.col("_c1") + a).alias("d"),
        *extra,
    )


def chi_square(cells: DataFrame, keys: Sequence[str], row: str, col: str, yates: bool = True) -> DataFrame:
    """Test of any sparse table of cells ``keys, row, col, n``: one row per ``keys``.

    ``row`` is the side with many values, ``col`` the one with few: a row value's window holds at
    most as many cells as there are ``col`` values, and the rows are then summed up map-side.
    Adds the 2x2 counts a, b, c, d (ordered by value) where the table is one.
    """
    w = W.partitionBy(*keys, row)
    per_cell = cells.select(
        *keys, row, col,
        F.col("n").alias("_o"),
        F.sum("n").over(w).alias("_r"),
        (F.row_number().over(w.orderBy(col)) == 1).cast("int").alias("_first"),
    )
    o, r = F.col("_o").cast("double"), F.col("_r").cast("double")
    per_col = per_cell.groupBy(*keys, col).agg(
        F.sum("_o").alias("_c"),
        F.sum(o * o / r).alias("_s"),
        F.sum("_first").alias("_rows"),
        F.min("_r").alias("_rmin"),
        F.max("_r").alias("_rmax"),
        F.min("_o").alias("_omin"),
        F.count(F.lit(1)).alias("_cells"),
        F.min(F.struct(F.col(row).alias("v"), F.col("_r").alias("r"), F.col("_o").alias("o"))).alias("_top"),
    )
    per_key = per_col.groupBy(*keys).agg(
        F.sum("_c").alias("n"),
        F.sum("_rows").cast("int").alias("r"),
        F.count(F.lit(1)).cast("int").alias("k"),
        F.sum(F.col("_s") / F.col("_c")).alias("_q"),
        F.min("_rmin").cast("double").alias("_rmin"),
        F.max("_rmax").cast("double").alias("_rmax"),
        F.min("_c").cast("double").alias("_cmin"),
        F.max("_c").cast("double").alias("_cmax"),
        F.min("_omin").alias("_omin0"),
        F.sum("_cells").alias("_cells"),
        F.min(F.struct(F.col(col).alias("v"), F.col("_c").alias("c"), F.col("_top").alias("top"))).alias("_first"),
        F.min("_top").alias("_toprow"),
    )
    t = per_key.select(
        "*",
        F.when(F.col("_cells") < F.col("r") * F.col("k"), F.lit(0)).otherwise(F.col("_omin0")).alias("_omin"),
        F.col("_toprow.r").alias("_r1"),
        F.col("_first.c").alias("_c1"),
        F.when(F.col("_first.top.v") == F.col("_toprow.v"), F.col("_first.top.o")).otherwise(F.lit(0)).alias("_a"),
    )
    return _finish(F.greatest(F.col("n") * (F.col("_q") - 1.0), F.lit(0.0)), keys, t, yates)


def binary_tests(groups: DataFrame, keys: Sequence[str], yates: bool = True, extra: dict[str, Column] | None = None) -> DataFrame:
    """Everything about an attribute against a 0/1 target from its rows ``grp, n, positives, rate``:
    the test columns plus max/min rate and group (and ``extra`` aggregates), in one aggregation."""
    extra = extra or {}
    rate = F.col("rate")
    pos, n = F.col("positives").cast("double"), F.col("n").cast("double")
    t = (
        groups.filter("n > 0")
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            F.sum("positives").alias("_p"),
            F.count(F.lit(1)).cast("int").alias("r"),
            F.sum(pos * pos / n).alias("_q"),
            F.min("n").cast("double").alias("_rmin"),
            F.max("n").cast("double").alias("_rmax"),
            F.min(F.least(F.col("positives"), F.col("n") - F.col("positives"))).alias("_omin"),
            F.min_by(F.col("n") - F.col("positives"), "grp").alias("_a"),
            F.min_by("n", "grp").alias("_r1"),
            F.max(rate).alias("max_rate"),
            argmax("grp", rate).alias("max_group"),
            F.min(rate).alias("min_rate"),
            argmin("grp", rate).alias("min_group"),
            *[c.alias(name) for name, c in extra.items()],
        )
        .withColumn("_c1", F.col("n") - F.col("_p"))
        .withColumn("k", F.when((F.col("_p") > 0) & (F.col("_c1") > 0), 2).otherwise(1))
        .withColumn("_cmin", F.when(F.col("k") == 2, F.least("_p", "_c1")).otherwise(F.col("n")).cast("double"))
        .withColumn("_cmax", F.greatest("_p", "_c1").cast("double"))
    )
    p = F.col("_p") / F.col("n")
    raw = F.greatest(ratio(F.col("_q") - F.col("_p") * p, p * (1 - p)), F.lit(0.0))
    return _finish(raw, keys, t, yates, ["max_rate", "max_group", "min_rate", "min_group", *extra])


def with_p(tests: DataFrame, keys: Sequence[str], small: Column) -> DataFrame:
    """``p_value`` and ``test``: chi-square tail, or Fisher's exact test where ``small`` holds on a 2x2."""
    exact = with_fisher(tests, keys, small & F.col("a").isNotNull())
    return exact.withColumn("test", F.when(F.col("fisher_p").isNotNull(), "fisher").otherwise("chi_square")).withColumn(
        "p_value", F.coalesce("fisher_p", chi2_sf("chi_square", "dof"))
    ).drop("fisher_p")


def with_fisher(tables: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """The tables (one row per ``keys``, counts a, b, c, d) with the two-sided ``fisher_p``, NULL where ``where``
    does not hold. A row per test; no support is written out."""
    cell = [F.when(F.lit(True) if where is None else where, F.col(x)) for x in "abcd"]
    return tables.withColumn("fisher_p", fisher_p(*cell))
