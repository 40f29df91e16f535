"""Kept profiles of parts say what a scan of all rows says."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from evenhand.operators import profile as Q
from evenhand.sources import tables as IO


def test_merged_profiles_equal_the_whole_table(spark):
    rng = np.random.default_rng(2)
    n = 30_000
    pdf = pd.DataFrame({"day": np.array(["2024-01-01", "2024-01-02", "2024-01-03"])[rng.integers(0, 3, n)], "x": 1e6 + rng.normal(size=n),
                        "many": rng.integers(0, 20_000, n), "few": rng.integers(0, 50, n).astype(str)})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("few") == "7", F.lit(float("nan"))).otherwise(F.col("x")))
    path = IO.scratch_folder(spark, "profiles")
    for day in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-02"):  # one day is loaded again
        Q.record_profiles(Q.part_profiles(df.filter(F.col("day") == day), "day"), path)
    got = {r.column_name: r for r in Q.merged_profile(Q.recorded_profiles(spark, path)).collect()}
    x = pdf["x"][pdf["few"] != "7"]
    assert got["x"].n == n and got["x"].n_null == n - len(x) and (got["x"].low, got["x"].high) == (x.min(), x.max())
    assert math.isclose(got["x"]["mean"], x.mean(), rel_tol=1e-12) and abs(got["x"]["std"] - x.std(ddof=0)) < 1e-3
    assert got["few"].n_distinct == 50 and got["few"].low is None and got["many"].dtype == "bigint"
    assert abs(got["many"].n_distinct / pdf["many"].nunique() - 1) < 0.03 and abs(got["x"].n_distinct / len(x) - 1) < 0.03
    whole = {r.column_name: r.n_distinct for r in Q.merged_profile(Q.part_profiles(df.withColumn("day", F.lit("all")), "day")).collect()}
    assert all(abs(got[c].n_distinct / whole[c] - 1) < 0.03 for c in whole)
    days = Q.merged_profile(Q.recorded_profiles(spark, path), ["part"]).filter("column_name = 'few'").collect()
    assert {r.part: r.n for r in days} == pdf.groupby("day").size().to_dict()


def test_new_and_changed_columns_null_parts_and_empty_tables(spark):
    path = IO.scratch_folder(spark, "profiles")
    first = spark.createDataFrame([("a", 1, None), (None, 2, None)], "part_of string, v int, w string")
    second = spark.createDataFrame([("b", "x", [1, 2])], "part_of string, v string, l array<int>")
    for df in (first, second, first.filter("v > 5")):
        Q.record_profiles(Q.part_profiles(df, "part_of"), path)
    got = {r.column_name: r for r in Q.merged_profile(Q.recorded_profiles(spark, path)).collect()}
    assert (got["v"].dtype, got["v"].n, got["v"].n_distinct) == ("mixed", 3, 3)
    assert (got["w"].n, got["w"].n_null, got["w"].n_distinct) == (2, 2, 0) and (got["l"].n, got["l"].n_distinct) == (1, 1)
    assert (got["v"].low, got["v"].high, got["v"]["mean"]) == (1.0, 2.0, 1.5)
    assert Q.part_profiles(first.filter("v > 5"), "part_of").count() == 0
