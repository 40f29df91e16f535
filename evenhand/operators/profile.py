"""Profiles of tables that grow: each part (a day, a load) is scanned once, its profile kept, and profiles are merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType

from evenhand.functions.numeric import as_double
from evenhand.plans.longform import require

SCHEMA = (
    "position int, column_name string, dtype string, n bigint, n_null bigint, low double, high double, mean double, m2 double, sketch binary, part string"
)


def part_profiles(df: DataFrame, part: str, precision: int = 14) -> DataFrame:
    """One row for each value of ``part`` (as text) and other column, from one scan: rows, nulls (NaN counts as null), for numeric columns
    the range, mean and squared deviations, and a sketch of the distinct values (2^``precision`` registers, whatever the part's size).

    An empty table has no parts and so no rows.
    """
    require(df, [part])
    fields = [f for f in df.schema.fields if f.name != part]
    each = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        number = as_double(c) if isinstance(f.dataType, NumericType) else F.lit(None).cast("double")
        value = as_double(c).cast(f.dataType) if f.dataType.typeName() in ("double", "float") else c
        text = value.cast("string") if f.dataType.typeName() in ("string", "boolean", "date", "timestamp", "timestamp_ntz") or isinstance(f.dataType, NumericType) else F.to_json(F.struct(value))
        text = F.when(value.isNotNull(), text)
        each.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.count(F.lit(1)).alias("n"),
            F.count_if(value.isNull()).alias("n_null"), F.min(number).alias("low"), F.max(number).alias("high"), F.avg(number).alias("mean"),
            (F.var_pop(number) * F.count(number)).alias("m2"), F.hll_sketch_agg(text, precision).alias("sketch"),
        ))
    wide = df.groupBy(F.col(f"`{part}`").cast("string").alias("part")).agg(F.array(*each).alias("p"))
    return wide.select("part", F.inline("p")).select("position", "column_name", "dtype", "n", "n_null", "low", "high", "mean", "m2", "sketch", "part")


def record_profiles(profiles: DataFrame, path: str) -> None:
    """Keep the profiles in a table at ``path``. A part recorded again takes the place of its earlier profile, so a repeated or
    retried load counts once. Null and empty parts are one part."""
    profiles.write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def recorded_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def merged_profile(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The profile of all parts together (or of each of ``by``) from the kept profiles alone, without their rows.

    Rows, nulls, range, mean and standard deviation (population) are those of the rows. ``n_distinct`` is estimated from the united sketches:
    its standard error is about 0.8/sqrt(registers), 0.7 % at 2^14, and a few hundred values are told exactly. A column
    whose type differs between parts has dtype ``mixed``; one that a part lacks counts that part's rows for nothing.
    """
    k = F.col("n") - F.col("n_null")
    keys = [*by, "column_name"]
    out = profiles.groupBy(*keys).agg(
        F.min("position").alias("position"), F.when(F.min("dtype") == F.max("dtype"), F.min("dtype")).otherwise("mixed").alias("dtype"),
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.try_divide(F.sum(F.col("mean") * k), F.sum(F.when(F.col("mean").isNotNull(), k))).alias("mean"),
        F.sum("m2").alias("_in"), F.sum(F.col("mean") * F.col("mean") * k).alias("_sq"), F.sum(F.when(F.col("mean").isNotNull(), k)).alias("_k"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch", True)).alias("n_distinct"),
    )
    spread = F.greatest(F.col("_in") + F.col("_sq") - F.col("_k") * F.col("mean") * F.col("mean"), F.lit(0.0))
    std = F.when(F.col("_k") > 0, F.sqrt(F.try_divide(spread, F.col("_k"))))
    return out.select(*by, "position", "column_name", "dtype", "n", "n_null", "n_distinct", "low", "high", "mean", std.alias("std"))
