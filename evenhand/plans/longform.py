"""From wide decision rows to long (attribute, grp) form and grouped counts.

One scan serves every attribute: the rows are expanded inside the scan stage and the
partial aggregation runs before the shuffle, so what is shuffled is one row per
(attribute, group) and map task, however large or skewed a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from evenhand.functions.numeric import binary


def require(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise on columns the table does not have."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}; it has {df.columns}")


def numeric_among(df: DataFrame, columns: Sequence[str]) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in columns if isinstance(types[c], NumericType)]


def to_long(
    df: DataFrame,
    attrs: Sequence[str],
    keep: Sequence[Column | str] = (),
    keep_null: bool = False,
) -> DataFrame:
    """One row per (row, attribute) with ``attribute, grp`` next to the ``keep`` columns."""
    require(df, attrs)
    kept = [F.col(k) if isinstance(k, str) else k for k in keep]
    wide = df.select(*kept, *[F.col(a).cast("string").alias("attr:" + a) for a in attrs])
    ids = [c for c in wide.columns if not c.startswith("attr:")]
    long = wide.unpivot(ids, ["attr:" + a for a in attrs], "attribute", "grp").withColumn(
        "attribute", F.substring_index("attribute", "attr:", -1)
    )
    return long if keep_null else long.filter(F.col("grp").isNotNull())


def with_totals(groups: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """The group table with aggregates over all groups that share ``keys``: one small aggregation and a
    join, so that a key with millions of groups is in no single task."""
    keys = list(keys)
    sums = groups.groupBy(*keys).agg(*[c.alias(name) for name, c in totals.items()])
    renamed = sums.select(*[F.col(k).alias("_" + k) for k in keys], *totals)
    match = [groups[k].eqNullSafe(renamed["_" + k]) for k in keys]
    return groups.join(renamed, match).drop(*["_" + k for k in keys])


def group_rates(
    df: DataFrame, attrs: Sequence[str], y: str, by: Sequence[str] = (), extra: dict[str, Column] | None = None
) -> DataFrame:
    """``by, attribute, grp, n, positives, rate`` of a 0/1 column (anything else is refused); NULL y
    rows are not counted in n."""
    extra = extra or {}
    require(df, [y, *by])
    long = to_long(df, attrs, [*by, binary(y).alias("_y"), *[c.alias(k) for k, c in extra.items()]])
    return long.groupBy(*by, "attribute", "grp").agg(
        F.count("_y").alias("n"),
        F.sum("_y").alias("positives"),
        F.avg("_y").alias("rate"),
        *[F.sum(k).alias(k) for k in extra],
    )


def contingency(df: DataFrame, attrs: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """Sparse contingency cells ``by, attribute, grp, y, n`` (nulls on either side dropped)."""
    require(df, [y, *by])
    long = to_long(df, attrs, [*by, F.col(y).cast("string").alias("y")]).filter(F.col("y").isNotNull())
    return long.groupBy(*by, "attribute", "grp", "y").agg(F.count(F.lit(1)).alias("n"))

